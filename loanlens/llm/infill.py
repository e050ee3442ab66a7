"""Operator 12: fill-in-the-middle by in-place block rotations.

A text is cut into prefix, middle and suffix at two places drawn from the hash
of its id.  The cuts are scanned for in the text's UTF-8 bytes (code point
offsets become byte offsets by counting lead bytes), the three sentinels are
inserted into a bytearray before their parts, and two neighbouring blocks are
exchanged by three reversals (each block on its own, then both together):

* ``psm`` exchanges middle and suffix: ``<P>prefix<S>suffix<M>middle``;
* ``spm`` brings the suffix to the front: ``<S>suffix<P>prefix<M>middle``.

``restore`` finds the sentinels, rotates back and takes them out.  A text that
holds a sentinel stays plain, and a sentinel begins with ``<``, ends with ``>``
and has neither elsewhere, so that no place where text and sentinel meet can
be read as a sentinel: restoring is exact.

Scale: one pass without a shuffle, one row a text.  A reversal needs ``BLOCK``
bytes beside the text; texts go through Python a few at a time, whatever
their lengths.

Defined results: a null or empty text is ``plain`` and comes back as an empty
one; a null id is hashed as an empty string; rows of the same id are cut at
the same fractions, repeated rows equally; columns that bear the name of a
result are replaced, all others pass through; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import documents
from loanlens.llm.shingles import blocks, texts_of

BLOCK = 1 << 16
SEED = "1"
# Sentinels, and the shares (in percent) of transformed texts and of spm among them.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
FIM_PERCENT = 90
SPM_PERCENT = 20


def draws(doc_id: object, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the id: two cuts, whether, and which form."""
    h = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i: i + 4], "big") for i in (0, 4, 8, 12))


def reverse(data: np.ndarray, begin: int, end: int) -> None:
    """Turn ``data[begin:end]`` round in place, a block from either end at a time."""
    while end - begin > 1:
        size = min(BLOCK, (end - begin) // 2)
        left = data[begin: begin + size].copy()
        data[begin: begin + size] = data[end - size: end][::-1]
        data[end - size: end] = left[::-1]
        begin += size
        end -= size


def exchange(buffer: bytearray, begin: int, cut: int, end: int) -> None:
    """Swap the neighbouring blocks ``[begin, cut)`` and ``[cut, end)`` by three reversals."""
    data = np.frombuffer(buffer, np.uint8)
    reverse(data, begin, cut)
    reverse(data, cut, end)
    reverse(data, begin, end)


def count_points(raw: bytes) -> int:
    """Code points of UTF-8 bytes (bytes that don't continue one)."""
    data = np.frombuffer(raw, np.uint8)
    return sum(int(np.count_nonzero((data[i: i + BLOCK] & 0xC0) != 0x80)) for i in range(0, len(data), BLOCK))


def byte_offset(raw: bytes, points: int) -> int:
    """Where code point number ``points`` begins."""
    data = np.frombuffer(raw, np.uint8)
    seen = 0
    for i in range(0, len(data), BLOCK):
        lead = (data[i: i + BLOCK] & 0xC0) != 0x80
        here = int(np.count_nonzero(lead))
        if seen + here > points:
            return i + int(np.flatnonzero(lead)[points - seen])
        seen += here
    return len(raw)


def rotate(raw: bytes, doc_id: object, seed: str = SEED) -> tuple[int, str, int | None, int | None, bytes]:
    """``(code points, form, prefix code points, middle code points, output)`` of a text."""
    n = count_points(raw)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw or h3 % 100 >= FIM_PERCENT or any(s in raw for s in SENTINELS):
        return n, "plain", None, None, raw
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = byte_offset(raw, first), byte_offset(raw, last)
    out = bytearray(raw)
    out[b:b] = SUFFIX
    out[a:a] = MIDDLE
    out[:0] = PREFIX
    middle, suffix = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)
    if h4 % 100 < SPM_PERCENT:
        form = "spm"
        exchange(out, 0, suffix, len(out))
    else:
        form = "psm"
        exchange(out, middle, suffix, len(out))
    return n, form, first, last - first, bytes(out)


def rotate_back(raw: bytes, form: str) -> bytes:
    """The text that ``rotate`` made ``raw`` from."""
    if form == "plain":
        return raw
    out = bytearray(raw)
    if form == "spm":
        cut = out.find(PREFIX)                       # suffix before, prefix and middle behind
        middle = out.find(MIDDLE, cut) - cut
        begin = 0
    else:
        begin = out.find(SUFFIX)                     # prefix before stays
        cut = out.find(MIDDLE, begin)
        middle = begin
    suffix = begin + len(out) - cut
    exchange(out, begin, cut, len(out))
    for at in (suffix, middle, 0):
        del out[at: at + 3]
    return bytes(out)


def _apply(df: DataFrame, made: dict, inputs: list[str], run_one: Callable) -> DataFrame:
    """``df`` with the columns of ``made`` (name to type), from ``run_one`` over the columns ``inputs``."""
    keep = [c for c in df.columns if c not in made]
    schema = df.select(*keep, *[F.lit(None).cast(t).alias(c) for c, t in made.items()]).schema
    types = [pa.string() if t == "string" else pa.int64() for t in made.values()]
    # a replaced column may be one that is read
    sent = df.select(*keep, *[F.col(c).alias(f"{len(df.columns)}_{i}") for i, c in enumerate(inputs)])
    wide = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in blocks(texts_of(batch.column(wide))):
                others = [batch.column(wide + i).slice(at, len(block)).to_pylist() for i in range(1, len(inputs))]
                rows = [run_one((t or "").encode(), *rest) for t, *rest in zip(block, *others, strict=True)]
                part = batch.slice(at, len(block))
                at += len(block)
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:wide], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[*keep, *made])

    return sent.mapInArrow(run, schema)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """``docs`` with ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``."""
    made = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output": "string"}
    return _apply(docs, made, [text_col, id_col], lambda raw, doc_id: rotate(raw, doc_id, seed))


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "restored") -> DataFrame:
    """``df`` with the text that ``output_col`` was made from, from the output and its form alone."""
    return _apply(df, {text_col: "string"}, [output_col, form_col], lambda raw, form: (rotate_back(raw, form),))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                                F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_OP12 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, len(coalesce(text, '')) AS n,
             sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
               OR ('0x' || h[17:24])::BIGINT % 100 >= {FIM_PERCENT} THEN 'plain'
             WHEN ('0x' || h[25:32])::BIGINT % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, substring(text, 1, least(c1, c2)) AS pre, substring(text, least(c1, c2) + 1, abs(c1 - c2)) AS mid,
        substring(text, greatest(c1, c2) + 1) AS suf FROM d)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN least(c1, c2) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN abs(c1 - c2) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
