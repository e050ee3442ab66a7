"""Operator 3: byte-pair encoding and decoding by a prefix-sharing trie.

A word's encoding is fixed by the last token of each of its prefixes: the last
token ``t`` of a prefix is the one suffix of it for which the last token ``u``
of what is before ``t`` and ``t`` itself stay apart when ``u + t`` is merged.
The distinct words of a block form a trie; it is walked depth first (the
sorted words are that walk: what two neighbours share is their common path),
and the last-token states of a shared prefix are computed once and stay on the
stack for every word below it.  The end of a word is a symbol of its own.

Whether two tokens stay apart is found from the merges alone: going back in
time along the right edge of the first and the left edge of the second, the
boundary breaks if the pair that faces each other at some time merges before
either of them is used up.  Answers are remembered in a table of bounded size.

Scale: one pass without a shuffle.  A task holds the words of about half a million
characters, tables of about ``WORDS`` words and as many runs between white space, and the tokenizer's own
tables, which are read on the driver from the path given and broadcast (their
size is the vocabulary's).

Defined results: a null text counts as empty and has no tokens; the special
tokens' strings in a text become their ids; repeated rows get a result each;
all other columns pass through unchanged; an empty table stays empty.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import documents
from loanlens.llm.shingles import texts_of

BLOCK_CHARS = 500_000
WORDS = 300_000
PAIRS = 400_000
TAIL = 4

# What the tokenizer file says about words, the end of a word, and white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
#: Letters and digits that newer Unicode tables have and the tokenizer's don't: there they are symbols.
NEWER = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u1C89\u208F\u209D-\u209F\uA7CB-\uA7CC\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DA\uA7DC-\uA7DD"
    r"\uA7E2\uA7F1\uAB6C-\uAB6D\U000107BB-\U000107BF\U00010940-\U00010959\U00010D50-\U00010D65\U00010EC5-\U00010EC7"
    r"\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DF1\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3"
    r"\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2"
    r"\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF"
    r"\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F")
#: Capital letters that Python's tables don't lower yet.
LOWER_NEWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
               0xA7DC: 0x19B} | {0x10D50 + i: 0x10D70 + i for i in range(22)} | {0x16EA0 + i: 0x16EBB + i for i in range(25)}
FIRST_NEWER = "[\u0558-\U0010FFFF]"
#: White space to Python, but not to the pattern.
INNER = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable, else the next free one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def read_tables(path: str) -> dict:
    """Vocabulary, merges and special tokens of a tokenizer file (read on the driver)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
        raise ValueError(f"not a BPE with word ends: {path}")
    return {"vocab": model["vocab"], "merges": [tuple(m) for m in model["merges"]],
            "special": {t["content"]: t["id"] for t in spec["added_tokens"]}}


class TrieEncoder:
    """Word encodings over one tokenizer's tables."""

    def __init__(self, tables: dict):
        self.vocab = vocab = tables["vocab"]
        self.special = tables["special"]
        self.born = dict.fromkeys(vocab.values(), -1)      # when a token is made: the rank of its merge
        self.left, self.right, self.rank = {}, {}, {}
        for r, (a, b) in enumerate(tables["merges"]):
            t, x, y = vocab[a + b], vocab[a], vocab[b]
            self.born[t], self.left[t], self.right[t], self.rank[x, y] = r, x, y, r
        # the longest token that ends in TAIL given letters, at the end of a word or not; shorter ones can be anywhere
        self.reach: dict[str, int] = {}
        for t in vocab:
            tail = END if t.endswith(END) else ""
            body = t.removesuffix(END)
            if len(body) >= TAIL:
                self.reach[body[-TAIL:] + tail] = max(len(body), self.reach.get(body[-TAIL:] + tail, 1))
        self.code = {i: i.to_bytes(4, "little") for i in [*vocab.values(), *self.special.values()]}
        self.split = regex.compile(PIECES)
        self.runs_of = regex.compile(r"\S+")
        self.late = regex.compile(FIRST_NEWER)
        careful = (PIECES.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{NEWER}])")
                   .replace(r"[\p{L}]", rf"(?:(?![{NEWER}])\p{{L}})").replace(r"[\p{N}]", rf"(?:(?![{NEWER}])\p{{N}})"))
        self.split_late = regex.compile(careful)
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.letters = byte_letters()
        self.apart: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def stay_apart(self, u: int, t: int) -> bool:
        key = u << 32 | t
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            known = self.apart[key] = self._stay_apart(u, t)
        return known

    def _stay_apart(self, u: int, t: int) -> bool:
        born, rank = self.born, self.rank
        u_until = t_until = len(rank)                     # when each is used up by a merge inside its own token
        while True:
            r = rank.get((u, t))
            # on equal ranks the merge further left comes first
            if r is not None and r < u_until and r <= t_until:
                return False
            if born[u] > born[t]:
                u_until, u = born[u], self.right[u]
            elif born[t] >= 0:
                t_until, t = born[t], self.left[t]
            else:
                return True

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (little-endian, 4 bytes each) of words given in byte letters."""
        token, reach, apart, code, out = self.vocab.get, self.reach.get, self.apart.get, self.code, {}
        last, start, before = [0], [0], ""                # by depth: the prefix's last token and where it starts

        def token_to(path: str, end: int, tail: str = "") -> tuple[int, int]:
            least = TAIL if end > TAIL else end
            for begin in range(end - min(end, reach(path[end - least:end] + tail, TAIL - 1)), end):
                t = token(path[begin:end] + tail)
                if t is not None:
                    if not begin:
                        return t, begin
                    u = last[begin] if begin < len(last) else state(path, begin)
                    stays = apart(u << 32 | t)
                    if stays or stays is None and self.stay_apart(u, t):
                        return t, begin
            raise ValueError(f"no encoding of {path!r}")

        def state(path: str, depth: int) -> int:
            while len(last) <= depth:
                t, begin = token_to(path, len(last))
                last.append(t)
                start.append(begin)
            return last[depth]

        for word in sorted(words):
            shared = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                shared += 1
            if len(last) > shared + 1:
                del last[shared + 1:], start[shared + 1:]
            before = word
            t, at = token_to(word, len(word), END)
            ids = [t]
            while at:
                state(word, at)
                ids.append(last[at])
                at = start[at]
            out[word] = b"".join([code[i] for i in reversed(ids)])
        return out

    def lowered(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()       # no final sigma: letters are lowered one by one
        return text.translate(LOWER_NEWER) if self.late.search(text) else text

    def pieces(self, run: str) -> list[str]:
        """Words of a lowered run of a text."""
        if not run.isascii() and self.late.search(run):
            return self.split_late.findall(run)
        return self.split.findall(run)

    def encode_runs(self, texts: list[str]) -> list[bytes]:
        """Ids of lowered texts. Words end at white space, so that a run without any is split into words and encoded once."""
        split = [self.runs_of.findall(t) if INNER.search(t) else t.split() for t in texts]
        runs, known = self.runs, self.words
        if len(runs) >= WORDS:
            runs.clear()
        parts = {r: self.pieces(r) for r in set().union(*split) if r not in runs}
        if len(known) >= WORDS:
            known.clear()
        new = [w for w in set().union(*parts.values()) if w not in known]
        letters = self.letters
        # printable ASCII stands for itself; all else has letters of its own
        spelled = {w: w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode("utf-8", "replace")]) for w in new}
        made = self.encode_words(list(set(spelled.values())))
        for w, s in spelled.items():
            known[w] = made[s]
        get = known.__getitem__
        for r, p in parts.items():
            runs[r] = get(r) if len(p) == 1 else b"".join(map(get, p))
        get = runs.__getitem__
        return [b"".join(map(get, r)) for r in split]

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the words that are new form the block's trie."""
        cut: list[str] = []
        parts: list[list] = []                            # of a text: numbers in ``cut``, or the ids of special tokens
        for text in texts:
            one: list = []
            at = 0
            for m in self.marks.finditer(text) if self.marks and "<|" in text else ():
                one += [len(cut), self.code[self.special[m.group()]]]
                cut.append(self.lowered(text[at:m.start()]))
                at = m.end()
            parts.append([*one, len(cut)])
            cut.append(self.lowered(text[at:] if at else text))
        ids = self.encode_runs(cut)
        return [ids[one[0]] if len(one) == 1 else b"".join([ids[p] if isinstance(p, int) else p for p in one]) for one in parts]


def blocks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Consecutive runs of texts of about half a million characters."""
    block: list[str] = []
    size = 0
    for t in texts:
        block.append(t or "")
        size += len(t or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens") -> DataFrame:
    """``docs`` with the token ids of its text: ``ids_col`` binary (little-endian, 4 bytes an id) and ``count_col`` long."""
    tables = docs.sparkSession.sparkContext.broadcast(read_tables(path))
    keep = [c for c in docs.columns if c not in (ids_col, count_col)]
    schema = docs.select(*keep, F.lit(b"").alias(ids_col), F.lit(0).cast("long").alias(count_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TrieEncoder(tables.value)
        for batch in batches:
            at = 0
            for block in blocks(texts_of(batch.column(batch.schema.get_field_index(text_col)))):
                ids = encoder.encode_block(block)
                part = batch.slice(at, len(block))
                at += len(block)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                    names=[*part.schema.names, ids_col, count_col])

    return docs.select(*keep).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids: the tokens with a space between them, special tokens included."""
    t = read_tables(path)
    # the ids' tokens alone: decoding needs no merges
    tokens = df.sparkSession.sparkContext.broadcast({i: s for s, i in [*t["vocab"].items(), *t["special"].items()]})
    keep = [c for c in df.columns if c != out_col]
    schema = df.select(*keep, F.lit("").alias(out_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        token = tokens.value.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [" ".join(map(token, np.frombuffer(x or b"", "<u4").tolist()))
                         for x in part.column(part.schema.get_field_index(ids_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out_col])

    return df.select(*keep).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    both = decode(encode(docs.select("doc_id", "text"), path).drop("text"), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), tokenizer_path())
