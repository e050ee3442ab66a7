r"""Operator 11: chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
the context, and its text alone is trainable.  An example is a prefix of the
formatted conversation, up to the end of its target, with one span under the
loss mask.  ``example_texts`` writes every example out, as a stream, and
``read_examples`` reads conversations back from these texts and spans: that is op11.
Written out, the examples of a conversation grow with the square of
its turns; ``examples`` has them as rows that say where an example's text ends and
where its target lies in it, for who stores the formatted turns once (``read_back``).

Template: ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a
line feed.  In texts and roles every ``<``, backslashes, ``|`` gets one more
backslash, so that no mark can occur in them and taking one away restores them; in
roles backslashes are doubled and line feeds written as a backslash and an n before that.

Scale: formatting is made of SQL functions; one shuffle by conversation brings
its turns together and sorts them, and a running sum over the sorted rows (which
spills) gives the offsets.  The examples and the digests stream over these rows:
no task holds a conversation, however long.  A digest of a whole conversation is a
chain from its first turn to its last, so one task reads a conversation's
rows, one after the other.

Defined results: turns are put in the order of turn, role and text (nulls first), so
that ties and repeated rows have one order, and repeated rows are turns each; a
null text or role is empty; rows with a null id are one conversation; turns
after the last reply, and conversations without one, belong to no example but
are among the turns; further columns are left out; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Marks and the trainable role.
START, END = "<|im_start|>", "<|im_end|>"
TARGET = "assistant"
#: Text that a template without escapes would take for turns.
TRAP = f"{END}{START}{TARGET} ok"
SEGMENT = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + "\n", re.DOTALL)
#: The same where turns follow each other: no text holds a mark.
NEXT_SEGMENT = re.compile(SEGMENT.pattern.replace("(.*)", "(.*?)"), re.DOTALL)
#: Examples are handed on once so many characters or rows are together.
SEND_CHARS, SEND_ROWS = 1_000_000, 1000


def escape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("|")), F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")).otherwise(text)


def escape_role(role: Column) -> Column:
    """A role ends at a line feed, so it must not hold one."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row a turn: ``conv_id, position, segment, start, chars, example, loss_start, loss_end``.

    ``segment`` is the formatted turn, which begins at code point ``start`` of
    the formatted conversation; targets have the number of their example
    (from 0) and the span of their text, other turns have nulls there.  The rows of
    a conversation come one after the other, in order.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.select(
        "conv_id", "turn", "role", "text", escape(F.col("text")).alias("body"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"))
    rows = rows.select(
        "conv_id", "turn", "role", "text", (F.col("role") == TARGET).alias("target"), F.length("head").alias("head_chars"),
        F.length("body").alias("body_chars"), F.concat("head", "body", F.lit(f"{END}\n")).alias("segment"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "conv_id", (F.row_number().over(order) - 1).alias("position"), "segment", "target", "head_chars", "body_chars",
        F.length("segment").cast("long").alias("chars"), F.sum(F.length("segment").cast("long")).over(until).alias("stop"),
        (F.count(F.when(F.col("target"), 1)).over(until) - 1).alias("number"))
    start = F.col("stop") - F.col("chars")
    mine = lambda c: F.when(F.col("target"), c)
    return rows.select(
        "conv_id", F.col("position").cast("long").alias("position"), "segment", start.alias("start"), "chars",
        mine(F.col("number")).alias("example"), mine(start + F.col("head_chars")).alias("loss_start"),
        mine(start + F.col("head_chars") + F.col("body_chars")).alias("loss_end"))


def examples(turns: DataFrame) -> DataFrame:
    """One row an assistant turn: ``conv_id, example, n_context_turns, loss_start, loss_end, n_chars``.

    The example's text is the first ``n_chars`` code points of the formatted
    conversation, of which ``loss_start`` to ``loss_end`` (exclusive) are trainable.
    """
    return turns.filter("example is not null").select(
        "conv_id", "example", F.col("position").alias("n_context_turns"), "loss_start", "loss_end", (F.col("start") + F.col("chars")).alias("n_chars"))


def _in_order(turns: DataFrame, in_order: bool) -> DataFrame:
    return turns if in_order else turns.repartition("conv_id").sortWithinPartitions("conv_id", "position")


def _rows(batches: Iterator[pa.RecordBatch], few: int = 128) -> Iterator[tuple]:
    """Rows of Arrow batches, made into Python values a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, few):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, few).columns], strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _schema(turns: DataFrame, rest: str) -> StructType:
    """``conv_id`` as it is in ``turns``, and ``rest``."""
    return turns.sparkSession.createDataFrame([], f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {rest}").schema


def example_texts(turns: DataFrame, in_order: bool = False, rest: bool = False) -> DataFrame:
    """Every example written out: ``conv_id, example, text, loss_start, loss_end``.

    The context of each example is repeated in full.  A task keeps the text of
    the conversation at hand, one example's size, and what it is about to hand on.  ``in_order`` is for rows
    that ``format_turns`` has just made; rows read back are sorted again.  With ``rest``, a conversation whose last
    turn is no target has one more row: all its turns, without an example's number and span.
    """
    schema = _schema(turns, "example bigint, text string, loss_start bigint, loss_end bigint")
    arrow = to_arrow_schema(schema)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        parts: list[str] = []
        now: object = ()
        over = False                                # turns since the last target
        for conv, segment, example, begin, end in _rows(batches):
            if conv != now:
                if rest and over:
                    yield now, None, "".join(parts), None, None
                now, parts = conv, []
            parts.append(segment)
            over = example is None
            if not over:
                parts = ["".join(parts)]
                yield conv, example, parts[0], begin, end
        if rest and over:
            yield now, None, "".join(parts), None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars = 0
        for row in written(batches):
            held.append(row)
            chars += len(row[2])
            if chars >= SEND_CHARS or len(held) >= SEND_ROWS:
                yield _batch(held, arrow)
                held, chars = [], 0
        if held:
            yield _batch(held, arrow)

    return _in_order(turns, in_order).select("conv_id", "segment", "example", "loss_start", "loss_end").mapInArrow(run, schema)


READ = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint, expanded_chars bigint"


def _send(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, SEND_ROWS)):
        yield _batch(held, schema)


def read_examples(texts: DataFrame) -> DataFrame:
    """What the written examples hold, a row a conversation: see ``read_back``.

    ``texts`` are the rows that ``example_texts`` has just made with ``rest``: a conversation's come one after the other, the
    shortest first.  Each must go on where the one before it ends; what it adds is taken apart into turns.
    """
    schema = _schema(texts, READ)
    arrow = to_arrow_schema(schema)

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now: object = ()
        before = ""
        n = loss_chars = n_examples = expanded = 0
        for conv, example, text, begin, end in _rows(batches, 1):
            if conv != now or not n:
                if n:
                    yield now, n, said.hexdigest(), loss_chars, loss.hexdigest(), len(before), n_examples, expanded
                now, before, n, loss_chars, n_examples, expanded = conv, "", 0, 0, 0, 0
                said, loss = sha256(), sha256()
            if not text.startswith(before):
                raise ValueError(f"example {example} of conversation {conv} doesn't begin with the one before")
            at = len(before)
            while at < len(text):
                turn = NEXT_SEGMENT.match(text, at)
                if turn is None:
                    raise ValueError(f"example {example} of conversation {conv} has no turn at {at}")
                said.update(f"{unescape_role(turn[1])}\n{unescape(turn[2])}\n".encode())
                n, at = n + 1, turn.end()
            if example is not None:
                shown = unescape(text[begin:end])
                loss.update(shown.encode())
                loss_chars += len(shown)
                n_examples += 1
                expanded += len(text)
            before = text
        if n:
            yield now, n, said.hexdigest(), loss_chars, loss.hexdigest(), len(before), n_examples, expanded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _send(conversations(batches), arrow)

    return texts.select("conv_id", "example", "text", "loss_start", "loss_end").mapInArrow(run, schema)


def read_back(turns: DataFrame, in_order: bool = False) -> DataFrame:
    """What the formatted turns and the masks hold, a row a conversation, read from ``segment`` and the spans.

    ``turns_sha256``: of role, line feed, text, line feed of every turn; ``loss_sha256`` and ``loss_chars``: of all text
    under the masks; ``formatted_chars``: code points of the conversation; ``n_examples`` and ``expanded_chars``: the
    examples, and what they would be written out.
    """
    schema = _schema(turns, READ)
    arrow = to_arrow_schema(schema)

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now: object = ()
        n = loss_chars = chars = n_examples = expanded = 0
        for conv, segment, start, begin, end in _rows(batches):
            if conv != now:
                if n:
                    yield now, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars, n_examples, expanded
                now, n, loss_chars, chars, n_examples, expanded = conv, 0, 0, 0, 0, 0
                said, loss = sha256(), sha256()
            role, text = SEGMENT.fullmatch(segment).groups()
            said.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
            n += 1
            chars += len(segment)
            if begin is not None:
                shown = unescape(segment[begin - start: end - start])
                loss.update(shown.encode())
                loss_chars += len(shown)
                n_examples += 1
                expanded += chars
        if n:
            yield now, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars, n_examples, expanded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _send(conversations(batches), arrow)

    return _in_order(turns, in_order).select("conv_id", "segment", "start", "loss_start", "loss_end").mapInArrow(run, schema)


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-1, 0, "user", TRAP), (-1, 1, TARGET, TRAP)], "conv_id bigint, turn bigint, role string, text string")
    return read_examples(example_texts(format_turns(given.unionByName(trap)), in_order=True, rest=True))


ORACLE_OP11 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{TRAP}'), (-1, 1, '{TARGET}', '{TRAP}')),
e AS (SELECT *, len(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) 
             + len(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + {len(START) + len(END) + 2} AS chars FROM c),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = '{TARGET}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{TARGET}'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, count(*) FILTER (role = '{TARGET}')::BIGINT AS n_examples,
  coalesce(sum(upto) FILTER (role = '{TARGET}'), 0)::BIGINT AS expanded_chars
FROM s GROUP BY conv_id
"""
