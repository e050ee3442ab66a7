"""Operator 13: filter interaction audit by the Hart-Mas-Colell potential.

Filters that are applied one after the other share what they remove: which of
them gets a document depends on their order.  In the removal game of a set of
filters, a coalition is worth the documents that at least one of its filters
fails.  Its potential is found from the smaller coalitions'::

    P(nobody) = 0
    P(S) = (worth(S) + sum over i in S of P(S without i)) / |S|

and a filter's Shapley value is P(all) - P(all without it).  With the least
common multiple of 1 .. n as unit all potentials are whole numbers, so nothing
is rounded.  Removals at a step of an order are differences of two coalitions'
worths: no order is run over the documents.

Scale: the texts are read once, for five flags and a digest a row.  Copies are found
by a map-side aggregate over digests and a join with those that occur again
(shuffled at every size; Spark splits a hot digest's rows).  What follows is a
table of at most 2 ** n rows a part; orders are expanded from that.

Defined results: a null text is empty, a null part (language) is an empty
string; a null id is neither smaller nor larger than another, so that its row
fails no copy rule and makes nothing fail; rows of the same id and text don't
make each other fail; a document is good (toxic) if any of its label rows says so;
further columns are left out; no documents, no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import documents, join_rows, once, stash, words

# Thresholds and characters of the five filters' failure conditions.
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
SYMBOLS = "[#$%&*|]"
LETTERS = "ABCDE"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that need the text only; ``text`` must not be null."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    few, repeated = (F.element_at("_counts", i) for i in (1, 2))
    return {"A": few < LEAST_WORDS, "B": 100 * repeated < DISTINCT_PERCENT * few,
            "C": 100 * capitals > CAPITAL_PERCENT * F.length(text), "D": text.rlike(SYMBOLS)}


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row a document: ``doc_id, part, mask``; bit i of ``mask`` is set where filter i fails it."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = once(words(F.col("text")), lambda w: F.array(F.size(w), F.size(F.array_distinct(w))).cast("array<bigint>"))
    base = base.withColumn("_counts", counts)
    failed = text_failures(F.col("text"))
    mask = sum((F.when(failed[c], 1 << i).otherwise(0) for i, c in enumerate(LETTERS[:4])), F.lit(0))
    flat = stash(base.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask")))
    first = flat.filter("doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("_last")).filter("_last > first").drop("_last")
    joined = join_rows(flat, first, ["digest"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return joined.select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def with_labels(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """``marked`` with ``good`` and ``toxic`` (0 or 1) of each document."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    each = labels.filter("doc_id is not null").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    return join_rows(marked, each, ["doc_id"], "left").fillna(0, ["good", "toxic"])


def worths(marked: DataFrame, filters: int) -> DataFrame:
    """One row a part: arrays ``n``, ``good``, ``toxic`` of what each coalition removes (index: its bits), ``alone`` of what
    fails one filter only (index: the filter), and ``total``.

    ``marked`` has ``part, mask, good, toxic``; documents are counted by
    (part, mask) before a coalition is formed.
    """
    counts = marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("_n"), F.sum("good").alias("_good"), F.sum("toxic").alias("_toxic"))
    hit = lambda s, c: F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(c))), F.lit(0)).cast("bigint")
    only = lambda i: F.coalesce(F.sum(F.when(F.col("mask") == 1 << i, F.col("_n"))), F.lit(0)).cast("bigint")
    return counts.groupBy("part").agg(
        F.sum("_n").alias("total"), *[F.array(*[hit(s, f"_{c}") for s in range(1 << filters)]).alias(c) for c in ("n", "good", "toxic")],
        F.array(*[only(i) for i in range(filters)]).alias("alone"))


def potentials(worth: DataFrame, filters: int) -> DataFrame:
    """``worth`` with ``potential``: of each coalition (index: its bits), times ``unit(filters)``.

    Coalitions are taken by their bits, so that the ones a coalition is made
    from come first.
    """
    u = unit(filters)
    without = F.array(*[F.array(*[F.lit(s ^ 1 << i) for i in range(filters) if s >> i & 1]).cast("array<int>") for s in range(1 << filters)])
    below = lambda done, s: F.aggregate(F.get(without, s), F.lit(0).cast("bigint"), lambda total, t: total + F.get(done, t))
    step = lambda done, s: F.concat(done, F.array(F.floor((F.get(F.col("n"), s) * u + below(done, s)) / F.bit_count(s)).cast("bigint")))
    return worth.withColumn("potential", F.aggregate(
        F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("bigint")), step))


def unit(filters: int) -> int:
    """What makes all potentials whole: they are sums of whole numbers over 1 .. ``filters``."""
    return math.lcm(*range(1, filters + 1))


def audit(marked: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """One row per (part, order, step).

    ``marked``: ``part, mask, good, toxic``, with bit i for ``letters[i]`` (one
    character each).  ``shapley`` is the filter's Shapley value times the number of orders.
    """
    k = len(letters)
    table = potentials(worths(marked, k), k)
    steps = table.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)])))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    steps = steps.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    before = F.expr("substring(filter_order, 1, step - 1)")
    steps = steps.withColumn("_before", sum((F.when(F.contains(before, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0)))
    steps = steps.withColumn("_i", F.instr(F.lit("".join(letters)), F.col("filter")) - 1)
    steps = steps.withColumn("_own", F.expr("shiftleft(1, _i)"))
    both = F.col("_before") + F.col("_own")
    gain = lambda c: F.get(F.col(c), both) - F.get(F.col(c), F.col("_before"))
    whole = (1 << k) - 1
    value = F.get(F.col("potential"), F.lit(whole)) - F.get(F.col("potential"), F.lit(whole) - F.col("_own"))
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "filter", (F.col("total") - F.get(F.col("n"), both)).alias("kept"),
        gain("n").alias("removed"), (F.get(F.col("n"), F.col("_own")) - gain("n")).alias("redundant"),
        F.get(F.col("alone"), F.col("_i")).alias("unique_fails"), gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        (value * (math.factorial(k) // unit(k))).alias("shapley"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(documents(spark, sf_dir))
    return audit(with_labels(marked, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("filter")


def _oracle() -> str:
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(LETTERS))
    mask = " | ".join(f"(CASE WHEN {c.lower()} THEN {1 << i} ELSE 0 END)" for i, c in enumerate(LETTERS))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (SELECT doc_id, part, len(ws) < {LEAST_WORDS} AS a, 100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws) AS b,
        100 * (len(text) - len(regexp_replace(text, '[A-Z]', '', 'g'))) > {CAPITAL_PERCENT} * len(text) AS c,
        regexp_matches(text, '{SYMBOLS}') AS d, coalesce(doc_id > least, false) AS e FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, {mask} AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
o AS (SELECT col0 AS filter_order, step, (1 << (ascii(substring(col0, step, 1)) - 65)) AS own,
        list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substring(col0, i, 1)) - 65)))::BIGINT AS prior
      FROM (VALUES {orders}) v(col0), (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own,
        sum(CASE WHEN mask & (own | coalesce(prior, 0)) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & own > 0 AND mask & coalesce(prior, 0) = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & own > 0 AND mask & coalesce(prior, 0) > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & own > 0 AND mask & coalesce(prior, 0) = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & own > 0 AND mask & coalesce(prior, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM m, o GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""


ORACLE_OP13 = _oracle()
