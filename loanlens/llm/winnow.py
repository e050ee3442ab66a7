"""Operator 9: document fingerprints by winnowing.

A text's words (A-Z in lower case) are hashed, the hashes of ``GRAM`` = 5
words roll over the text, and of every ``WINDOW`` = 16 neighbouring grams the
smallest is selected, the rightmost on ties, with its word position.  Two texts
that share a run of ``GRAM + WINDOW - 1`` = 20 words share a selected gram.
Rolling hashes and window minima are both made by doubling (spans of 1, 2, 4,
... from two overlapping halves), so the work is linear in the text's length
and stays in built-in array functions.

Defined results: a null text counts as empty and has an empty fingerprint; a
text with fewer words than a gram has one gram, its whole word sequence; one
with fewer grams than a window has one window.  Positions have 26 bits (67
million words).  Two empty fingerprints have likeness 1.0, an empty and another
0.0.  Repeated rows get a result each; equal texts get equal fingerprints.
Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.llm.common import ascii_lower, documents, once, words

GRAM = 5
WINDOW = 16
PLACE = (1 << 26) - 1        # bits of a packed value that hold the position, counted from the far end


def _pairs(by: int, join):
    """Array of ``join(x[i], x[i + by])`` of an array."""
    def made(x: Column) -> Column:
        n = F.greatest(F.size(x) - by, F.lit(0))
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(by + 1), n), join)
    return made


def _grams(hashes: Column) -> Column:
    """Hashes of all runs of 5 words: 1 -> 2 -> 4 -> 5."""
    mix = lambda a, b: F.xxhash64(a, b)

    def five(one: Column) -> Column:
        four = once(once(one, _pairs(1, mix)), _pairs(2, mix))

        def last(h: Column) -> Column:
            n = F.greatest(F.size(h) - 1, F.lit(0))
            return F.zip_with(F.slice(h, F.lit(1), n), F.slice(one, F.lit(5), n), mix)
        return once(four, last)
    return once(hashes, five)


def _selected(grams: Column) -> Column:
    """``[{hash, pos}]`` of the window minima, in order of position."""
    def packed(g: Column) -> Column:
        return F.transform(g, lambda h, i: h.bitwiseAND(F.lit(~PLACE)).bitwiseOR((F.lit(PLACE) - i).cast("bigint")))

    def minima(p: Column) -> Column:
        out = p
        for by in (1, 2, 4, 8):
            out = once(out, _pairs(by, lambda a, b: F.least(a, b)))
        return F.when(F.size(p) < WINDOW, F.array(F.array_min(p))).otherwise(out)

    def placed(g: Column) -> Column:
        at = F.array_distinct(F.transform(once(packed(g), minima), lambda m: F.lit(PLACE) - m.bitwiseAND(F.lit(PLACE))))
        return F.transform(at, lambda p: F.struct(F.get(g, p.cast("int")).alias("hash"), p.cast("int").alias("pos")))
    return once(grams, placed)


def fingerprint(text: Column) -> Column:
    """``array<struct<hash bigint, pos int>>`` of a text."""
    def of(w: Column) -> Column:
        short = F.array(F.struct(F.xxhash64(F.concat_ws(" ", w)).alias("hash"), F.lit(0).alias("pos")))
        none = F.filter(short, lambda _: F.lit(False))
        return (F.when(F.size(w) == 0, none).when(F.size(w) < GRAM, short)
                .otherwise(_selected(_grams(F.transform(w, lambda x: F.xxhash64(x))))))
    return once(words(ascii_lower(F.coalesce(text, F.lit("")))), of)


def as_string(print_: Column) -> Column:
    """``hash:position`` (hexadecimal, decimal) of each selected gram, comma-joined."""
    return F.concat_ws(",", F.transform(print_, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit(":"), x["pos"].cast("string"))))


def hash_set(print_: Column) -> Column:
    return F.array_distinct(F.transform(print_, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two hash sets (Jaccard)."""
    def over(both: Column) -> Column:
        union = F.size(a) + F.size(b) - both
        return F.when(union == 0, F.lit(1.0)).otherwise(both / union)
    return once(F.size(F.array_intersect(a, b)), over)


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``doc_id, text`` with ``next_text`` and ``prints, next_prints`` (the fingerprints).

    The next document is the following one by descending id (null last, ties
    by a hash of the text); after the last comes the first.  Ids are cut into
    ranges at approximate quantiles; a window runs inside each range, and the
    first document of every range is copied to the end of the one before, so
    that no order of all rows is needed.  Only the cuts and one id a range
    (both bounded by the number of ranges) go through the driver.  The texts
    are shuffled once.
    """
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id", F.xxhash64("text").alias("_tie"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))

    step = max(1, math.isqrt(len(cuts)))
    every, coarse = (F.lit(x) if x else F.array().cast("array<bigint>") for x in (cuts, cuts[::step]))

    def range_of(c: Column) -> Column:
        # number of cuts up to the id: first among every step-th cut, then among those that follow
        below = lambda arr: F.size(F.filter(arr, lambda x: x <= c))
        found = once(below(coarse), lambda k: F.when(k == 0, F.lit(0)).otherwise(
            (k - 1) * step + below(F.slice(every, F.greatest(k - 1, F.lit(0)) * step + 1, F.lit(step)))))
        return F.when(c.isNull(), 0).otherwise(1 + found)

    firsts = (ids.withColumn("_range", range_of(F.col("doc_id"))).groupBy("_range")
              .agg(F.max(F.struct("doc_id", "_tie")).alias("_m")).select("_range", "_m.doc_id", "_m._tie").collect())
    firsts.sort(key=lambda r: -r["_range"])
    # the range above takes a copy of this range's first document; the lowest takes the very first
    copies = [(r["doc_id"], r["_tie"], firsts[i - 1]["_range"]) for i, r in enumerate(firsts)]
    copies = spark.createDataFrame(copies, f"_id {docs.schema['doc_id'].dataType.simpleString()}, _t bigint, _to int")
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"), range_of(F.col("doc_id")).alias("_range"))
    more = own.join(F.broadcast(copies), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_t")))
    more = more.select("doc_id", "text", "_tie", F.col("_to").alias("_range"), F.lit(True).alias("_copy"))
    both = own.withColumn("_copy", F.lit(False)).unionByName(more)
    both = both.repartition(n, "_range").withColumn("prints", fingerprint(F.col("text")))
    w = Window.partitionBy("_range").orderBy("_copy", F.col("doc_id").desc_nulls_last(), F.col("_tie").desc())
    out = both.withColumn("next_text", F.lead("text").over(w)).withColumn("next_prints", F.lead("prints").over(w))
    return out.filter(~F.col("_copy")).select("doc_id", "text", "next_text", "prints", "next_prints")


def edit_and_compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pair = with_next(named).withColumn("n_chars", F.length("text").cast("long"))
    k = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - k), F.substr("next_text", F.lit(1), k))
    pair = pair.withColumn("_edited", edited).withColumn("_eprints", fingerprint(F.col("_edited")))
    return pair.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        as_string(F.col("prints")).alias("fingerprint"), as_string(F.col("_eprints")).alias("edited_fingerprint"),
        likeness(hash_set(F.col("prints")), hash_set(F.col("_eprints"))).alias("near_edited"),
        likeness(hash_set(F.col("prints")), hash_set(F.col("next_prints"))).alias("near_next"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_and_compare(documents(spark, sf_dir))
