"""Operator 2: mix sources to target weights by Pareto order sampling.

Every source has a target number of words.  ``target / size`` is the mean
number of copies of its documents: the whole part is allocated to every
document for certain, the rest is an unequal-probability sample of fixed size
(in words).  The sample is drawn in Pareto order: a document with uniform
random number ``u`` and inclusion probability ``p`` gets the rank variable
``(u / (1 - u)) / (p / (1 - p))``, and the smallest are taken until the
source's remaining words are filled; the document at the edge is taken if
that brings the sum nearer to the target.

``p`` leans towards longer documents: with the rest ``f`` it is
``f * (1 + tilt * (1 - f) * t)``, where ``t`` in [-1, 1] is the document's
log size around the word-weighted mean of its source, so that the expected
words are exactly ``f`` of the source's and ``0 < p < 1``.

Scale: one pass over the texts leaves a narrow table (id, source, size, u).
A source's order is found by counting words in ``bins`` slices of the rank
variable (map-side sums); only the slice at the edge is sorted, so that a
source with a third of all rows is never sorted in one task.

Defined results: a null source is a source of its own and comes last; a null
or blank text has size 0 and takes nothing; repeated rows are documents of
their own and repeat in the result; equal rank variables are put in the order
of id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.llm.common import OWN, documents, join_rows, join_small, shielded, stash, words

SEED = "mix-1"
MAX_REPEAT = 3.0
WEIGHTS = (1.0, 2.0, 3.0)
TILT = 0.5
BINS = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """One row per source: ``source, source_size, target`` from rows ``source, size``.

    ``weights`` repeat over the sources in code point order (null last).  The
    words of all sources are shared by weight; a target stops at
    ``max_repeat`` times its source's size, and the excess is shared anew.
    In ascending order of cap to weight, a source is at its cap as long as
    the share that the sources before it leave would exceed the cap; the
    first that isn't gives the level for all others.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(order, F.lit(n)) + 1))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, from_here = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    per = per.withColumn("_level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                         / F.sum("_w").over(from_here))
    per = per.withColumn("_capped", F.col("_cap") < F.col("_level") * F.col("_w"))
    per = per.withColumn("_free", F.min(F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(whole))
    return per.select("source", "source_size",
                      F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_free._level") * F.col("_w")).alias("target"))


def uniform(id_col: str, text_col: str, seed: str):
    """52 random bits from id and text: reruns agree, whatever the partitioning."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                seed: str = SEED, weights=WEIGHTS, max_repeat: float = MAX_REPEAT,
                tilt: float = TILT, bins: int = BINS) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken, u``, a row for each document."""
    u = uniform(id_col, text_col, seed)
    base = stash(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                             F.size(words(F.col(text_col))).cast("long").alias("size"), u.alias("u")))
    targets = source_targets(base, weights, max_repeat)
    g = F.log1p(F.col("size"))
    # sums of whole numbers: the same in any order
    lean = base.groupBy("source").agg(
        F.sum(F.col("size") * F.round(g * 1e6).cast("long")).alias("_sg"), F.min(g).alias("_gmin"), F.max(g).alias("_gmax"))
    per = targets.join(lean.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rho = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mean = F.when(F.col("source_size") > 0, F.col("_sg") / 1e6 / F.col("source_size")).otherwise(F.lit(0.0))
    per = stash(per.select("source", "source_size", "target", F.floor(rho).alias("_whole"), (rho - F.floor(rho)).alias("_f"),
                           mean.alias("_mean"), F.greatest(F.col("_gmax") - mean, mean - F.col("_gmin")).alias("_reach")))

    drawn = join_small(base, per, ["source"])
    t = F.when(F.col("_reach") > 0, (g - F.col("_mean")) / F.col("_reach")).otherwise(F.lit(0.0))
    p = F.col("_f") * (1 + F.lit(tilt) * (1 - F.col("_f")) * t)
    rank = (F.col("u") / (1 - F.col("u"))) * (1 - p) / F.when(p > 0, p)       # null: nothing left to draw
    drawn = drawn.withColumn("_q", rank / (1 + rank)).withColumn(
        "_bin", F.least(F.floor(F.col("_q") * bins), F.lit(bins - 1)).cast("int"))
    # the slice of each source's order in which its remaining words are filled
    slices = drawn.filter("_bin is not null").groupBy("source", "_bin").agg(F.sum("size").alias("_words"))
    up_to = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.withColumn("_upto", F.sum("_words").over(up_to))
    slices = join_small(slices, per.select("source", "source_size", "_f"), ["source"])
    edge = stash(slices.filter(F.col("_upto") >= F.col("_f") * F.col("source_size")).groupBy("source").agg(
        F.min("_bin").alias("_edge"), F.min(F.col("_upto") - F.col("_words")).alias("_before")))
    drawn = join_small(drawn, edge, ["source"], "left")
    in_edge = F.col("_bin") == F.col("_edge")
    within = Window.partitionBy("source", "_bin").orderBy("_q", F.col("doc_id").asc_nulls_last(), "u", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    keep = ["doc_id", "source", "size", "source_size", "target", "u"]
    at = drawn.filter(in_edge).withColumn("_cum", F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    at = at.select(*keep, (F.col("_whole") + F.when(
        F.col("_cum") + F.col("size") / 2 <= F.col("_f") * F.col("source_size"), 1).otherwise(0)).alias("copies"))
    rest = drawn.filter(~F.coalesce(in_edge, F.lit(False))).select(*keep, (F.col("_whole") + F.when(
        F.col("_bin") < F.coalesce(F.col("_edge"), F.lit(bins)), 1).otherwise(0)).alias("copies"))
    return rest.unionByName(at).withColumn("taken", F.col("copies") * F.col("size"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def materialise_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    seed: str = SEED) -> DataFrame:
    """The mixed corpus: every document as often as it was taken, with all its columns.

    Documents that the mix takes nothing of go.  Equal rows of one id, text
    and source share their copies.
    """
    return shielded(docs, lambda d: _materialise(d, id_col, text_col, source_col, seed), {*OWN, id_col, text_col, source_col})


def _materialise(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    taken = mix_sources(docs, id_col, text_col, source_col, seed).groupBy("doc_id", "source", "u").agg(
        F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    taken = stash(taken.filter("_copies > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("u").alias("_u"),
                                                     "_copies", "_rows"))
    keyed = docs.withColumns({"_d": F.col(id_col), "_s": F.col(source_col), "_u": uniform(id_col, text_col, seed)})
    out = join_rows(keyed, taken, ["_d", "_s", "_u"])
    if taken.filter("_rows > 1").limit(1).count():
        out = out.filter("_rows = 1").unionByName(out.filter("_rows > 1").dropDuplicates(["_d", "_s", "_u"]))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


ORACLE_OP2 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE)
      / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * round(ln(1.0::DOUBLE + size) * 1e6)::BIGINT)::DOUBLE / 1e6 AS sg,
        min(ln(1.0::DOUBLE + size)) AS gmin, max(ln(1.0::DOUBLE + size)) AS gmax,
        1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
l AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
        (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY source_size / w, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s),
m AS (SELECT *, cap < lev * w AS capped FROM l),
v AS (SELECT min_by(lev, cap / w) AS free FROM m WHERE NOT capped),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE free * w END AS target, sg, gmin, gmax FROM m LEFT JOIN v ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rho,
        CASE WHEN source_size > 0 THEN sg / source_size ELSE 0 END AS mu FROM t),
f AS (SELECT *, floor(rho)::BIGINT AS whole, rho - floor(rho) AS f, greatest(gmax - mu, mu - gmin) AS reach FROM r),
p AS (SELECT d.doc_id, d.size, d.u, f.*, f.f * (1 + 0.5::DOUBLE * (1 - f.f) * CASE WHEN reach > 0 THEN (ln(1.0::DOUBLE + size) - mu) / reach ELSE 0 END) AS p
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) * (1 - p) / p END AS q FROM p),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q / (1 + q), doc_id NULLS LAST, u, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM q)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN q IS NOT NULL AND cum + size / 2 <= f * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
