"""Population stability and monitoring (inventory 2.J, D17, D18, C3, C7, G3, G4).

PSI compares a baseline ("expected") and a comparison ("actual")
distribution over bins fixed on the baseline:

* continuous: exact baseline quantile edges at 0, 1/bins, ..., 1, duplicate
  edges merged, outer edges at +-inf, bins right-closed; fewer than three
  distinct edges -> PSI 0.  Optionally NULLs form a "Missing" bin.
* categorical: the value as text, NULL -> "Missing", comparison values never
  seen in the baseline -> "Other".

Shares are bin counts over the population size (NULLs included), floored at
1e-4; PSI = sum((a - e) * ln(a / e)).  Everything runs as grouped
aggregates keyed by (comparison, feature, bin): one pass for all features and
all comparisons, no per-feature loop and no collected value lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.scalar import psi_status, quarter_label
from loanlens.operators.ordered import count_quantiles, exact_quantiles, join_checked
from loanlens.session import materialize

# PSI share floor, bin labels and the rule thresholds.
SHARE_FLOOR = 0.0001
MISSING, OTHER = "Missing", "Other"
QUALITY_INVALID_MAX = 0.01
QUALITY_MISSING_MAX = 0.02


def _score_bins(narrow: DataFrame, baseline: Column, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of a stored score table by ``keys``, side and bin: ``keys, _base, _bin, _flat, _n, _scored, _score, _labelled, _bad``.

    ``narrow`` has ``keys``, ``score`` and ``label`` (doubles); edges are quantiles of the rows where
    ``baseline`` holds.  Two reads of the narrow table: the baseline's scores for
    the edges, all rows for the counts.  A score without a value has no bin.
    """
    q = exact_quantiles(narrow.filter(baseline), "score", [i / bins for i in range(bins + 1)], [], out_prefix="_q")
    unique = F.array_distinct(F.array(*[F.col(f"_q{i}") for i in range(bins + 1)]))
    edges = q.select(unique.alias("_u")).select(F.when(F.size("_u") >= 3, F.slice("_u", 2, F.size("_u") - 2)).alias("_inner"))
    v = F.col("score")
    has = v.isNotNull() & ~F.isnan(v)
    binned = narrow.join(F.broadcast(edges), F.lit(True), "left").select(          # one row, or none without a baseline score
        *keys, F.coalesce(baseline, F.lit(False)).alias("_base"), F.col("_inner").isNull().alias("_flat"), "score", "label",
        F.when(has, F.size(F.filter("_inner", lambda e: e < v))).alias("_bin"))
    return materialize(binned.groupBy(*keys, "_base", "_bin", "_flat").agg(
        F.count(F.lit(1)).alias("_n"), F.count("score").alias("_scored"), F.sum("score").alias("_score"),
        F.count("label").alias("_labelled"), F.sum("label").alias("_bad")))


def _psi_of_sides(sides: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, psi`` from ``keys, _bin, _flat, _ne, _na`` (counts of either side; rows without a bin count in the totals only).

    Fewer than three distinct edges, or no baseline: PSI is 0.
    """
    totals = sides.groupBy(*keys).agg(F.sum("_ne").alias("_tot_e"), F.sum("_na").alias("_tot_a"), F.max("_flat").alias("_flat"))
    shares = sides.filter("_bin is not null").drop("_flat")
    joined = join_checked(shares, totals, keys)
    psi = _shares_psi(joined, keys)
    out = join_checked(totals, materialize(psi), keys, "left")
    return out.select(*keys, F.when(F.col("_flat"), F.lit(0.0)).otherwise(F.coalesce("psi", F.lit(0.0))).alias("psi"))


def psi_between(scores: DataFrame, baseline: Column, value: str, bins: int = 10) -> DataFrame:
    """Score PSI of the other rows against those where ``baseline`` holds (J1, J6): one row; ``scores`` is read once."""
    narrow = materialize(scores.select(F.coalesce(baseline, F.lit(False)).alias("base"), F.col(value).cast("double").alias("score"),
                                       F.lit(None).cast("double").alias("label")))
    counts = _score_bins(narrow, F.col("base"), bins)
    mine = lambda side: F.sum(F.when(F.col("_base") == side, F.col("_n")).otherwise(0))
    return _psi_of_sides(counts.groupBy("_bin").agg(F.max("_flat").alias("_flat"), mine(True).alias("_ne"), mine(False).alias("_na")), [])


def population_stability_index(expected: DataFrame, actual: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Score PSI between two populations (J1, J6): one row with ``psi``; either is read once."""
    both = expected.select(F.lit(True).alias("base"), value).unionByName(actual.select(F.lit(False).alias("base"), value))
    return psi_between(both, F.col("base"), value, bins)


# -- J5 / D18: cohort score monitoring -----------------------------------------

def monitoring_table(scores: DataFrame, score: str, label: str, date_col: str, bins: int = 10) -> DataFrame:
    """Per quarter cohort: size, bad rate, mean score, PSI against the first cohort,
    status (J5, D18, F7).  The baseline cohort is found as data (min cohort).

    ``scores`` is read once, into a stored table of three columns; levels and
    PSI come from one aggregate over it by (cohort, bin).
    """
    narrow = materialize(scores.select(quarter_label(date_col).alias("cohort"), F.col(score).cast("double").alias("score"),
                                       F.col(label).cast("double").alias("label")))
    first = narrow.agg(F.when(F.min("cohort") == F.max("cohort"), F.raise_error(F.lit(
        "cohort monitoring needs scores of two quarters at least"))).otherwise(F.min("cohort")).cast("string").alias("_first"))
    counts = _score_bins(narrow.join(F.broadcast(first), F.lit(True)), F.col("cohort") == F.col("_first"), bins, ["cohort"])   # one row
    counts = counts.filter("cohort is not null")
    return monitoring_from_counts(counts, counts.filter("_base").select("_bin", F.col("_n").alias("_ne")), "_flat")


def monitoring_from_counts(counts: DataFrame, base: DataFrame, flat: Column | str) -> DataFrame:
    """The monitoring table from counts by (cohort, bin), whose batches may be many, and the baseline's ``_bin, _ne``."""
    counts = counts.groupBy("cohort", "_bin").agg(
        *[F.sum(c).alias(c) for c in ("_n", "_scored", "_score", "_labelled", "_bad")],
        F.max(F.col(flat) if isinstance(flat, str) else flat).alias("_flat"))
    cohorts = counts.groupBy("cohort").agg(F.max("_flat").alias("_flat"))
    # every bin of the baseline, and every bin of the cohort: a few rows a cohort
    sides = (cohorts.join(F.broadcast(base), F.lit(True)).select("cohort", "_bin", "_flat", "_ne", F.lit(0).cast("long").alias("_na"))
             .unionByName(counts.select("cohort", "_bin", "_flat", F.lit(0).cast("long").alias("_ne"), F.col("_n").alias("_na"))))
    sides = sides.groupBy("cohort", "_bin").agg(F.max("_flat").alias("_flat"), F.sum("_ne").alias("_ne"), F.sum("_na").alias("_na"))
    level = counts.groupBy("cohort").agg(
        F.sum("_n").alias("sample_count"), F.try_divide(F.sum("_bad"), F.sum("_labelled")).alias("bad_rate"),
        F.try_divide(F.sum("_score"), F.sum("_scored")).alias("average_score"))
    out = level.join(_psi_of_sides(sides, ["cohort"]), "cohort").withColumnRenamed("psi", "score_psi_vs_baseline")
    return out.withColumn("psi_status", psi_status("score_psi_vs_baseline"))


# -- C3 / J4: feature stability -------------------------------------------------

# Monitored feature lists.
CONTINUOUS_FEATURES = ["borrower_credit_score", "original_ltv", "original_dti", "original_upb",
                       "hist_upb_to_original_upb"]
CATEGORICAL_FEATURES = ["hist_max_dpd", "hist_30dpd_months", "loan_purpose", "property_type",
                        "occupancy_status", "property_state"]


def split_by_ids(data: DataFrame, ids: DataFrame, key: str = "loan_id") -> tuple[DataFrame, DataFrame]:
    """(rows not in ids, rows in ids): anti / semi joins, NULL-safe unlike NOT IN."""
    ids = ids.select(key).distinct()
    return data.join(ids, key, "left_anti"), data.join(ids, key, "left_semi")


def _stack(df: DataFrame, features: list[str], cast: str, extra: list[str]) -> DataFrame:
    expr = ", ".join(f"'{f}', CAST(`{f}` AS {cast})" for f in features)
    return df.selectExpr(*extra, f"stack({len(features)}, {expr}) AS (feature, value)")


def _shares_psi(bins: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, psi`` from counts of both sides in each bin: ``keys, _bin, _ne, _na``, with totals ``_tot_e, _tot_a``."""
    e = F.greatest(F.col("_ne").cast("double") / F.col("_tot_e"), F.lit(SHARE_FLOOR))
    a = F.greatest(F.col("_na").cast("double") / F.col("_tot_a"), F.lit(SHARE_FLOOR))
    return bins.groupBy(*keys).agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))


def feature_stability(snapshot: DataFrame, oot_ids: DataFrame, date_col: str = "observation_date",
                      key: str = "loan_id", bins: int = 10) -> DataFrame:
    """Train-vs-OOT and first-vs-last OOT cohort PSI for every monitored feature.

    Comparison names are built from the data: ``Train vs OOT`` and
    ``<first cohort> vs <last cohort>``; fewer than two OOT cohorts are an
    error.  The snapshot is read once: each loan is flagged with the sides it
    is on, its features are stacked, and one aggregate counts every distinct
    value on either side of every comparison.  Totals, missing rates, baseline
    edges, bins and PSI all come from that table of counts.
    """
    keys = ["comparison", "feature", "feature_type"]
    marked = snapshot.join(oot_ids.select(key).distinct().withColumn("_oot", F.lit(True)), key, "left").select(
        F.col("_oot").isNotNull().alias("_oot"), quarter_label(date_col).alias("_cohort"), *CONTINUOUS_FEATURES, *CATEGORICAL_FEATURES)
    marked = materialize(marked)
    span = marked.filter("_oot").agg(F.min("_cohort").alias("_first"), F.max("_cohort").alias("_last")).select(
        "_first", F.when(F.col("_first") == F.col("_last"), F.raise_error(F.lit(
            "feature stability needs out-of-time loans of two quarters at least"))).otherwise(F.col("_last")).cast("string").alias("_last"))
    both = marked.crossJoin(F.broadcast(span))      # one row
    whole, ends = F.lit("Train vs OOT"), F.concat_ws(" vs ", "_first", "_last")
    on = lambda name, expected: F.struct(name.alias("comparison"), F.lit(int(expected)).alias("e"), F.lit(int(not expected)).alias("a"))
    sides = F.filter(F.array(
        F.when(~F.col("_oot"), on(whole, True)).otherwise(on(whole, False)),
        F.when(F.col("_oot") & (F.col("_cohort") == F.col("_first")), on(ends, True)),
        F.when(F.col("_oot") & (F.col("_cohort") == F.col("_last")), on(ends, False))), lambda x: x.isNotNull())
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    values = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.lit("continuous").alias("feature_type"), number(c).alias("x"), F.lit(None).cast("string").alias("t"))
          for c in CONTINUOUS_FEATURES],
        *[F.struct(F.lit(c).alias("feature"), F.lit("categorical").alias("feature_type"), F.lit(None).cast("double").alias("x"),
                   F.col(c).cast("string").alias("t")) for c in CATEGORICAL_FEATURES])
    stacked = both.select(F.explode(sides).alias("s"), values.alias("v")).select("s.*", F.explode("v").alias("v")).select("comparison", "e", "a", "v.*")
    counts = materialize(stacked.groupBy(*keys, "x", "t").agg(F.sum("e").alias("_e"), F.sum("a").alias("_a")))

    missing = F.col("x").isNull() & F.col("t").isNull()
    totals = materialize(counts.groupBy(*keys).agg(
        F.sum("_e").alias("_tot_e"), F.sum("_a").alias("_tot_a"),
        F.sum(F.when(missing, F.col("_e")).otherwise(0)).alias("_miss_e"), F.sum(F.when(missing, F.col("_a")).otherwise(0)).alias("_miss_a")))
    seen = counts.filter("x is not null and _e > 0")
    q = count_quantiles(seen, "x", "_e", [i / bins for i in range(bins + 1)], keys, out_prefix="_q")
    edges = q.select(*keys, F.array_distinct(F.array(*[F.col(f"_q{i}") for i in range(bins + 1)])).alias("_u"))
    edges = materialize(edges.filter(F.size("_u") >= 3).select(*keys, F.slice("_u", 2, F.size("_u") - 2).alias("_inner")))
    binned = join_checked(counts, edges, keys, "left").withColumn("_bin", F.when(missing, F.lit(MISSING)).when(
        F.col("feature_type") == "categorical", F.when(F.col("_e") > 0, F.col("t")).otherwise(F.lit(OTHER))).otherwise(
        F.size(F.filter("_inner", lambda edge: edge < F.col("x"))).cast("string")))
    # a continuous feature without inner edges has one bin: PSI 0
    flat = (F.col("feature_type") == "continuous") & F.col("_inner").isNull()
    binned = binned.filter(~flat).groupBy(*keys, "_bin").agg(F.sum("_e").alias("_ne"), F.sum("_a").alias("_na"))
    psi = _shares_psi(join_checked(binned, totals, keys), keys)
    out = totals.join(psi, keys, "left").filter("_tot_e > 0 and _tot_a > 0").withColumn("psi", F.coalesce("psi", F.lit(0.0)))
    out = (out.withColumn("baseline_missing_rate", F.col("_miss_e") / F.col("_tot_e"))
              .withColumn("comparison_missing_rate", F.col("_miss_a") / F.col("_tot_a")))
    return (out.withColumn("psi_status", psi_status("psi"))
               .withColumn("missing_rate_change", F.col("comparison_missing_rate") - F.col("baseline_missing_rate"))
               .select("comparison", "feature", "feature_type", "psi", "baseline_missing_rate",
                       "comparison_missing_rate", "psi_status", "missing_rate_change"))


# -- D17: domain-rule data quality --------------------------------------------

# Quality rules (feature, minimum, maximum); NULL maximum = no bound.
QUALITY_RULES = [
    ("borrower_credit_score", 300.0, 850.0),
    ("original_ltv", 0.0, 100.0),
    ("original_dti", 0.0, 65.0),
    ("original_upb", 0.0, None),
    ("hist_upb_to_original_upb", 0.0, 1.20),
]


def quality_rules(spark) -> DataFrame:
    return spark.createDataFrame(QUALITY_RULES, "feature string, minimum double, maximum double")


def data_quality(snapshot: DataFrame, oot_ids: DataFrame, key: str = "loan_id") -> DataFrame:
    """Missing and out-of-domain rates per population x rule.

    Invalid = present and outside [min, max]; alert when invalid > 1% or
    missing > 2% (strict)."""
    feats = [r[0] for r in QUALITY_RULES]
    # each loan is flagged once; a NULL id is in no list, so it is on the training side
    side = F.when(F.col("_oot"), "oot").otherwise("train").alias("population")
    flagged = snapshot.select(key, *feats).join(oot_ids.select(key).distinct().withColumn("_oot", F.lit(True)), key, "left")
    pops = _stack(flagged.select(side, *feats), feats, "DOUBLE", ["population"])
    rules = F.broadcast(quality_rules(snapshot.sparkSession))    # 5 rows
    j = pops.join(rules, "feature", "inner")
    v = F.col("value")
    invalid = v.isNotNull() & ((v < F.col("minimum")) | (F.col("maximum").isNotNull() & (v > F.col("maximum"))))
    out = j.groupBy("population", "feature").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(F.when(v.isNull(), 1.0).otherwise(0.0)).alias("missing_rate"),
        F.avg(F.when(invalid, 1.0).otherwise(0.0)).alias("invalid_rate"))
    status = F.when((F.col("invalid_rate") > QUALITY_INVALID_MAX) | (F.col("missing_rate") > QUALITY_MISSING_MAX),
                    F.lit("alert")).otherwise(F.lit("stable"))
    return out.withColumn("quality_status", status)
