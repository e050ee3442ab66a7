"""Evaluation metrics (inventory 2.I and the ranking parts of 2.F).

All metrics are computed from one table of distinct scores with bad / good
counts and their running sums in descending score order (``score_points``),
which is built with the bucketed prefix helper -- never a single-partition
window.  Rates are formed from integer counts, so AUC, KS and average
precision are exact and tie-grouped the way a ROC curve groups equal scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.functions.scalar import quarter_label
from loanlens.operators.ordered import exact_quantiles, join_checked, prefix_sums, row_ranks
from loanlens.session import materialize


def score_points(df: DataFrame, label: str, score: str, groups: Sequence[str] = (), following: Sequence[str] = ()) -> DataFrame:
    """Distinct scores per group with ``bad``, ``good`` and descending running sums
    ``cum_bad``, ``cum_good`` (ROC points, F3), plus group totals ``n_bad``, ``n_good``
    and ``next_*`` of the ``following`` columns."""
    groups = list(groups)
    y = F.col(label).cast("long")
    pts = (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
             .groupBy(*groups, F.col(score).cast("double").alias("score"))
             .agg(F.sum(y).alias("bad"), F.sum(F.lit(1) - y).alias("good")))
    pts = prefix_sums(pts, "score", ["bad", "good"], groups, descending=True, total="n_", following=following)
    return pts


def binary_metrics(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """AUC, KS, average precision and Brier score per group."""
    groups = list(groups)
    pts = score_points(df, label, score, groups)
    nb, ng = F.col("n_bad").cast("double"), F.col("n_good").cast("double")
    cb, cg = F.col("cum_bad").cast("double"), F.col("cum_good").cast("double")
    bad, good = F.col("bad").cast("double"), F.col("good").cast("double")
    off, on = F.col("score"), F.col("score") - 1.0
    agg = pts.groupBy(*groups).agg(
        F.sum(good * (cb - bad / 2.0)).alias("_auc_num"),
        F.max(F.col("cum_bad") * F.col("n_good") - F.col("cum_good") * F.col("n_bad")).alias("_ks_num"),
        F.sum(bad * cb / (cb + cg)).alias("_ap_num"),
        F.max("n_bad").alias("n_bad"), F.max("n_good").alias("n_good"),
        F.sum(bad * on * on + good * off * off).alias("_brier_num"), F.sum(F.col("bad") + F.col("good")).alias("_rows"),
    )
    return agg.select(
        *groups,
        F.try_divide(F.col("_auc_num"), nb * ng).alias("auc"),
        F.try_divide(F.greatest(F.col("_ks_num"), F.lit(0)).cast("double"), nb * ng).alias("ks"),
        F.try_divide(F.col("_ap_num"), nb).alias("pr_auc"),
        F.try_divide(F.col("_brier_num"), F.col("_rows").cast("double")).alias("brier_score"),
        F.coalesce("_rows", F.lit(0)).cast("long").alias("sample_count"),
    )


def ks_with_threshold(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """KS and the score where it is first reached in descending order (I4).

    When the maximum is the (0, 0) start point the threshold is +inf."""
    groups = list(groups)
    pts = score_points(df, label, score, groups)
    diff = F.col("cum_bad") * F.col("n_good") - F.col("cum_good") * F.col("n_bad")
    best = pts.groupBy(*groups).agg(
        F.max(diff).alias("_d"),
        F.max_by(F.col("score"), F.struct(diff, F.col("score"))).alias("_s"),
        F.first("n_bad").alias("n_bad"), F.first("n_good").alias("n_good"))
    nbng = F.col("n_bad").cast("double") * F.col("n_good").cast("double")
    return best.select(
        *groups,
        F.try_divide(F.greatest(F.col("_d"), F.lit(0)).cast("double"), nbng).alias("ks"),
        F.when(F.col("_d") > 0, F.col("_s")).otherwise(F.lit(float("inf"))).alias("ks_threshold"),
    )


def roc_curve(df: DataFrame, label: str, score: str, groups: Sequence[str] = (),
              drop_intermediate: bool = True) -> DataFrame:
    """ROC points (I1, I12): ``threshold, fpr, tpr, ks_gap`` with the (0, 0) start
    point at threshold +inf.  With ``drop_intermediate`` a point is dropped when
    its bad/good increments equal those of the next point (collinear run),
    keeping the first and last points."""
    groups = list(groups)
    pts = score_points(df, label, score, groups, ["bad", "good"] if drop_intermediate else [])
    if drop_intermediate:
        last = F.col("next_bad").isNull()
        same = (F.col("next_bad") == F.col("bad")) & (F.col("next_good") == F.col("good"))
        pts = pts.filter((F.col("cum_rows") == 1) | last | ~same)
    pts = pts.select(
        *groups, F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_good").cast("double"), F.col("n_good").cast("double")).alias("fpr"),
        F.try_divide(F.col("cum_bad").cast("double"), F.col("n_bad").cast("double")).alias("tpr"))
    start_src = pts.select(*groups).distinct() if groups else df.sparkSession.range(1).select()
    start = start_src.select(*groups, F.lit(float("inf")).alias("threshold"),
                             F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    out = start.unionByName(pts)
    return out.withColumn("ks_gap", F.col("tpr") - F.col("fpr"))


# -- F1 / F2 / I7: rank-based equal-frequency deciles --------------------------

def rank_bins(df: DataFrame, score: str, id_col: str, q: int = 10, groups: Sequence[str] = (),
              out: str = "decile") -> DataFrame:
    """Equal-frequency bins on ranks (``qcut(rank(method='first'), q)``), 1..q (F1).

    Rank ties are broken by ``id_col``.  Rank r of n goes to bin
    ``max(1, ceil((r - 1) * q / (n - 1)))``, evaluated in integers."""
    groups = list(groups)
    ranked = row_ranks(df, score, id_col, groups, out="_rank")
    n = materialize(df.filter(F.col(score).isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")))
    ranked = join_checked(ranked, n, groups, "left")
    r, nn = F.col("_rank"), F.col("_n")
    num = (r - 1) * q
    den = nn - 1
    b = F.when(den <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), ((num + den - 1) / den).cast("long")))
    return ranked.withColumn(out, F.when(r.isNotNull(), b.cast("int"))).drop("_rank", "_n")


def decile_table(df: DataFrame, label: str, score: str, id_col: str, q: int = 10,
                 groups: Sequence[str] = ()) -> DataFrame:
    """Per rank decile: size, observed bad rate, mean score, label ``D1..Dq`` (F2)."""
    groups = list(groups)
    binned = rank_bins(df.filter(F.col(score).isNotNull()), score, id_col, q, groups)
    return binned.groupBy(*groups, "decile").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(F.col(label).cast("double")).alias("observed_bad_rate"),
        F.avg(F.col(score)).alias("average_score"),
    ).withColumn("decile_label", F.concat(F.lit("D"), F.col("decile").cast("string")))


def expected_calibration_error(df: DataFrame, label: str, score: str, id_col: str, bins: int = 10,
                               groups: Sequence[str] = ()) -> DataFrame:
    """ECE over rank deciles (I7): sum(count * |mean score - bad rate|) / n."""
    groups = list(groups)
    t = decile_table(df, label, score, id_col, bins, groups)
    return t.groupBy(*groups).agg(
        (F.sum(F.col("sample_count") * F.abs(F.col("average_score") - F.col("observed_bad_rate")))
         / F.sum("sample_count")).alias("ece"))


def calibration_curve(df: DataFrame, label: str, score: str, n_bins: int = 10,
                      groups: Sequence[str] = ()) -> DataFrame:
    """Calibration curve with quantile *value* edges (I8).

    Edges are exact quantiles of the scores; a score's bin is the number of
    inner edges strictly below it.  Empty bins produce no row."""
    groups = list(groups)
    probs = [i / n_bins for i in range(n_bins + 1)]
    edges = exact_quantiles(df, score, probs, groups, out_prefix="_e")
    inner = F.array(*[F.col(f"_e{i}") for i in range(1, n_bins)])
    base = df.filter(F.col(score).isNotNull())
    j = join_checked(base, edges, groups)
    s = F.col(score)
    j = j.withColumn("bin", F.size(F.filter(inner, lambda e: e < s)))
    return j.groupBy(*groups, "bin").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(F.col(score)).alias("mean_predicted"),
        F.avg(F.col(label).cast("double")).alias("fraction_positive"))


def cohort_metrics(df: DataFrame, label: str, score: str, date_col: str) -> DataFrame:
    """Metrics per quarter cohort; cohorts with a single class are skipped."""
    c = df.withColumn("cohort", quarter_label(date_col))
    sizes = c.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(F.col(label).cast("double")).alias("bad_rate"),
        F.count_distinct(F.col(label)).alias("_classes"),
    ).filter(F.col("_classes") == 2).drop("_classes")
    m = binary_metrics(c, label, score, ["cohort"]).drop("sample_count")
    return sizes.join(m, "cohort", "inner")


def confusion_counts(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Confusion matrix at ``score >= threshold``."""
    y = F.col(label).cast("int")
    p = F.col(score) >= F.lit(float(threshold))
    return df.agg(
        F.count(F.when((y == 0) & ~p, 1)).alias("true_negatives"),
        F.count(F.when((y == 0) & p, 1)).alias("false_positives"),
        F.count(F.when((y == 1) & ~p, 1)).alias("false_negatives"),
        F.count(F.when((y == 1) & p, 1)).alias("true_positives"),
    )
