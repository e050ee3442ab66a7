"""Report queries: the data behind the overview, model, monitoring and quality
pages (inventory 2.L, F5-F7, G2).  Rendering itself is out of scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions.scalar import PSI_REVIEW


def overview_kpis(summary: DataFrame, metrics: DataFrame, psi: DataFrame) -> DataFrame:
    """Snapshot count, bad rate, champion AUC, score PSI with its review flag (L1).
    Three one-row tables joined as scalars."""
    return (summary.select("loan_count", "bad_rate")
            .crossJoin(metrics.select(F.col("auc").alias("champion_auc")))
            .crossJoin(psi.select(F.col("psi").alias("score_psi")))
            .withColumn("psi_flag", F.when(F.col("score_psi") >= PSI_REVIEW, "review").otherwise("stable")))


def model_comparison(*tables: DataFrame) -> DataFrame:
    """Champion-challenger table: union of per-model metric rows."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def top_drift(stability: DataFrame, prefix: str = "Train vs OOT", k: int = 10) -> DataFrame:
    """Largest PSI features of one comparison (L3, F5); ties by feature name."""
    f = stability.filter(F.col("comparison").startswith(prefix))
    w = Window.partitionBy("comparison").orderBy(F.col("psi").desc(), F.col("feature"))
    return f.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def quality_alerts(quality: DataFrame) -> DataFrame:
    """Quality rows in alert only (L4)."""
    return quality.filter(F.col("quality_status") == "alert")


def quality_pivot(quality: DataFrame, populations=("train", "oot")) -> DataFrame:
    """Feature x population grid of missing and invalid rates."""
    return quality.groupBy("feature").pivot("population", list(populations)).agg(
        F.first("missing_rate").alias("missing_rate"), F.first("invalid_rate").alias("invalid_rate"))


def latest_cohort_kpis(monitoring: DataFrame) -> DataFrame:
    """Baseline (first) and latest cohort with the latest bad rate, PSI and status."""
    b = monitoring.agg(F.min("cohort").alias("baseline_cohort"), F.max("cohort").alias("latest_cohort"))
    latest = monitoring.join(F.broadcast(b), monitoring.cohort == b.latest_cohort, "inner")
    return latest.select("baseline_cohort", "latest_cohort", F.col("bad_rate").alias("latest_bad_rate"),
                         F.col("score_psi_vs_baseline").alias("latest_psi"), "psi_status")
