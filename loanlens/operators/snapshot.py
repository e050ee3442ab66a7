"""Point-in-time PD snapshot (inventory 2.D: D1-D9, plus C1, C2, C4, C5).

One row per loan: static origination attributes, behaviour features from
months-on-book 1..obs, and a default label from months obs+1..obs+out.

Physical design
---------------
* One scan of the panel, one shuffle on ``loan_id``.  Eligibility counts
  (D2) are computed inside the same aggregate as the features and applied as
  a filter afterwards, instead of a second aggregate joined back.
* The month window filter (1..obs+out) sits below the aggregate, so the
  partial aggregate only sees relevant rows; column pruning reaches the scan.
* "Latest in window" (D3) is ``max_by`` over an ordering that is NULL for
  rows outside the window or with a NULL value, so NULL balances are
  skipped; ties on the month are broken by the larger value so the result
  never depends on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions.scalar import add_months, fill_unknown, month_diff, safe_ratio

SNAPSHOT_COLUMNS = [
    "loan_id", "origination_date", "observation_date", "original_upb", "original_interest_rate",
    "original_loan_term", "original_ltv", "original_dti", "borrower_credit_score", "loan_purpose",
    "property_type", "occupancy_status", "property_state", "hist_max_dpd", "hist_30dpd_months",
    "hist_avg_upb", "hist_upb_volatility", "hist_latest_upb", "hist_latest_dpd",
    "hist_modified_months", "bad_12m_90dpd", "hist_upb_to_original_upb",
]
NUMERIC_STATICS = ["original_upb", "original_interest_rate", "original_loan_term", "original_ltv",
                   "original_dti", "borrower_credit_score"]
STRING_STATICS = ["loan_purpose", "property_type", "occupancy_status", "property_state"]
LABEL = "bad_12m_90dpd"
BAD_STATUS = 3


def _latest(value: str, in_window) -> F.Column:
    v = F.col(value)
    order = F.when(in_window & v.isNotNull(), F.struct(F.col("reporting_month"), v))
    return F.max_by(v, order)


def _behaviour_aggs(hist, fut):
    status = F.col("current_delinquency_status")
    upb = F.col("current_actual_upb")
    return [
        F.max(F.when(hist, status)).alias("hist_max_dpd"),
        F.count(F.when(hist & (status >= 1), 1)).alias("hist_30dpd_months"),
        F.avg(F.when(hist, upb)).alias("hist_avg_upb"),
        F.stddev_samp(F.when(hist, upb)).alias("hist_upb_volatility"),
        _latest("current_actual_upb", hist).alias("hist_latest_upb"),
        _latest("current_delinquency_status", hist).alias("hist_latest_dpd"),
        F.count(F.when(hist & (F.col("modification_flag") == "Y"), 1)).alias("hist_modified_months"),
        F.max(F.when(fut, status)).alias("_fut_max_dpd"),
    ]


def build_snapshot(panel: DataFrame, observation_months: int = 6, outcome_months: int = 12,
                   distinct_months: bool = False) -> DataFrame:
    """SQL-mode snapshot (D1-D4) over a typed panel.

    Eligibility: at least ``observation_months`` rows in the history window and
    ``outcome_months`` rows in the outcome window (row counts, so duplicated
    months count twice -- ``distinct_months=True`` counts distinct months).
    Static attributes are the max over the loan's rows; categorical NULLs stay NULL.
    """
    if observation_months < 1 or outcome_months < 1:
        raise ValueError("observation and outcome windows must both be at least one month")
    horizon = observation_months + outcome_months
    rel = (
        panel.filter(F.col("loan_id").isNotNull() & F.col("origination_date").isNotNull()
                     & F.col("reporting_month").isNotNull()
                     & F.col("current_delinquency_status").isNotNull())
        .withColumn("month_on_book", month_diff("reporting_month", "origination_date"))
        .filter(F.col("month_on_book").between(1, horizon))
    )
    mob = F.col("month_on_book")
    hist = mob.between(1, observation_months)
    fut = mob.between(observation_months + 1, horizon)
    if distinct_months:
        n_hist = F.count_distinct(F.when(hist, F.col("reporting_month")))
        n_fut = F.count_distinct(F.when(fut, F.col("reporting_month")))
    else:
        n_hist = F.count(F.when(hist, 1))
        n_fut = F.count(F.when(fut, 1))
    aggs = [
        n_hist.alias("_n_hist"), n_fut.alias("_n_fut"),
        F.max("origination_date").alias("origination_date"),
        *[F.max(c).alias(c) for c in NUMERIC_STATICS],
        *[F.max(c).alias(c) for c in STRING_STATICS],
        *_behaviour_aggs(hist, fut),
    ]
    snap = (
        rel.groupBy("loan_id").agg(*aggs)
        .filter((F.col("_n_hist") >= observation_months) & (F.col("_n_fut") >= outcome_months))
        .withColumn("observation_date", add_months("origination_date", observation_months))
        .withColumn(LABEL, F.when(F.col("_fut_max_dpd") >= BAD_STATUS, 1).otherwise(0).cast("int"))
        .withColumn("hist_upb_to_original_upb", safe_ratio("hist_latest_upb", "original_upb"))
    )
    return snap.select(*SNAPSHOT_COLUMNS)


# -- D5: keep-last dedupe -----------------------------------------------------

def dedupe_keep_last(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """Keep the last row per key under an explicit ingest order.

    ``dropDuplicates`` keeps an arbitrary row; here the order is data.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_cols])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


# -- D6: two-extract ("pandas") mode -------------------------------------------

ORIGINATION_STATICS = ["origination_date", "original_upb", "original_ltv", "original_dti",
                       "borrower_credit_score", "original_interest_rate", "original_loan_term",
                       "origination_channel", "loan_purpose", "occupancy_status", "property_state",
                       "property_type", "product_type"]
ORIGINATION_CATEGORICALS = ["origination_channel", "loan_purpose", "occupancy_status",
                            "property_state", "property_type", "product_type"]


def build_snapshot_extracts(origination: DataFrame, performance: DataFrame,
                            observation_months: int = 6, outcome_months: int = 12) -> DataFrame:
    """Snapshot from an origination extract and a deduped performance extract.

    Differences from ``build_snapshot`` (kept on purpose, see SURVEY 2.D):
    eligibility is "max month-on-book >= obs + out"; "latest" is the last
    history row even when its value is NULL; statics come from the origination
    record; categorical NULLs become 'Unknown'.
    Only the origination columns the snapshot needs are joined (C1), so
    performance columns of the same name never shadow them.
    """
    if observation_months < 1 or outcome_months < 1:
        raise ValueError("observation and outcome windows must both be at least one month")
    horizon = observation_months + outcome_months
    statics = [c for c in ORIGINATION_STATICS if c in origination.columns]
    orig = origination.select("loan_id", *statics)
    for c in ORIGINATION_CATEGORICALS:
        if c in orig.columns:
            orig = orig.withColumn(c, fill_unknown(c))
    perf_cols = ["loan_id", "reporting_month", "current_actual_upb", "current_delinquency_status"]
    perf = performance.select(*perf_cols, F.coalesce(F.col("modification_flag").cast("string"),
                                                     F.lit("Unknown")).alias("modification_flag")
                              ) if "modification_flag" in performance.columns else \
        performance.select(*perf_cols, F.lit("Unknown").alias("modification_flag"))
    joined = (
        perf.join(orig.select("loan_id", "origination_date", "original_upb"), "loan_id", "inner")  # C1
        .withColumn("month_on_book", month_diff("reporting_month", "origination_date"))
        .filter((F.col("month_on_book") >= 1) & F.col("origination_date").isNotNull()
                & F.col("reporting_month").isNotNull() & F.col("current_delinquency_status").isNotNull())
    )
    mob = F.col("month_on_book")
    hist = mob.between(1, observation_months)
    fut = mob.between(observation_months + 1, horizon)
    status = F.col("current_delinquency_status")
    upb = F.col("current_actual_upb")
    # last history row by month (months are unique after dedupe); NULL value kept.
    last_order = F.when(hist, mob)
    agg = joined.groupBy("loan_id").agg(
        F.max(mob).alias("_max_mob"),
        F.count(F.when(hist, 1)).alias("_n_hist"),
        F.count(F.when(fut, 1)).alias("_n_fut"),
        F.max(F.when(hist, status)).alias("hist_max_dpd"),
        F.count(F.when(hist & (status >= 1), 1)).alias("hist_30dpd_months"),
        F.avg(F.when(hist, upb)).alias("hist_avg_upb"),
        F.stddev_samp(F.when(hist, upb)).alias("hist_upb_volatility"),
        F.count(F.when(hist & (F.col("modification_flag") == "Y"), 1)).alias("hist_modified_months"),
        F.max_by(upb, last_order).alias("hist_latest_upb"),
        F.max_by(status, last_order).alias("hist_latest_dpd"),
        F.max_by(F.col("original_upb"), last_order).alias("_latest_original_upb"),
        F.max(F.when(fut, status)).alias("_fut_max_dpd"),
    ).filter((F.col("_max_mob") >= horizon) & (F.col("_n_hist") > 0) & (F.col("_n_fut") > 0))
    agg = (agg.withColumn("hist_upb_to_original_upb", safe_ratio("hist_latest_upb", "_latest_original_upb"))
              .withColumn(LABEL, F.when(F.col("_fut_max_dpd") >= BAD_STATUS, 1).otherwise(0).cast("int")))
    feats = ["hist_max_dpd", "hist_30dpd_months", "hist_avg_upb", "hist_upb_volatility",
             "hist_modified_months", "hist_latest_upb", "hist_latest_dpd", "hist_upb_to_original_upb"]
    snap = (orig.join(agg.select("loan_id", *feats, LABEL), "loan_id", "inner")   # C4
                .withColumn("observation_date", add_months("origination_date", observation_months)))
    return snap.select("loan_id", *statics, *feats, LABEL, "observation_date")


# -- D7 guards, D8 summary, D9 stage quality ------------------------------------

def check_snapshot(snapshot: DataFrame) -> None:
    """Raise when the snapshot is empty or has one label class.

    One tiny aggregate is brought to the driver."""
    row = snapshot.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(LABEL).alias("k")).first()
    if row["n"] == 0:
        raise ValueError("snapshot is empty: no loan has enough history and outcome months")
    if row["k"] < 2:
        raise ValueError("snapshot has loans of one outcome class only")


def snapshot_summary(snapshot: DataFrame) -> DataFrame:
    """One-row summary (D8): count, bad rate, origination range, FICO/LTV missing rates."""
    return snapshot.agg(
        F.count(F.lit(1)).alias("loan_count"),
        F.avg(F.col(LABEL).cast("double")).alias("bad_rate"),
        F.min("origination_date").alias("earliest_origination"),
        F.max("origination_date").alias("latest_origination"),
        F.avg(F.when(F.col("borrower_credit_score").isNull(), 1.0).otherwise(0.0)).alias("fico_missing_rate"),
        F.avg(F.when(F.col("original_ltv").isNull(), 1.0).otherwise(0.0)).alias("ltv_missing_rate"),
    )


def snapshot_summary_long(snapshot: DataFrame) -> DataFrame:
    """D8 as a long ``metric, value`` table (values as text)."""
    wide = snapshot_summary(snapshot)
    cols = wide.columns
    return wide.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "metric", "value")


def stage_quality(stages: dict[str, DataFrame], key: str = "loan_id") -> DataFrame:
    """Rows, distinct keys and mean per-field missing rate for each stage."""
    out = None
    for name, df in stages.items():
        cols = df.columns
        miss = [F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)) for c in cols]
        mean_missing = miss[0]
        for m in miss[1:]:
            mean_missing = mean_missing + m
        part = df.agg(
            F.lit(name).alias("stage"),
            F.count(F.lit(1)).alias("row_count"),
            F.count_distinct(F.col(key)).alias("unique_loans"),
            (mean_missing / float(len(cols))).alias("average_field_missing_rate"),
        )
        out = part if out is None else out.unionByName(part)
    return out
