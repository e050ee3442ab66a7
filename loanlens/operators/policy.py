"""Policy scenarios (inventory 2.K, C6, L6).

A scenario splits the scores at two cutoffs, so what it needs of a score table are
sums up to its cutoffs.  ``ordered.sums_up_to`` gives these for the cutoffs of
all scenarios in one pass over the scores; no score row is paired with a
scenario, and any number of scenarios can be swept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.operators.ordered import BROADCAST_ROWS, join_checked, sums_up_to
from loanlens.session import materialize

# Action codes and the configured scenarios
# (scenario, pass_max_pd, review_max_pd, lgd_assumption).
PASS, REVIEW, REJECT = "pass", "manual_review", "reject"
ACTIONS = [PASS, REVIEW, REJECT]
DEFAULT_SCENARIOS = [
    ("Conservative", 0.08, 0.20, 0.40),
    ("Balanced", 0.12, 0.30, 0.40),
    ("Growth", 0.18, 0.40, 0.40),
]
SCENARIO_SCHEMA = "scenario string, pass_max_pd double, review_max_pd double, lgd_assumption double"


def scenarios_table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or DEFAULT_SCENARIOS, SCENARIO_SCHEMA)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenario config from a headed CSV with a declared schema."""
    return spark.read.option("header", "true").schema(SCENARIO_SCHEMA).csv(path)


def _check_thresholds(pass_max_pd: float, review_max_pd: float) -> None:
    if not 0 < pass_max_pd < review_max_pd < 1:
        raise ValueError(f"cutoffs out of order: need 0 < {pass_max_pd} < {review_max_pd} < 1")


def _action(pd_col: F.Column, pass_max: F.Column, review_max: F.Column) -> F.Column:
    # NULL PD falls through to reject
    return F.when(pd_col <= pass_max, F.lit(PASS)).when(pd_col <= review_max, F.lit(REVIEW)).otherwise(F.lit(REJECT))


def _exposure(scores: DataFrame, exposure_col: str) -> F.Column:
    if exposure_col in scores.columns:
        return F.coalesce(F.col(exposure_col).cast("double"), F.lit(0.0))
    return F.lit(1.0)


def apply_strategy(scores: DataFrame, pass_max_pd: float, review_max_pd: float, lgd: float,
                   pd_col: str = "xgboost_pd", exposure_col: str = "original_upb") -> DataFrame:
    """Action band and expected loss = PD x exposure x LGD (K1, K2)."""
    _check_thresholds(pass_max_pd, review_max_pd)
    p = F.col(pd_col)
    return (scores.withColumn("action", _action(p, F.lit(float(pass_max_pd)), F.lit(float(review_max_pd))))
                  .withColumn("expected_loss", p * _exposure(scores, exposure_col) * F.lit(float(lgd))))


def check_scenarios(scenarios: DataFrame) -> None:
    """Error that names scenarios whose cutoffs aren't 0 < pass < review < 1 (K1)."""
    low, high = F.col("pass_max_pd"), F.col("review_max_pd")
    good = (low > 0) & (low < high) & (high < 1)
    bad = scenarios.filter(~F.coalesce(good, F.lit(False))).select("scenario", "pass_max_pd", "review_max_pd").limit(5).collect()
    if bad:
        said = "; ".join(f"{r.scenario}: {r.pass_max_pd}, {r.review_max_pd}" for r in bad)
        raise ValueError(f"cutoffs out of order: need 0 < pass_max_pd < review_max_pd < 1, got {said}")


def summarize_strategy(scores: DataFrame, scenarios: DataFrame, pd_col: str = "xgboost_pd",
                       label: str = "bad_12m_90dpd", exposure_col: str = "original_upb", lookup_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per scenario x action: count, share, bad rate, mean PD, exposure, EL.

    ``scenarios`` has one row a scenario.  Actions with no rows produce no row.
    ``lookup_rows``: see ``sums_up_to``.
    """
    scenarios = materialize(scenarios.select("scenario", "pass_max_pd", "review_max_pd", "lgd_assumption"))
    check_scenarios(scenarios)
    p, y = F.col(pd_col).cast("double"), F.col(label).cast("double")
    exposed = F.col(exposure_col).cast("double") if exposure_col in scores.columns else F.lit(1.0)
    parts = {"n": F.lit(1).cast("long"), "labelled": F.when(y.isNotNull(), 1).otherwise(0).cast("long"), "bad": F.coalesce(y, F.lit(0.0)),
             "with_pd": F.when(p.isNotNull(), 1).otherwise(0).cast("long"), "pd": F.coalesce(p, F.lit(0.0)),
             "exposure": F.coalesce(exposed, F.lit(0.0)), "loss": F.coalesce(p * _exposure(scores, exposure_col), F.lit(0.0))}
    cutoffs = scenarios.select(F.col("pass_max_pd").alias("cutoff")).union(scenarios.select("review_max_pd")).distinct()
    sums = materialize(sums_up_to(scores.select(p.alias("_pd"), *[c.alias(n) for n, c in parts.items()]), "_pd", cutoffs, list(parts), lookup_rows))
    side = lambda cut, name: sums.select(F.col("cutoff").alias(cut), F.struct(*[F.col(f"cum_{c}").alias(c) for c in parts]).alias(f"_{name}"),
                                         *([F.struct(*[F.col(f"all_{c}").alias(c) for c in parts]).alias("_all")] if name == "review" else []))
    j = join_checked(scenarios, side("pass_max_pd", "pass"), ["pass_max_pd"])
    j = join_checked(j, side("review_max_pd", "review"), ["review_max_pd"])
    minus = lambda a, b: F.struct(*[(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")).alias(c) for c in parts])
    actions = F.array(*[F.struct(F.lit(name).alias("action"), of.alias("of")) for name, of in
                        ((PASS, F.col("_pass")), (REVIEW, minus("_review", "_pass")), (REJECT, minus("_all", "_review")))])
    rows = j.select("scenario", "pass_max_pd", "review_max_pd", "lgd_assumption", F.col("_all.n").alias("_n"), F.inline(actions))
    rows = rows.filter("of.n > 0")
    return rows.select(
        "scenario", "action", F.col("of.n").alias("loan_count"), (F.col("of.n") / F.col("_n")).alias("action_rate"),
        F.try_divide("of.bad", "of.labelled").alias("observed_bad_rate"), F.try_divide("of.pd", "of.with_pd").alias("average_predicted_pd"),
        F.col("of.exposure").alias("exposure_amount"), (F.col("of.loss") * F.col("lgd_assumption")).alias("expected_loss"),
        "pass_max_pd", "review_max_pd")


def scenario_overview(summary: DataFrame) -> DataFrame:
    """Per scenario: pass / review / non-reject rates, pass bad rate (NULL when no
    pass row), booked EL (pass + review), EL avoided (reject), total EL (K4)."""
    a = F.col("action")
    accepted = a.isin(PASS, REVIEW)

    def s(cond, col):
        return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0.0))
    return summary.groupBy("scenario").agg(
        s(a == PASS, "action_rate").alias("pass_rate"),
        s(a == REVIEW, "action_rate").alias("review_rate"),
        s(accepted, "action_rate").alias("approval_or_review_rate"),
        F.max(F.when(a == PASS, F.col("observed_bad_rate"))).alias("pass_bad_rate"),
        s(accepted, "expected_loss").alias("provisional_booked_expected_loss"),
        s(a == REJECT, "expected_loss").alias("expected_loss_avoided_by_reject"),
        F.coalesce(F.sum("expected_loss"), F.lit(0.0)).alias("pre_decision_portfolio_expected_loss"),
    )


def scenario_tradeoff(overview: DataFrame) -> DataFrame:
    """Reject rate and expected losses in millions."""
    return overview.select(
        "scenario",
        (F.lit(1.0) - F.col("approval_or_review_rate")).alias("reject_rate"),
        (F.col("provisional_booked_expected_loss") / 1e6).alias("booked_el_millions"),
        (F.col("expected_loss_avoided_by_reject") / 1e6).alias("avoided_el_millions"))


def strategy_summary(scores: DataFrame, pass_max_pd: float, review_max_pd: float, lgd: float,
                     pd_col: str = "xgboost_pd", label: str = "bad_12m_90dpd",
                     exposure_col: str = "original_upb") -> tuple[DataFrame, DataFrame]:
    """Ad-hoc scenario (K5): all three actions always present and zero-filled.

    Returns (detail, overview); overview has the non-reject rate, pass bad rate
    (0 when no pass rows), booked EL and EL avoided."""
    assigned = apply_strategy(scores, pass_max_pd, review_max_pd, lgd, pd_col, exposure_col)
    spark = scores.sparkSession
    domain = spark.createDataFrame([(x, i) for i, x in enumerate(ACTIONS)], "action string, _ord int")
    g = assigned.groupBy("action").agg(
        F.count(F.lit(1)).alias("loan_count"),
        F.avg(F.col(label).cast("double")).alias("observed_bad_rate"),
        F.avg(F.col(pd_col)).alias("average_pd"),
        F.coalesce(F.sum(F.col(exposure_col).cast("double")), F.lit(0.0)).alias("exposure"),
        F.coalesce(F.sum("expected_loss"), F.lit(0.0)).alias("expected_loss"))
    detail = F.broadcast(domain).join(g, "action", "left")
    total = F.sum("loan_count").over(Window.partitionBy())               # three rows
    detail = (detail.select("action",
                      F.coalesce(F.col("loan_count"), F.lit(0)).cast("long").alias("loan_count"),
                      F.coalesce(F.col("observed_bad_rate"), F.lit(0.0)).alias("observed_bad_rate"),
                      F.coalesce(F.col("average_pd"), F.lit(0.0)).alias("average_pd"),
                      F.coalesce(F.col("exposure"), F.lit(0.0)).alias("exposure"),
                      F.coalesce(F.col("expected_loss"), F.lit(0.0)).alias("expected_loss"),
                      F.try_divide(F.coalesce(F.col("loan_count"), F.lit(0)), total).alias("action_rate")))
    a = F.col("action")
    overview = detail.agg(
        F.sum(F.when(a != REJECT, F.col("action_rate")).otherwise(0.0)).alias("non_reject_rate"),
        F.max(F.when(a == PASS, F.col("observed_bad_rate"))).alias("pass_bad_rate"),
        F.sum(F.when(a != REJECT, F.col("expected_loss")).otherwise(0.0)).alias("booked_expected_loss"),
        F.sum(F.when(a == REJECT, F.col("expected_loss")).otherwise(0.0)).alias("expected_loss_avoided"))
    return detail, overview
