"""Queries of the ingest chain (inventory 2.A, B1-B4, G1): raw files are written from the given tables, with the
faults that raw files have, and read back by the ingest operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.operators import policy as P
from loanlens.operators import stability as S
from loanlens.plans import oracle_views as V
from loanlens.plans.catalog import D17_SQL, ORACLE, oot_ids, policy_scores, r6, register, snapshot_df, with_
from loanlens.session import checkpoint_dir
from loanlens.sources import fixtures as fx
from loanlens.sources import ingest, tables


def _folder(spark, kind: str) -> str:
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, fields: dict[int, Column], width: int) -> DataFrame:
    return df.select(F.concat_ws("|", *[F.coalesce(fields[i].cast("string"), F.lit("")) if i in fields else F.lit("") for i in range(width)]).alias("value"))


PANEL_FIELDS = [c for c in ingest.COMBINED_LAYOUT if c != "zero_balance_code"]


@register("a1_combined_ingest", with_(V.PANEL, f"""
SELECT {', '.join(c for c in PANEL_FIELDS if c not in ('reporting_month', 'current_actual_upb', 'current_delinquency_status', 'original_interest_rate'))},
  round(original_interest_rate, 6) AS original_interest_rate, CASE WHEN ingest_key % 19 <> 0 THEN reporting_month END AS reporting_month,
  CASE WHEN ingest_key % 23 <> 0 THEN round(current_actual_upb, 6) END AS current_actual_upb,
  CASE WHEN ingest_key % 29 = 0 THEN NULL WHEN ingest_key % 31 = 0 THEN current_delinquency_status + 1 ELSE current_delinquency_status END AS current_delinquency_status,
  CAST(NULL AS INTEGER) AS zero_balance_code FROM panel"""))
def q_a1(spark, sf):
    """The whole panel as headerless files of 113 fields, read back and typed.

    Some months are no months, some balances no numbers, some states letters or broken numbers.
    """
    key = F.col("ingest_key")
    text = {c: F.col(c) for c in PANEL_FIELDS}
    text["reporting_month"] = F.when(key % 19 == 0, F.concat(F.lit("13"), F.year("reporting_month").cast("string"))).otherwise(
        F.date_format("reporting_month", "MMyyyy"))
    text["origination_date"] = F.date_format("origination_date", "MMyyyy")
    text["current_actual_upb"] = F.when(key % 23 == 0, "n/a").otherwise(F.col("current_actual_upb").cast("string"))
    text["current_delinquency_status"] = F.when(key % 29 == 0, "XX").when(
        key % 31 == 0, F.concat(F.col("current_delinquency_status").cast("string"), F.lit(".7"))).otherwise(F.col("current_delinquency_status").cast("string"))
    fields = {ingest.COMBINED_LAYOUT[c][0]: text[c] for c in PANEL_FIELDS}
    path = _folder(spark, "raw")
    _lines(fx.loan_panel(spark, sf), fields, ingest.COMBINED_WIDTH).write.text(path)
    return r6(ingest.typed_panel(ingest.read_combined(spark, [path])).select(*ingest.COMBINED_LAYOUT))


ORIGINATION_COLS = ["loan_id", "origination_date", "original_upb", "original_ltv", "borrower_credit_score", "loan_purpose", "occupancy_status"]


@register("a3_extract_ingest", with_(V.PANEL + """,
o AS (SELECT loan_id, CAST(loan_id AS BIGINT) AS num, max(origination_date) AS d, max(original_upb) AS upb, max(original_ltv) AS ltv,
        max(borrower_credit_score) AS score, max(loan_purpose) AS purpose, max(occupancy_status) AS occupancy FROM panel GROUP BY loan_id),
older AS (SELECT loan_id, CASE WHEN num % 7 <> 0 AND num % 11 <> 0 THEN d END AS origination_date, upb + 1 AS original_upb, ltv AS original_ltv,
            score AS borrower_credit_score, purpose AS loan_purpose, CAST(NULL AS VARCHAR) AS occupancy_status FROM o WHERE num % 3 <> 0),
newer AS (SELECT loan_id, d, upb, ltv, score, purpose, coalesce(occupancy, 'Unknown') FROM o WHERE num % 2 = 0)""", """
SELECT * FROM newer n(loan_id, origination_date, original_upb, original_ltv, borrower_credit_score, loan_purpose, occupancy_status)
UNION ALL SELECT * FROM older WHERE loan_id NOT IN (SELECT loan_id FROM newer)"""))
def q_a3(spark, sf):
    """An older extract under a header of other spellings, a newer one without a header; the last record stays."""
    o = fx.origination_extract(spark, sf).withColumn("num", F.col("loan_id").cast("long"))
    num = F.col("num")
    older, newer = _folder(spark, "headed"), _folder(spark, "positional")
    day = F.when(num % 7 == 0, "  ").when(num % 11 == 0, "nan").otherwise(F.date_format("origination_date", "yyyy-MM-dd"))
    o.filter(num % 3 != 0).select(
        F.col("loan_id").alias("Loan Identifier"), day.alias("Orig. Date"), (F.col("original_upb") + 1).alias("Original Unpaid Principal Balance"),
        F.col("original_ltv").alias("Original Loan-To-Value"), F.col("borrower_credit_score").alias("FICO"),
        F.col("loan_purpose").alias("PURPOSE")).write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").csv(older)
    place = {c: i for i, c in enumerate(ingest.ACQUISITION_POSITIONAL)}
    fields = {place[c]: F.date_format(c, "MMyyyy") if c == "origination_date" else F.col(c) for c in ORIGINATION_COLS}
    _lines(o.filter(num % 2 == 0), fields, len(place)).write.text(newer)
    frames = [ingest.normalize_origination(ingest.read_delimited(spark, p, ingest.ACQUISITION_POSITIONAL)) for p in (older, newer)]
    return r6(ingest.union_extracts(frames, ["loan_id"]).select(*ORIGINATION_COLS))


@register("a7_scenario_file", ORACLE["k4_scenario_overview"])
def q_a7(spark, sf):
    """The scenarios from a headed CSV file (money in cents)."""
    path = _folder(spark, "scenarios")
    ingest.write_table(P.scenarios_table(spark), path, "csv")
    out = P.scenario_overview(P.summarize_strategy(policy_scores(spark, sf), P.read_scenarios(spark, path)))
    money = ["provisional_booked_expected_loss", "expected_loss_avoided_by_reject", "pre_decision_portfolio_expected_loss"]
    return r6(out.withColumns({c: F.round(c, 2) for c in money}))


@register("a9_gold_quality", D17_SQL)
def q_a9(spark, sf):
    """The snapshot as a table bucketed by loan; its loans are flagged without a shuffle of the table."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    gold = tables.replace_table(snapshot_df(spark, sf), "loanlens_gold_snapshot", ["loan_id"], buckets, checkpoint_dir(spark))
    return r6(S.data_quality(gold, oot_ids(gold)))
