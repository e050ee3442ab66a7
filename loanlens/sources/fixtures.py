"""Fixture views over the driver tables (FIXTURES.md section 3).

Each view is a plain DataFrame derived from the given parquet tables, so its
volume grows with the scale factor:

* ``loan_panel``   F1 -- loan x reporting month, from ``lineitem`` (+ the
                   ``nation`` dimension for the state)
* ``scored``       F2 -- one scored loan per order, from ``orders``
* ``wide_customer`` F3 -- one wide credit-card style record per customer,
                   from ``customer`` + its six latest ``orders``
* ``score_events`` F5 -- scores on an event stream, from ``events``

The same definitions are restated as DuckDB SQL in ``plans/oracle_views.py``
for the correctness oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators.topk import top_k_per_group


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _loan_number(returnflag, linestatus, suppkey):
    rf = (F.when(returnflag == "A", 0).when(returnflag == "N", 1).when(returnflag == "R", 2))
    ls = F.when(linestatus == "O", 0).when(linestatus == "F", 1)
    return suppkey * 6 + rf * 2 + ls


def loan_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """monthly loan panel with the typed 17-field layout of the snapshot input."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    # State comes from the nation dimension (25 rows by definition of the
    # schema, so the broadcast has a proven size bound): nationkey = suppkey mod 25.
    nat = table(spark, sf_dir, "nation").select(F.col("n_nationkey"), F.col("n_name").alias("property_state"))

    n = F.col("loan_num")
    k = (n * 7) % 60
    missing_bureau = (n % 41) == 0
    q = F.col("l_quantity")
    status = (F.when((q == 50) & (F.col("l_discount") >= 0.05), 3)
              .when(q >= 49, 2).when(q >= 46, 1).otherwise(0))
    panel = (
        li.withColumn("loan_num", _loan_number(F.col("l_returnflag"), F.col("l_linestatus"),
                                               F.col("l_suppkey")))
        .join(F.broadcast(nat), (li.l_suppkey % 25) == nat.n_nationkey, "left")
        .select(
            n.cast("string").alias("loan_id"),
            F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("reporting_month"),
            (F.lit(2.5) + (n % 30).cast("double") * 0.125).alias("original_interest_rate"),
            F.when((n % 97) == 0, F.lit(0.0))
             .otherwise((F.lit(100000) + (n % 50) * 1000).cast("double")).alias("original_upb"),
            F.when((F.col("l_orderkey") % 11) == 0, F.lit(None).cast("double"))
             .otherwise(F.col("l_extendedprice")).alias("current_actual_upb"),
            F.when((n % 4) == 0, F.lit(180)).otherwise(F.lit(360)).cast("int").alias("original_loan_term"),
            F.make_date((F.lit(1995) + F.floor(k / 12)).cast("int"), (F.lit(1) + k % 12).cast("int"),
                        F.lit(1)).alias("origination_date"),
            F.when(missing_bureau, F.lit(None)).otherwise((F.lit(40) + n % 60).cast("double")).alias("original_ltv"),
            F.when(missing_bureau, F.lit(None)).otherwise((F.lit(10) + n % 50).cast("double")).alias("original_dti"),
            F.when(missing_bureau, F.lit(None))
             .otherwise((F.lit(600) + (n * 13) % 251).cast("double")).alias("borrower_credit_score"),
            F.when((n % 3) == 0, "P").when((n % 3) == 1, "C").otherwise("R").alias("loan_purpose"),
            F.when(F.col("l_returnflag") == "A", "SF").when(F.col("l_returnflag") == "N", "PU")
             .otherwise("CO").alias("property_type"),
            F.when((n % 13) == 0, F.lit(None).cast("string"))
             .when(F.col("l_linestatus") == "O", "P").otherwise("I").alias("occupancy_status"),
            F.col("property_state"),
            status.cast("int").alias("current_delinquency_status"),
            F.when(F.col("l_tax") >= 0.08, "Y").otherwise("N").alias("modification_flag"),
            # row-order key for keep-last dedupe (D5): file order is not a
            # property of a distributed table, so it is made explicit.
            F.col("l_shipdate").cast("date").alias("ingest_date"),
            F.col("l_orderkey").alias("ingest_key"),
            F.col("l_linenumber").alias("ingest_line"),
        )
    )
    return panel


def origination_extract(spark: SparkSession, sf_dir: str, panel: DataFrame | None = None) -> DataFrame:
    """Acquisition-style extract (one row per loan) derived from the panel (L2 layout).

    A loan's statics are the same in all its rows, so any part of the panel
    that has each loan will do."""
    p = loan_panel(spark, sf_dir) if panel is None else panel
    return (p.groupBy("loan_id").agg(
        F.max("origination_date").alias("origination_date"),
        F.max("original_upb").alias("original_upb"),
        F.max("original_ltv").alias("original_ltv"),
        F.max("original_dti").alias("original_dti"),
        F.max("borrower_credit_score").alias("borrower_credit_score"),
        F.max("original_interest_rate").alias("original_interest_rate"),
        F.max("original_loan_term").alias("original_loan_term"),
        F.max("loan_purpose").alias("loan_purpose"),
        F.max("occupancy_status").alias("occupancy_status"),
        F.max("property_state").alias("property_state"),
        F.max("property_type").alias("property_type"),
    ))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2: scored population (one row per order)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("loan_id"),
        F.col("o_orderdate").cast("date").alias("observation_date"),
        (F.col("o_totalprice") / 500000.0).alias("pd"),
        (((F.col("o_orderkey") * 7919) % 1000).cast("double") / 1000.0).alias("pd_b"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("int").alias("bad"),
        F.col("o_totalprice").alias("original_upb"),
    )


# The credit-card style column names of the wide record.
PAY_STATUS_COLUMNS = ["PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6"]
BILL_COLUMNS = [f"BILL_AMT{i}" for i in range(1, 7)]
PAY_AMOUNT_COLUMNS = [f"PAY_AMT{i}" for i in range(1, 7)]
MONEY_COLUMNS = ["LIMIT_BAL", *BILL_COLUMNS, *PAY_AMOUNT_COLUMNS]
TARGET_WIDE = "default_payment_next_month"


def wide_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one wide record per customer; months 1..6 are its six latest orders."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                              "o_totalprice", "o_orderdate")
    # six latest orders per customer: each task sends at most six rows of a customer to the shuffle
    latest = top_k_per_group(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()],
                             6, "rn")
    aggs = []
    for i in range(1, 7):
        pick = F.col("rn") == i
        aggs.append(F.max(F.when(pick, F.col("o_totalprice"))).alias(BILL_COLUMNS[i - 1]))
        aggs.append(F.max(F.when(pick, F.col("o_totalprice") * (F.col("o_orderkey") % 5).cast("double") / 10.0))
                    .alias(PAY_AMOUNT_COLUMNS[i - 1]))
        aggs.append(F.max(F.when(pick, (F.col("o_orderkey") % 11 - 2).cast("int"))).alias(PAY_STATUS_COLUMNS[i - 1]))
    aggs.append(F.max(F.when((F.col("rn") == 1) & (F.col("o_orderstatus") == "F"), 1).otherwise(0)).alias("_target"))
    months = latest.groupBy("o_custkey").agg(*aggs)
    key = F.col("c_custkey")
    out = c.join(months, c.c_custkey == months.o_custkey, "left").select(
        key.alias("ID"),
        (F.col("c_acctbal") + 1000.0).alias("LIMIT_BAL"),
        (key % 2 + 1).cast("int").alias("SEX"),
        (key % 7).cast("int").alias("EDUCATION"),
        (key % 4).cast("int").alias("MARRIAGE"),
        (key % 50 + 21).cast("int").alias("AGE"),
        *[F.col(x) for x in PAY_STATUS_COLUMNS],
        *[F.col(x) for x in BILL_COLUMNS],
        *[F.col(x) for x in PAY_AMOUNT_COLUMNS],
        F.coalesce(F.col("_target"), F.lit(0)).cast("int").alias(TARGET_WIDE),
    )
    return out


def score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event stream as scored records (score = least(value/500, 1))."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return e.select(
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.least(F.col("value") / 500.0, F.lit(1.0)).alias("score"),
    )
