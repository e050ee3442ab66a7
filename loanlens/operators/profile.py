"""Wide-table profiling and the baseline customer case (inventory D10-D16, B12-B19).

Column families are stacked into long (field, value) form once and profiled
with one grouped aggregate, so adding columns adds rows, not jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.scalar import (clip, code_label, right_closed_band, row_count_at_least, row_max,
                                       row_mean, row_std, row_sum)
from loanlens.operators.ordered import count_quantiles, exact_quantiles, join_checked
from loanlens.session import materialize
from loanlens.sources.fixtures import (BILL_COLUMNS, MONEY_COLUMNS, PAY_AMOUNT_COLUMNS, PAY_STATUS_COLUMNS,
                                       TARGET_WIDE)


def _stack(df: DataFrame, cols: Sequence[str], cast: str, name="field", value="value", extra=()) -> DataFrame:
    expr = ", ".join(f"'{c}', CAST(`{c}` AS {cast})" for c in cols)
    return df.selectExpr(*extra, f"stack({len(cols)}, {expr}) AS ({name}, {value})")


def load_wide(df: DataFrame, source_target: str = "default payment next month") -> DataFrame:
    """Baseline table load with the target renamed (A10)."""
    return df.withColumnRenamed(source_target, TARGET_WIDE) if source_target in df.columns else df


def _types(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "field string, dtype string"))      # a row a column


def _profile(per_field: DataFrame, df: DataFrame) -> DataFrame:
    """Profile rows from ``field, _rows, missing_count, unique_count``."""
    return _types(df).join(per_field, "field").select(
        F.col("field").alias("column"), "dtype", "missing_count", (F.col("missing_count") / F.col("_rows")).alias("missing_rate"), "unique_count")


def field_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: type, missing count / rate, distinct non-null count.

    One scan: the columns are stacked and counted by distinct value, and the
    profile is read off these counts.  With ``approx`` only sketches are
    shuffled (``profile_sketches``), one a column and task."""
    if approx:
        return merge_sketches(profile_sketches(df), df)
    counts = _stack(df, df.columns, "STRING").groupBy("field", "value").agg(F.count(F.lit(1)).alias("_c"))
    per = counts.groupBy("field").agg(
        F.sum("_c").alias("_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_c"))), F.lit(0)).alias("missing_count"),
        F.count("value").alias("unique_count"))
    return _profile(per, df)


def profile_sketches(df: DataFrame, part: Column | None = None, precision: int = 12) -> DataFrame:
    """``part, field, n, missing, sketch``: per part and column the rows, the missing ones and a HyperLogLog sketch of the values.

    The table is small however many rows there are, and parts (days, files)
    are added to it as they come; 2 ** ``precision`` buckets put the relative error
    (one sigma) near 0.8 / sqrt(2 ** precision).  A column without values has no sketch.
    """
    named = df.withColumn("_part", (F.lit("all") if part is None else part).cast("string"))
    long = _stack(named, df.columns, "STRING", extra=["_part"])
    return long.groupBy(F.col("_part").alias("part"), "field").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("missing"),
        F.when(F.count("value") > 0, F.hll_sketch_agg("value", precision)).alias("sketch"))


def merge_sketches(sketches: DataFrame, df: DataFrame) -> DataFrame:
    """The profile of all parts together, from their sketches; ``df`` gives the columns' types only."""
    per = sketches.groupBy("field").agg(
        F.sum("n").alias("_rows"), F.sum("missing").alias("missing_count"),
        F.when(F.count("sketch") > 0, F.hll_sketch_estimate(F.hll_union_agg("sketch"))).otherwise(F.lit(0)).cast("long").alias("unique_count"))
    return _profile(per, df)


# Documented code sets and the repayment-status range.
EXPECTED_CODES = {"SEX": [1, 2], "EDUCATION": [1, 2, 3, 4], "MARRIAGE": [1, 2, 3]}
PAY_RANGE = (-2, 8)
CODE_NOTE = "Treat unexpected codes as 'other/unknown' in later features."
PAY_NOTE = "-2 to 0 represent no-delay states; 1 to 8 represent delay months."


def code_quality(df: DataFrame) -> DataFrame:
    """Code checks (D11): observed codes, unexpected count and rate.

    For code sets NULL counts as unexpected; for the status range it does not.
    One scan: the fields are stacked and counted by distinct value, and the
    checks run over these counts."""
    lo, hi = PAY_RANGE
    rules = [(c, ", ".join(map(str, v)), CODE_NOTE, [int(x) for x in v]) for c, v in EXPECTED_CODES.items()]
    rules += [(c, f"{lo} to {hi}", PAY_NOTE, None) for c in PAY_STATUS_COLUMNS]
    rules = df.sparkSession.createDataFrame(rules, "field string, expected_codes string, note string, _valid array<bigint>")
    counts = _stack(df, [*EXPECTED_CODES, *PAY_STATUS_COLUMNS], "BIGINT").groupBy("field", "value").agg(F.count(F.lit(1)).alias("_n"))
    v, coded = F.col("value"), F.col("_valid").isNotNull()
    bad = F.when(coded, ~F.coalesce(F.array_contains("_valid", v), F.lit(False))).otherwise(F.coalesce((v < lo) | (v > hi), F.lit(False)))
    rows = F.coalesce(F.sum("_n"), F.lit(0))
    unexpected = F.coalesce(F.sum(F.when(bad, F.col("_n"))), F.lit(0))
    out = counts.join(F.broadcast(rules), "field", "right").groupBy("field", "expected_codes", "note", coded.alias("_coded")).agg(
        # ranges need no list
        F.array_join(F.sort_array(F.collect_set(F.when(coded, v))), ", ").alias("_list"), F.min("value").alias("_lo"), F.max("value").alias("_hi"),
        unexpected.alias("unexpected_count"), F.try_divide(unexpected, rows).alias("unexpected_rate"))
    return out.select("field", "expected_codes", F.when(F.col("_coded"), F.col("_list")).otherwise(
        F.concat_ws(" to ", "_lo", "_hi")).alias("observed_codes"), "unexpected_count", "unexpected_rate", "note")


def money_profile(df: DataFrame, cols: Sequence[str] = tuple(MONEY_COLUMNS)) -> DataFrame:
    """min, p01, median, p99, max, zero / negative / above-p99 counts per field.

    The fields are stacked and counted by distinct value in one scan;
    percentiles (exact, linear) and all counts come from these counts."""
    counts = materialize(_stack(df, list(cols), "DOUBLE").groupBy("field", "value").agg(F.count(F.lit(1)).alias("_n")))
    q = count_quantiles(counts.filter("value is not null"), "value", "_n", [0.01, 0.5, 0.99], ["field"], out_prefix="_q").drop("_n")
    v = F.col("value")
    times = lambda test: F.coalesce(F.sum(F.when(test, F.col("_n"))), F.lit(0))
    agg = join_checked(counts, q, ["field"], "left").groupBy("field", "_q0", "_q1", "_q2").agg(
        F.min(v).alias("minimum"), F.max(v).alias("maximum"), times(v == 0).alias("zero_count"),
        times(v < 0).alias("negative_count"), times(v > F.col("_q2")).alias("above_p99_count"))
    return agg.select("field", "minimum", F.col("_q0").alias("p01"), F.col("_q1").alias("median"), F.col("_q2").alias("p99"),
                      "maximum", "zero_count", "negative_count", "above_p99_count")


def negative_total(df: DataFrame, cols: Sequence[str] = tuple(BILL_COLUMNS)) -> DataFrame:
    """Total negative values over a family of fields (D16), in one aggregate."""
    return df.agg(sum((F.count(F.when(F.col(c) < 0, 1)) for c in cols), F.lit(0)).cast("long").alias("negative_count"))


# Segment labels and band edges.
GENDER = {1: "Male", 2: "Female"}
EDUCATION = {1: "Graduate school", 2: "University", 3: "High school", 4: "Other"}
MARRIAGE = {1: "Married", 2: "Single", 3: "Other"}
AGE_EDGES, AGE_LABELS = [0, 25, 35, 45, 55, float("inf")], ["<=25", "26-35", "36-45", "46-55", "56+"]
LIMIT_LABELS = ["Q1 low", "Q2", "Q3", "Q4 high"]
DELQ_EDGES = [float("-inf"), 0, 1, 2, float("inf")]
DELQ_LABELS = ["No recorded delinquency", "1 month", "2 months", "3+ months"]
COUNT_EDGES, COUNT_LABELS = [-1, 0, 1, 3, float("inf")], ["0 months", "1 month", "2-3 months", "4+ months"]
SEGMENTS = ["gender_segment", "education_segment", "marriage_segment", "age_segment", "limit_segment",
            "max_delinquency_segment", "delinquent_month_segment", "recent_delinquency_status"]


def quartile_band(df: DataFrame, col: str, out: str, labels: Sequence[str] = tuple(LIMIT_LABELS)) -> DataFrame:
    """Quantile banding into 4 with de-duplicated edges.

    Exact quartile edges (one row, broadcast); bin = 1 + number of distinct
    inner edges below the value (lowest value in bin 1).  When edges collapse
    the remaining bins are numbered from the first label on."""
    q = exact_quantiles(df, col, [0.0, 0.25, 0.5, 0.75, 1.0], out_prefix="_e")
    u = F.array_distinct(F.array(*[F.col(f"_e{i}") for i in range(5)]))
    edges = q.select(F.slice(u, 2, F.greatest(F.size(u) - 2, F.lit(0))).alias("_inner"))
    v = F.col(col).cast("double")
    idx = F.size(F.filter(F.col("_inner"), lambda e: e < v))
    lab = F.element_at(F.array(*[F.lit(x) for x in labels]), (idx + 1).cast("int"))
    return (df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(v.isNotNull(), lab)).drop("_inner"))


def build_segments(df: DataFrame) -> DataFrame:
    """Analyst segments (B12-B15): code labels, fixed bands, quartile band, repayment summaries."""
    seg = (df.withColumn("gender_segment", code_label("SEX", GENDER, "Unknown"))
             .withColumn("education_segment", code_label("EDUCATION", EDUCATION, "Other / unknown"))
             .withColumn("marriage_segment", code_label("MARRIAGE", MARRIAGE, "Other / unknown"))
             .withColumn("age_segment", right_closed_band("AGE", AGE_EDGES, AGE_LABELS))
             .withColumn("max_delinquency_status", row_max(PAY_STATUS_COLUMNS))
             .withColumn("delinquent_month_count", row_count_at_least(PAY_STATUS_COLUMNS, 1))
             .withColumn("recent_delinquency_status", F.col("PAY_0")))
    seg = quartile_band(seg, "LIMIT_BAL", "limit_segment")
    return (seg.withColumn("max_delinquency_segment",
                           right_closed_band("max_delinquency_status", DELQ_EDGES, DELQ_LABELS))
               .withColumn("delinquent_month_segment",
                           right_closed_band("delinquent_month_count", COUNT_EDGES, COUNT_LABELS)))


def segment_default_rates(segmented: DataFrame, target: str = TARGET_WIDE) -> DataFrame:
    """Size and default rate for every segment column in one grouped pass.
    NULL segment values are dropped."""
    long = _stack(segmented, SEGMENTS, "STRING", "segment_col", "segment_value", extra=[target])
    seg_name = F.regexp_replace(F.col("segment_col"), "_segment$", "")
    return (long.filter(F.col("segment_value").isNotNull())
                .groupBy(seg_name.alias("segment"), "segment_value")
                .agg(F.count(F.lit(1)).alias("sample_count"),
                     F.avg(F.col(target).cast("double")).alias("default_rate")))


def duplicate_summary(df: DataFrame, id_col: str = "ID") -> DataFrame:
    """Fully duplicated rows, duplicated ids and fields with missing values.

    Rows are told apart by a digest first: a stored table of digests, ids and null flags
    is aggregated, and only rows whose digest occurs again are read and
    shuffled with all their columns, to be compared exactly.  Spark filters them by
    a broadcast of the repeated digests, or by a shuffle beyond ``BROADCAST_ROWS`` of them.
    """
    cols = df.columns
    name = "_digest"
    while name in cols:
        name += "_"
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in cols])          # equal rows have equal digests; others are compared
    narrow = materialize(df.select(digest.alias("_digest"), F.col(f"`{id_col}`").alias("_id"),
                                   *[F.col(f"`{c}`").isNull().alias(f"_m{i}") for i, c in enumerate(cols)]))
    again = materialize(narrow.groupBy("_digest").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(F.col("_digest").alias(name)))
    suspects = join_checked(df.withColumn(name, digest), again, [name], "left_semi").drop(name)
    extra = lambda counts: counts.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)))
    rows = extra(suspects.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("_c"))).toDF("duplicate_rows")
    ids = extra(narrow.groupBy("_id").agg(F.count(F.lit(1)).alias("_c"))).toDF("duplicate_ids")
    flags = narrow.agg(*[F.max(F.col(f"_m{i}").cast("int")).alias(f"_m{i}") for i in range(len(cols))])
    missing = flags.select(sum((F.col(c) for c in flags.columns), F.lit(0)).alias("fields_with_missing"))
    return rows.crossJoin(ids).crossJoin(missing)                  # one row each


def class_shares(df: DataFrame, target: str = TARGET_WIDE) -> DataFrame:
    """Share of each target class."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return (df.groupBy(F.col(target).alias("default_flag")).agg(F.count(F.lit(1)).alias("_c"))
              .crossJoin(F.broadcast(total))
              .select("default_flag", (F.col("_c") / F.col("_n")).alias("sample_rate")))


# -- B18 / B19: behaviour features ---------------------------------------------

FEATURES_WIDE = ["LIMIT_BAL", "recent_delinquency_status", "max_delinquency_status", "delinquent_month_count",
                 "avg_bill_amount", "avg_payment_amount", "balance_to_limit_ratio", "payment_to_bill_ratio",
                 "bill_amount_volatility"]


def prepare_features(df: DataFrame, target: str = TARGET_WIDE, id_col: str = "ID",
                     require_complete: bool = True) -> DataFrame:
    """Behaviour features of the baseline case (B18).  With ``require_complete`` a
    NULL in any feature fails the job at run time (B19)."""
    avg_bill = row_mean(BILL_COLUMNS)
    pos_bills = row_sum([clip(c, lo=0.0) for c in BILL_COLUMNS])
    pay_sum = row_sum(PAY_AMOUNT_COLUMNS)
    ratio = F.coalesce(F.try_divide(pay_sum, F.when(pos_bills != 0, pos_bills)), F.lit(0.0))
    out = df.select(
        F.col(id_col), F.col("LIMIT_BAL").cast("double").alias("LIMIT_BAL"),
        F.col("PAY_0").cast("double").alias("recent_delinquency_status"),
        row_max(PAY_STATUS_COLUMNS).cast("double").alias("max_delinquency_status"),
        row_count_at_least(PAY_STATUS_COLUMNS, 1).cast("double").alias("delinquent_month_count"),
        avg_bill.alias("avg_bill_amount"),
        row_mean(PAY_AMOUNT_COLUMNS).alias("avg_payment_amount"),
        clip(F.try_divide(avg_bill, F.col("LIMIT_BAL").cast("double")), -2.0, 10.0).alias("balance_to_limit_ratio"),
        clip(ratio, 0.0, 5.0).alias("payment_to_bill_ratio"),
        row_std(BILL_COLUMNS).alias("bill_amount_volatility"),
        F.col(target).cast("int").alias(target))
    if require_complete:
        any_null = None
        for c in FEATURES_WIDE:
            cond = F.col(c).isNull()
            any_null = cond if any_null is None else (any_null | cond)
        # the check rides on a column that is always read, so pruning cannot drop it
        out = out.withColumn(target, F.when(any_null, F.raise_error(
            F.lit("a model feature is null after preparation"))).otherwise(F.col(target)).cast("int"))
    return out
