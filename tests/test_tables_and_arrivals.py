"""Gold table, incremental panel, cohort stream, ingest report and clean-up."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loanlens import session
from loanlens.operators import stability
from loanlens.sources import ingest, tables
from loanlens.streaming import monitor


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_gold_table_is_replaced_and_joined_without_a_shuffle(spark, tmp_path):
    def content(k):
        return spark.range(4000).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("loan_id"), (F.col("id") % 10 + k).cast("double").alias("x"))
    for k in (0, 100, 200):
        gold = tables.replace_table(content(k), "gold_test", ["loan_id"], 4, str(tmp_path))
        assert gold.agg(F.min("x"), F.max("x"), F.count("x")).first() == (k, k + 9, 4000)
    versions = {t.name for t in spark.catalog.listTables() if t.name.startswith("gold_test__")}
    assert versions == {"gold_test__v000002", "gold_test__v000003"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        some = gold.filter("x < 203").select("loan_id").distinct().withColumn("there", F.lit(True))
        joined = gold.join(some, "loan_id", "left").groupBy("loan_id").agg(F.max("there").alias("there"))
        text = plan(joined)
        assert "Exchange" not in text and "SortMergeJoin" in text
        assert joined.filter("there").count() == 1200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for t in ["DROP VIEW gold_test", *[f"DROP TABLE {v}" for v in versions]]:
        spark.sql(t)


@pytest.mark.parametrize("order", [(1, 2, 3), (3, 1, 2), (2, 3, 1, 2)])
def test_extracts_in_any_order(spark, tmp_path, order):
    made = random.Random(3)
    parts = {n: [(f"L{made.randrange(30)}", f"2024-0{made.randrange(1, 7 if n < 3 else 4)}-01", n * 1000 + i, 0, 0, i) for i in range(80)] for n in (1, 2, 3)}
    schema = "loan_id string, month string, value long, _file_index int, _split_start long, _row_id long"
    path = f"{tmp_path}/panel"
    for n in order:
        tables.merge_extract(spark, spark.createDataFrame(parts[n], schema), n, path, ["loan_id", "month"], "month")
    got = {(r.loan_id, str(r.month)): r.value for r in spark.read.parquet(path).collect()}
    want = {}
    for n in (1, 2, 3):
        for loan, month, value, *_ in parts[n]:
            want[loan, month] = value
    assert got == want and spark.read.parquet(path).count() == len(want)
    frames = [spark.createDataFrame(parts[n], schema) for n in (1, 2, 3)]
    assert {(r.loan_id, r.month): r.value for r in ingest.union_extracts(frames, ["loan_id", "month"]).collect()} == want


def test_untouched_months_are_not_rewritten(spark, tmp_path):
    schema = "loan_id string, month string, _file_index int, _split_start long, _row_id long"
    path = f"{tmp_path}/panel"
    tables.merge_extract(spark, spark.createDataFrame([("a", "2024-01", 0, 0, 0), ("a", "2024-02", 0, 0, 1)], schema), 1, path, ["loan_id", "month"], "month")
    before = set(os.listdir(f"{path}/month=2024-01"))
    tables.merge_extract(spark, spark.createDataFrame([("b", "2024-02", 0, 0, 0)], schema), 2, path, ["loan_id", "month"], "month")
    assert set(os.listdir(f"{path}/month=2024-01")) == before
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError, match="among the keys"):
        tables.merge_extract(spark, spark.createDataFrame([], schema), 3, path, ["loan_id"], "month")


def test_cohort_stream_equals_batch(spark, tmp_path):
    made = random.Random(8)
    rows = [(made.random() ** (1 + i % 3) if i % 25 else None, made.choice([0, 1, None]), f"2024-{1 + i % 3 * 3 + made.randrange(3):02d}-03") for i in range(900)]
    df = spark.createDataFrame(rows, "pd double, bad int, day string").withColumn("day", F.to_date("day"))
    df = df.withColumn("n", F.monotonically_increasing_id()).cache()
    late = F.col("n") % 7 == 0                                    # of all cohorts, they arrive after a restart
    source, checkpoint, counts = (f"{tmp_path}/{x}" for x in ("in", "checkpoint", "counts"))
    baseline = df.filter(F.month("day") <= 3)
    edges = monitor.baseline_edges(baseline, "pd")
    start = lambda: monitor.start_cohort_monitor(spark, source, df.schema, edges, checkpoint, counts, "pd", "bad", "day").awaitTermination(120)
    df.filter(~late).repartition(3).write.parquet(source)
    start()
    df.filter(late).repartition(2).write.mode("append").parquet(source)
    start()
    start()                                                       # nothing new
    # a batch that is tried again replaces what it wrote
    last = max(os.listdir(counts))
    assert len([x for x in os.listdir(counts) if x.startswith("batch_id")]) == 2 and last == "batch_id=1"
    got = {r.cohort: r for r in monitor.cohort_status(spark, counts, baseline, edges, "pd", "bad", "day").collect()}
    want = {r.cohort: r for r in stability.monitoring_table(df, "pd", "bad", "day").collect()}
    assert set(got) == set(want) == {"2024Q1", "2024Q2", "2024Q3"}
    for c, w in want.items():
        assert got[c].sample_count == w.sample_count and got[c].psi_status == w.psi_status
        assert (got[c].bad_rate, got[c].average_score, got[c].score_psi_vs_baseline) == pytest.approx((w.bad_rate, w.average_score, w.score_psi_vs_baseline))
    df.unpersist()


LAYOUT = {"loan_id": (0, "string"), "amount": (2, "double")}


def test_lines_of_a_wrong_width_are_seen(spark, tmp_path):
    path = f"{tmp_path}/panel.txt"
    with open(path, "w") as f:
        f.write("\n".join([*[f"L{i}|x|{i}.5" for i in range(20)], "wide|x|1|more", "short|x", "L99|x|"]) + "\n")
    with pytest.raises(Exception, match="more than 3 fields.*wide"):
        ingest.read_combined(spark, [path], 3).select("_c2").collect()
    with pytest.raises(ValueError, match=r"2 of 23 lines don't have 3 fields \(1 more, 1 fewer\)"):
        ingest.land_combined(spark, [path], f"{tmp_path}/strict", 3, LAYOUT)
    seen = ingest.land_combined(spark, [path], f"{tmp_path}/out", 3, LAYOUT, most_malformed=0.1)
    assert seen == {"lines": 23, "cut": 1, "short": 1}
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 23 and sorted(r.malformed_line for r in out.filter("malformed_line is not null").collect()) == ["short|x", "wide|x|1|more"]
    assert out.filter("loan_id = 'L7'").first().amount == 7.5
    good = f"{tmp_path}/good.txt"
    with open(good, "w") as f:
        f.write("a|b|1\nc|d|\n")
    assert ingest.read_combined(spark, [good], 3).count() == 2


def test_stored_tables_can_be_cleaned_up(spark):
    stored = session.materialize(spark.range(5))
    folder = session.checkpoint_dir(spark).removeprefix("file:")
    assert stored.count() == 5 and any(x.startswith("table-") for x in os.listdir(folder))
    session.clean_up(spark)
    assert os.listdir(folder) == []
    assert session.materialize(spark.range(3)).count() == 3
