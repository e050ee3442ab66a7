"""Readers, writers and guards that no query key exercises."""

import pytest
from pyspark.sql import functions as F

from loanlens.operators import policy, profile, snapshot
from loanlens.session import materialize
from loanlens.sources import fixtures, ingest

SF = "/root/testdata/sf0.001"


def test_scenarios_from_a_headed_file(spark, tmp_path):
    names = [f.name for f in policy.SCENARIO_SCHEMA.fields] if hasattr(policy.SCENARIO_SCHEMA, "fields") else [
        x.split()[0] for x in policy.SCENARIO_SCHEMA.split(",")]
    (tmp_path / "s.csv").write_text(",".join(names) + "\n" + ",".join("0.5" for _ in names) + "\n")
    got = policy.read_scenarios(spark, str(tmp_path / "s.csv"))
    assert got.columns == names and got.count() == 1


def test_result_tables(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.col("id") / 2)
    ingest.write_table(df, str(tmp_path / "p"))
    ingest.write_table(df, str(tmp_path / "c"), fmt="csv")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id", "x"]
    assert sorted(materialize(df).collect()) == df.collect()


def test_wide_table_and_null_guard(spark):
    wide = fixtures.wide_customer(spark, SF)
    source = wide.withColumnRenamed(fixtures.TARGET_WIDE, "default payment next month")
    assert fixtures.TARGET_WIDE in profile.load_wide(source).columns
    with pytest.raises(Exception, match="null after preparation"):
        profile.prepare_features(wide.withColumn("BILL_AMT1", F.lit(None).cast("double"))).collect()


def test_snapshot_guard(spark):
    one = spark.createDataFrame([(1, 0), (2, 0)], f"loan_id int, {snapshot.LABEL} int")
    with pytest.raises(ValueError, match="one outcome class"):
        snapshot.check_snapshot(one)
    with pytest.raises(ValueError, match="empty"):
        snapshot.check_snapshot(one.limit(0))
    snapshot.check_snapshot(one.unionByName(one.withColumn(snapshot.LABEL, F.lit(1))))


def test_code_quality_and_duplicates_of_nothing(spark):
    none = fixtures.wide_customer(spark, SF).limit(0)
    assert {r["unexpected_count"] for r in profile.code_quality(none).collect()} == {0}
    assert profile.duplicate_summary(none).first().asDict() == {"duplicate_rows": 0, "duplicate_ids": 0, "fields_with_missing": None}
