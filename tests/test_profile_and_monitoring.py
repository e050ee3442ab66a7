"""Sketch profiles, duplicates by digests, and monitoring that reads its scores once."""

import pytest
from pyspark.sql import functions as F

from loanlens.operators import ordered, profile, stability


def table(spark):
    rows = [(i % 700, None if i % 10 == 0 else f"v{i % 400}", float(i % 3) if i % 4 else None, None) for i in range(3000)]
    return spark.createDataFrame(rows, "ID long, `a b` string, c double, nothing string").repartition(5)


def test_profiles_agree(spark):
    df = table(spark)
    exact = {r["column"]: r for r in profile.field_profile(df).collect()}
    assert {c: (r.dtype, r.missing_count, r.unique_count) for c, r in exact.items()} == {
        "ID": ("bigint", 0, 700), "a b": ("string", 300, 360), "c": ("double", 750, 3), "nothing": ("string", 3000, 0)}
    for merged in (profile.field_profile(df, approx=True), profile.merge_sketches(profile.profile_sketches(df, F.col("ID") % 7), df)):
        for r in merged.collect():
            e = exact[r["column"]]
            assert (r.dtype, r.missing_count, r.missing_rate) == (e.dtype, e.missing_count, e.missing_rate)
            assert abs(r.unique_count - e.unique_count) <= 0.05 * e.unique_count


def test_sketches_of_arriving_parts(spark):
    """Parts added one by one give what all rows together give."""
    df = table(spark)
    whole = {r["column"]: r.unique_count for r in profile.field_profile(df, approx=True).collect()}
    parts = [profile.profile_sketches(df.filter(F.col("ID") % 3 == i), F.lit(f"day {i}")) for i in range(3)]
    merged = profile.merge_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]), df)
    assert {r["column"]: r.unique_count for r in merged.collect()} == pytest.approx(whole, rel=0.02)
    assert parts[0].count() == 4


@pytest.mark.parametrize("few", [100_000, 1])
def test_duplicates(spark, monkeypatch, few):
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", few)
    rows = [(1, "a", None), (1, "a", None), (1, None, "a"), (2, "x", "y"), (2, "x", "y"), (2, "x", "y"), (3, "z", "z"), (None, None, None), (None, None, None)]
    r = profile.duplicate_summary(spark.createDataFrame(rows, "ID long, `p q` string, _digest string")).first()
    assert (r.duplicate_rows, r.duplicate_ids, r.fields_with_missing) == (1 + 2 + 1, 2 + 2 + 1, 3)
    none = profile.duplicate_summary(spark.createDataFrame([], "ID long, b string")).first()
    assert (none.duplicate_rows, none.duplicate_ids, none.fields_with_missing) == (0, 0, None)


def reads(df, what):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("Initial Plan")[0].count(what)


def test_scores_are_read_once(spark, tmp_path):
    path = f"{tmp_path}/watched_scores"
    days = [f"2024-0{1 + i % 9}-15" for i in range(900)]
    spark.createDataFrame([(i, (i * 37 % 900) / 900, i % 2, d) for i, d in enumerate(days)], "id long, pd double, bad int, day string").withColumn(
        "day", F.to_date("day")).write.parquet(path)
    scores = spark.read.parquet(path)
    table_ = stability.monitoring_table(scores, "pd", "bad", "day")
    assert reads(table_, "watched_scores") == 0              # what is left to do reads stored counts
    got = {r.cohort: r for r in table_.collect()}
    assert sorted(got) == ["2024Q1", "2024Q2", "2024Q3"] and got["2024Q1"].score_psi_vs_baseline == pytest.approx(0)
    assert reads(stability.psi_between(scores, F.col("id") < 450, "pd"), "watched_scores") == 0


def test_missing_scores_stay_in_the_totals(spark):
    rows = [(True, x / 20) for x in range(20)] + [(False, x / 20) for x in range(20)] + [(False, None)] * 20
    df = spark.createDataFrame(rows, "base boolean, pd double")
    psi = stability.psi_between(df, F.col("base"), "pd").first().psi
    import math
    assert psi == pytest.approx(10 * (0.05 - 0.1) * math.log(0.05 / 0.1), rel=1e-6)
    flat = df.withColumn("pd", F.lit(0.5))
    assert stability.psi_between(flat, F.col("base"), "pd").first().psi == 0
    assert stability.psi_between(df.filter("not base"), F.col("base"), "pd").first().psi == 0
