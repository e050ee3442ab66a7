"""Scenario sweep: both ways to look thresholds up, against a plain version; error path; one scan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loanlens.operators import ordered, policy


def scores(n=700):
    made = random.Random(4)
    rows = []
    for i in range(n):
        pd = made.choice([None, float("nan")]) if i % 50 == 0 else round(made.random(), 2)
        rows.append((i, pd, made.choice([0, 1, None]), made.choice([None, 0.0, 1000.0 * made.random()])))
    return rows


SCHEMA = "loan_id long, xgboost_pd double, bad_12m_90dpd int, original_upb double"
GRID = [(f"s{i}", 0.01 + i / 300, 0.3 + i / 200, 0.4) for i in range(100)] + [("tie", 0.25, 0.5, 0.3), ("narrow", 0.251, 0.252, 0.3)]


def plain(rows, scenario):
    name, low, high, lgd = scenario
    groups = {}
    for _, pd, y, upb in rows:
        a = policy.PASS if pd is not None and pd <= low else policy.REVIEW if pd is not None and pd <= high else policy.REJECT
        groups.setdefault(a, []).append((pd, y, upb or 0.0))
    out = {}
    for a, g in groups.items():
        ys, ps = [y for _, y, _ in g if y is not None], [p for p, *_ in g if p is not None]
        out[name, a] = (len(g), len(g) / len(rows), sum(ys) / len(ys) if ys else None, sum(ps) / len(ps) if ps else None,
                        sum(u for *_, u in g), sum(p * u * lgd for p, _, u in g if p is not None))
    return out


@pytest.mark.parametrize("lookup_rows", [1000, 10])
def test_sweep_against_plain(spark, lookup_rows):
    rows = scores()
    got = policy.summarize_strategy(spark.createDataFrame(rows, SCHEMA).repartition(3), policy.scenarios_table(spark, GRID), lookup_rows=lookup_rows)
    got = {(r.scenario, r.action): r[2:8] for r in got.collect()}
    want = {k: v for s in GRID for k, v in plain(rows, s).items()}
    assert set(got) == set(want)
    for k, v in want.items():
        for a, b in zip(got[k], v, strict=True):
            assert (a is None) == (b is None) and (a is None or math.isnan(a) and math.isnan(b) or a == pytest.approx(b, rel=1e-9, abs=1e-9)), k


@pytest.mark.parametrize("lookup_rows", [1000, 10])
def test_sweep_of_no_scores(spark, lookup_rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert policy.summarize_strategy(empty, policy.scenarios_table(spark, GRID), lookup_rows=lookup_rows).count() == 0


def test_without_an_exposure_column(spark):
    rows = [(i, i / 20, 0) for i in range(1, 11)]
    got = policy.summarize_strategy(spark.createDataFrame(rows, "loan_id long, xgboost_pd double, bad_12m_90dpd int"),
                                    policy.scenarios_table(spark, [("s", 0.1, 0.3, 0.5)]))
    assert {r.action: (r.loan_count, r.exposure_amount) for r in got.collect()} == {policy.PASS: (2, 2.0), policy.REVIEW: (4, 4.0), policy.REJECT: (4, 4.0)}


@pytest.mark.parametrize("cuts", [(0.3, 0.1), (0.0, 0.5), (0.2, 1.0), (0.2, 0.2), (None, 0.5)])
def test_bad_cutoffs_are_named(spark, cuts):
    table = policy.scenarios_table(spark, [("fine", 0.1, 0.2, 0.4), ("wrong", *cuts, 0.4)])
    with pytest.raises(ValueError, match="cutoffs out of order.*wrong"):
        policy.summarize_strategy(spark.createDataFrame(scores(20), SCHEMA), table)


def test_edges_below(spark):
    values = [None, float("nan"), float("-inf"), -1.0, 0.0, 0.5, 0.50000001, 1.0, 2.0, float("inf")]
    got = ordered.edges_below(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double"), "v", [0.0, 0.5, 1.0], "k")
    assert [r.k for r in got.orderBy("i").collect()] == [None, None, 0, 0, 0, 1, 2, 2, 3, 3]
    none = ordered.edges_below(got.drop("k"), "v", [], "k").orderBy("i").collect()
    assert [r.k for r in none] == [None, None, *[0] * 8]


def test_adhoc_overview(spark):
    rows = [(1, 0.05, 0, 100.0), (2, 0.2, 1, 200.0), (3, 0.9, 1, 300.0), (4, None, 0, 50.0)]
    detail, overview = policy.strategy_summary(spark.createDataFrame(rows, SCHEMA), 0.1, 0.3, 0.5)
    r = overview.first()
    assert (r.non_reject_rate, r.pass_bad_rate, r.booked_expected_loss, r.expected_loss_avoided) == pytest.approx((0.5, 0.0, 2.5 + 20.0, 135.0))
    assert detail.agg(F.sum("action_rate")).first()[0] == pytest.approx(1.0)
    empty, _ = policy.strategy_summary(spark.createDataFrame([], SCHEMA), 0.1, 0.3, 0.5)
    assert [r.loan_count for r in empty.collect()] == [0, 0, 0]
