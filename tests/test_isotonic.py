"""Isotonic fit by merged block lists against plain pooling."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.operators.isotonic import apply_isotonic, isotonic_blocks


def plain_blocks(rows):
    """Pool one point after the other over all points in order."""
    points = {}
    for s, y in rows:
        if s is not None and s == s and y is not None:
            t, w = points.get(s, (0, 0))
            points[s] = (t + y, w + 1)
    done = []
    for s in sorted(points):
        done.append([s, s, *points[s]])
        while len(done) > 1 and done[-2][2] * done[-1][3] >= done[-1][2] * done[-2][3]:
            _, hi, t, w = done.pop()
            done[-1][1:] = [hi, done[-1][2] + t, done[-1][3] + w]
    return [(lo, hi, t / w, w) for lo, hi, t, w in done]


def plain_value(blocks, s):
    if s is None or s != s:
        return None
    xs, ys = [x for lo, hi, *_ in blocks for x in (lo, hi)], [v for *_, v, _ in blocks for _ in range(2)]
    return float(np.interp(s, xs, ys))


def population(kind, n=4000):
    made = random.Random(kind)
    rows = []
    for _ in range(n):
        s = made.random() if kind != "tied" else made.randrange(40) / 40
        p = {"rising": s ** 2, "falling": 1 - s, "flat": 0.3, "tied": s, "steps": float(int(s * 6)) / 6}[kind]
        rows.append((s, int(made.random() < p)))
    return [*rows, (None, 1), (float("nan"), 1), (0.5, None)]


@pytest.mark.parametrize("kind", ["rising", "falling", "flat", "tied", "steps"])
@pytest.mark.parametrize("buckets", [1, 5, 70])
def test_blocks_and_values(spark, kind, buckets):
    rows = population(kind)
    df = spark.createDataFrame(rows, "s double, y int").repartition(4)
    blocks = isotonic_blocks(df, "s", "y", buckets)
    got, want = sorted(map(tuple, blocks.collect())), plain_blocks(rows)
    assert got == want                                               # exact: whole sums, one division
    if kind == "falling":
        assert len(got) <= 3
    probe = [None, float("nan"), -1.0, 0.0, 0.123, 0.5, 1.0, 7.0, *[s for s, _ in rows[:300]]]
    out = apply_isotonic(spark.createDataFrame([(i, s) for i, s in enumerate(probe)], "i int, s double"), blocks, "s", "p").orderBy("i").collect()
    for r in out:
        v = plain_value(want, probe[r.i])
        assert (r.p is None) == (v is None) and (v is None or r.p == pytest.approx(v, abs=1e-12))


def test_no_points_and_one_point(spark):
    none = isotonic_blocks(spark.createDataFrame([(None, 1)], "s double, y int"), "s", "y")
    assert none.count() == 0
    target = spark.createDataFrame([(0.1,), (0.9,)], "s double")
    assert [r.p for r in apply_isotonic(target, none, "s", "p").collect()] == [None, None]
    one = isotonic_blocks(spark.createDataFrame([(0.5, 1), (0.5, 0)], "s double, y int"), "s", "y")
    assert [tuple(r) for r in one.collect()] == [(0.5, 0.5, 0.5, 2.0)]
    assert [r.p for r in apply_isotonic(target, one, "s", "p").collect()] == [0.5, 0.5]


def test_fit_is_rising_and_keeps_the_mean(spark):
    df = spark.createDataFrame(population("rising"), "s double, y int")
    blocks = isotonic_blocks(df, "s", "y", 6).orderBy("lo").collect()
    assert all(a.value < b.value and a.hi < b.lo for a, b in zip(blocks[:-1], blocks[1:], strict=True))
    whole = df.filter("s is not null and not isnan(s)").agg(F.avg("y")).first()[0]
    assert sum(b.value * b.weight for b in blocks) / sum(b.weight for b in blocks) == pytest.approx(whole)
