"""Medians, scales and category slots against plain versions."""

import collections
import random
import statistics

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from loanlens.operators import models as ML
from loanlens.operators import ordered
from loanlens.operators import preprocess as PP


def rows(n=900):
    made = random.Random(2)
    value = lambda: made.choice([None, float("nan"), round(made.gauss(3, 2), 2), round(made.gauss(3, 2), 2)])
    return [(i, value(), made.choice([None, made.randrange(9)]), None, made.choice([None, *"abc", f"z{made.randrange(60):02d}"]), "only", None) for i in range(n)]


SCHEMA = "loan_id long, x double, `k y` int, nothing double, c string, one string, none string"


@pytest.mark.parametrize("few", [100_000, 3])
def test_against_plain(spark, monkeypatch, few):
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", few)           # small dictionaries are joined by a shuffle then
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    prep = PP.fit_preparation(df, ["x", "k y", "nothing"], ["c", "one", "none"], 20)
    filled = []
    for at, name in ((1, "x"), (2, "k y")):
        seen = [r[at] for r in data if r[at] is not None and r[at] == r[at]]
        median = statistics.median(seen)
        column = np.array([r[at] if r[at] is not None and r[at] == r[at] else median for r in data], float)
        assert prep.stats[name] == pytest.approx((median, column.mean(), column.std()), rel=1e-12)
        filled.append((column - column.mean()) / column.std())
    assert prep.stats["nothing"] == (0.0, 0.0, 0.0)
    counts = collections.Counter(r[4] for r in data if r[4] is not None)
    mode = min(counts, key=lambda v: (-counts[v], v))
    counts[mode] += sum(r[4] is None for r in data)
    kept = sorted(v for v in counts if counts[v] >= 20)
    assert 3 <= len(kept) < len(counts) and prep.modes["c"] == mode
    assert prep.names() == ["x", "k y", "nothing", *[f"c_{v}" for v in kept], f"c_{PP.RARE}", "one_only"]
    slot = {v: kept.index(v) if v in kept else len(kept) for v in counts}
    target = df.unionByName(spark.createDataFrame([(10_000, 1.0, 1, None, "never seen", "other", "some")], SCHEMA))
    out = target
    for st in [None, *prep.stages(scale=True)]:
        out = prep.slots(out) if st is None else st.transform(out)
    got = {r.loan_id: r.f for r in out.select("loan_id", vector_to_array("features").alias("f")).collect()}
    assert len(got) == len(data) + 1
    for i, r in enumerate(data):
        hot = [0.0] * (len(kept) + 2)
        hot[slot[mode if r[4] is None else r[4]]] = hot[-1] = 1.0
        assert got[r[0]] == pytest.approx([filled[0][i], filled[1][i], 0.0, *hot], abs=1e-9)
    assert got[10_000][3:] == [0.0] * (len(kept) + 2)              # unseen values have no slot


def test_equal_counts_take_the_smallest_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    got = {r.value: (r.n, r["mode"], r.slot) for r in PP.category_dictionary(df, ["c"], 3).collect()}
    assert got == {"a": (3, "a", 0), "b": (2, "a", 1)}             # b is rare: the slot after the kept ones


@pytest.mark.parametrize("estimator", [ML.boosting.Params(trees=3, least_hessian=1.0), ML.boosting.with_params(ML.boosting.LEAF_WISE, trees=2, least_rows=5)])
def test_boosted_trees_as_estimators(spark, estimator):
    made = random.Random(7)
    data = [(i, made.gauss(0, 1) if made.random() < 0.9 else None, made.choice(["p", "q", None])) for i in range(400)]
    df = spark.createDataFrame([(*r, int((r[1] or 0) + (r[2] == "p") > 0.5)) for r in data], "loan_id long, x double, c string, bad_12m_90dpd int")
    m = ML.fit(df, "trees", estimator, min_frequency=5)
    assert m.feature_names() == ["x", "c_p", "c_q"]
    scored = m.score(df, "pd")
    assert scored.columns == [*df.columns, "pd"] and scored.select(*df.columns).exceptAll(df).count() == 0
    rows_ = scored.collect()
    mean = lambda y: np.mean([r.pd for r in rows_ if r.bad_12m_90dpd == y])
    assert all(0 < r.pd < 1 for r in rows_) and mean(1) > mean(0) + 0.02
    assert ML.importance(m).first().feature in ("x", "c_p", "c_q") and min(m.gains()) >= 0
