"""Boosted trees by distributed histograms against a plain version that holds all rows."""

import dataclasses

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from loanlens.operators import boosting as B


def population(n=1500, seed=1):
    made = np.random.default_rng(seed)
    x = made.normal(size=(n, 5))
    x[:, 2] = made.integers(0, 2, n)
    x[:, 3] = np.round(x[:, 3])
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] * (x[:, 2] - 0.5) + np.sin(2 * x[:, 1]) + 0.5 * x[:, 3] - 1)))
    y = (made.random(n) < p).astype(int)
    x[made.random((n, 5)) < 0.05] = np.nan
    return x, y


def frame(spark, x, y):
    rows = [(i, [None if np.isnan(v) else float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, x array<double>, y int")


def plain_split(bins, g, h, columns, p):
    """Try every feature, cut and side of the missing, summing rows anew."""
    best = None
    for f in columns:
        b = bins[:, f]
        for cut in range(1, p.bins + 1):
            for missing_left in (True, False):
                go = np.where(b == 0, missing_left, b <= cut)
                sums = [(g[s].sum(), h[s].sum(), s.sum()) for s in (go, ~go)]
                if min(s[1] for s in sums) < max(p.least_hessian, 1e-12) or min(s[2] for s in sums) < max(p.least_rows, 1):
                    continue
                worth = lambda a, c: a * a / (c + p.l2)
                gain = round((sum(worth(*s[:2]) for s in sums) - worth(g.sum(), h.sum())) / 2, 9)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, f, cut, missing_left, go)
    return best


def plain_fit(x, y, keys, edges, p):
    """One split at a time over all rows, whatever the way of growing; margins of all rows and the trees' nodes."""
    bins = B.to_bins(x, edges)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    shapes = []
    for t in range(p.trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        seen = B.drawn(keys, t, p.rows, p.seed)
        columns = B.drawn_columns(x.shape[1], t, p.columns, p.seed)
        whole = np.ones(len(y), bool)
        leaves = [(whole, 0, plain_split(bins[seen], g[seen], h[seen], columns, p))]
        splits = []
        while True:
            open_ = [i for i, (_, d, s) in enumerate(leaves) if s and (p.depth is None or d < p.depth)]
            if not open_ or (p.leaves and len(leaves) >= p.leaves):
                break
            i = max(open_, key=lambda i: leaves[i][2][0]) if p.leaves else open_[0]
            mine, d, s = leaves.pop(i)
            b = bins[:, s[1]]
            go = np.where(b == 0, s[3], b <= s[2])
            splits.append((d, int(s[1]), s[2], round(s[0], 6)))
            for side in (mine & go, mine & ~go):
                use = side & seen
                leaves.append((side, d + 1, plain_split(bins[use], g[use], h[use], columns, p)))
        for side, *_ in leaves:
            use = side & seen
            margin[side] -= p.step * g[use].sum() / (h[use].sum() + p.l2)
        shapes.append(sorted(splits))
    return margin, shapes


def shape(tree):
    out, todo = [], [(0, 0)]
    while todo:
        i, d = todo.pop()
        if tree.feature[i] >= 0:
            out.append((d, tree.feature[i], tree.cut[i], round(tree.gain[i], 6)))
            todo += [(tree.left[i], d + 1), (tree.right[i], d + 1)]
    return sorted(out)


LEVELS = B.Params(trees=6, step=0.3, depth=3, least_hessian=3.0, bins=12)
BEST = dataclasses.replace(B.LEAF_WISE, trees=5, step=0.3, leaves=9, least_rows=20, bins=12)


@pytest.mark.parametrize("params", [LEVELS, BEST, dataclasses.replace(LEVELS, depth=1, rows=1.0, columns=0.5),
                                    dataclasses.replace(BEST, leaves=2, l2=1.0), dataclasses.replace(LEVELS, least_hessian=1e9)])
def test_same_trees_as_plain(spark, params, monkeypatch):
    monkeypatch.setattr(B, "STORE", 4)                     # margins are stored on the way
    monkeypatch.setattr(B, "FAN_IN", 2)                    # and histograms summed in groups
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    x, y = population(700)
    df = frame(spark, x, y).repartition(5)
    model = B.fit(df, "x", "y", F.col("id"), params)
    keys = {r.id: r.k for r in df.select("id", F.xxhash64("id").alias("k")).collect()}
    margin, shapes = plain_fit(x, y, np.array([keys[i] for i in range(len(y))], np.int64), model.edges, params)
    assert [shape(t) for t in model.trees] == shapes
    got = {r.id: r.p for r in df.select("id", model.pd_of(F.col("x")).alias("p")).collect()}
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-margin)), atol=1e-9)
    gains = np.zeros(5)
    for s in shapes:
        for _, f, _, gain in s:
            gains[f] += gain
    assert np.allclose(model.gains(), gains, atol=1e-4)


def test_limits_hold(spark):
    x, y = population(1500)
    df = frame(spark, x, y)
    best = B.fit(df, "x", "y", F.col("id"), dataclasses.replace(B.LEAF_WISE, trees=3, least_rows=10))
    assert all(sum(f < 0 for f in t.feature) == 31 for t in best.trees)
    strict = B.fit(df, "x", "y", F.col("id"), B.Params(trees=3, least_hessian=60.0, rows=1.0, columns=1.0))
    bins = B.to_bins(x, strict.edges)
    first = strict.trees[0]
    prior = y.mean() * (1 - y.mean())
    for n in np.unique(first.node_of(bins), return_counts=True)[1]:
        assert n * prior >= 60


def test_not_below_gbt(spark):
    x, y = population(3000, 2)
    x = np.nan_to_num(x)
    df = frame(spark, x, y).cache()
    train, test = df.filter("id % 3 > 0"), df.filter("id % 3 = 0")
    area = lambda scored: BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y").evaluate(scored)
    mine = B.fit(train, "x", "y", F.col("id"), B.Params(trees=20, step=0.2, least_hessian=5.0))
    best = B.fit(train, "x", "y", F.col("id"), dataclasses.replace(B.LEAF_WISE, trees=20, step=0.1, least_rows=40))
    vec = lambda d: d.withColumn("v", array_to_vector("x"))
    gbt = GBTClassifier(featuresCol="v", labelCol="y", maxIter=20, stepSize=0.2, maxDepth=4, minInstancesPerNode=20, seed=1).fit(vec(train))
    theirs = area(gbt.transform(vec(test)).select("y", vector_to_array("probability")[1].alias("p")))
    for model in (mine, best):
        assert area(test.select("y", model.pd_of(F.col("x")).alias("p"))) >= theirs - 0.01
    df.unpersist()


def test_bad_input(spark):
    df = frame(spark, *population(50)).withColumn("y", F.lit(1))
    with pytest.raises(ValueError, match="both classes"):
        B.fit(df, "x", "y", F.col("id"))
    with pytest.raises(ValueError, match="depth or"):
        B.fit(df, "x", "y", F.col("id"), B.Params(leaves=31))


def test_best_first_needs_few_passes():
    """A pass over the rows for about every level of the tree, not for about every other leaf."""
    x, y = population(6000)
    p = B.with_params(B.LEAF_WISE, least_rows=5, bins=32)
    edges = [np.unique(np.nanquantile(x[:, f], np.arange(1, p.bins) / p.bins)) for f in range(x.shape[1])]
    bins = B.to_bins(x, edges)
    g, h = B.derivatives(np.zeros(len(y)), y)
    passes = []

    def count(tree, slots):
        passes.append(len(slots))
        slot_of = np.full(len(tree.value), -1)
        slot_of[list(slots)] = list(slots.values())
        return B.add_up(bins, slot_of[tree.node_of(bins)], g, h, len(slots), p.bins + 1)

    tree = B.Grower(count, np.arange(x.shape[1]), p).grow()
    depth = [0] * len(tree.feature)
    for i, f in enumerate(tree.feature):
        if f >= 0:
            depth[tree.left[i]] = depth[tree.right[i]] = depth[i] + 1
    assert tree.feature.count(-1) == p.leaves
    assert len(passes) <= max(depth) + 2, (len(passes), max(depth))
