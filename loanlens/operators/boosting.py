"""Second-order boosted trees by histograms (H4, H5).

Each tree is fitted to first and second derivatives (g, h) of the log loss.  A
leaf's value is ``-G / (H + l2)``, a split's gain what the sum of ``G^2 / (H + l2)``
wins, and a leaf needs ``least_hessian`` of H and ``least_rows`` rows.  Trees grow

* by levels down to ``depth`` (H4), or
* best leaf first up to ``leaves`` leaves (H5).

A leaf's best split doesn't depend on which other leaves are split, so the best-first
tree is a part of the tree in which every leaf is split: leaves that may come up next are
expanded in one pass over the rows, and the order of gains then says which are
kept.  The result is that of one split at a time, in about as many passes as
the tree has levels.

A pass: every task adds (g, h, count) of its rows into a histogram of (node, feature,
bin) and sends that, packed.  Only the smaller child of a split is counted; its
sibling is their parent's histogram less it.  What tasks send is summed in
groups of tasks where there are many, so the driver holds some histograms, whose
size is set by leaves, features and bins, and never by the rows.

Rows are stored once with their bins (a byte a feature; 0: missing) and every
``STORE`` trees with their margins, which cuts the lineage.  Which rows and columns a tree
sees hangs on the seed and the row's key alone, so that a lost task is
repeated alike.  Rows need a key that differs; equal keys are drawn together.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from loanlens.operators.ordered import exact_quantiles
from loanlens.session import materialize

# executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = 25
FAN_IN = 32
TASK_ROWS = 50_000


@dataclass(frozen=True)
class Params:
    """H4's settings are the defaults; ``LEAF_WISE`` has H5's."""

    trees: int = 250
    step: float = 0.05
    depth: int | None = 4
    leaves: int | None = None
    least_hessian: float = 100.0
    least_rows: int = 1
    l2: float = 1.0
    rows: float = 0.8
    columns: float = 0.8
    bins: int = 64
    seed: int = 42


LEAF_WISE = Params(trees=300, depth=None, leaves=31, least_hessian=1e-3, least_rows=100, l2=0.0, rows=1.0, columns=1.0)


@dataclass
class Tree:
    """Nodes by number, the root first; ``feature`` is -1 in a leaf."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)                # bins up to it go left
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def leaf(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, value), (self.gain, 0.0)):
            column.append(x)
        return len(self.value) - 1

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        """Number of the leaf that each row of ``bins`` falls in."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, left, right = (np.array(x, np.int64) for x in (self.feature, self.cut, self.left, self.right))
        missing = np.array(self.missing_left, bool)
        while True:
            go = np.flatnonzero(feature[at] >= 0)
            if not len(go):
                return at
            n = at[go]
            b = bins[go, feature[n]]
            at[go] = np.where(np.where(b == 0, missing[n], b <= cut[n]), left[n], right[n])


def to_bins(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """A byte a value: 0 for NaN, else 1 and the number of the feature's edges below it."""
    out = np.empty(values.shape, np.uint8)
    for f, e in enumerate(edges):
        v = values[:, f]
        out[:, f] = np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, side="left"))
    return out


def drawn(keys: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Which rows a tree sees: 64 mixed bits of key, tree and seed."""
    if share >= 1:
        return np.ones(len(keys), bool)
    z = keys.view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) < share * 2.0 ** 53


def drawn_columns(n: int, tree: int, share: float, seed: int) -> np.ndarray:
    if share >= 1:
        return np.arange(n)
    return np.sort(np.random.default_rng([seed, tree]).permutation(n)[: max(1, int(n * share))])


def derivatives(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return p - y, p * (1 - p)


def add_up(bins: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, width: int) -> np.ndarray:
    """Sums of g, h and 1 by (slot, feature, bin); rows with a slot below 0 don't count."""
    use = slot >= 0
    bins, slot, g, h = bins[use], slot[use], g[use], h[use]
    features = bins.shape[1]
    at = ((slot[:, None] * features + np.arange(features)) * width + bins).ravel()
    size = slots * features * width
    sums = [np.bincount(at, np.repeat(x, features), size) for x in (g, h)]
    return np.stack([*sums, np.bincount(at, minlength=size).astype(float)], -1).reshape(slots, features, width, 3)


@dataclass
class Split:
    gain: float
    feature: int            # among the tree's columns
    cut: int
    missing_left: bool
    left: np.ndarray        # sums of g, h, rows on either side
    right: np.ndarray


def best_split(hist: np.ndarray, p: Params) -> Split | None:
    """The split of a node with the highest gain (of equal ones the first by feature, cut and side of the missing)."""
    total = hist[0].sum(0)
    missing = hist[:, :1]
    upto = np.cumsum(hist[:, 1:], 1)
    left = np.stack([upto + missing, upto], 2)                   # (feature, cut, side of the missing, 3)
    right = total - left
    worth = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + p.l2, 1e-300)
    gain = (worth(left) + worth(right) - worth(total)) / 2
    fine = np.minimum(left[..., 1], right[..., 1]) >= max(p.least_hessian, 1e-12)
    fine &= np.minimum(left[..., 2], right[..., 2]) >= max(p.least_rows, 1)
    gain = np.where(fine, gain, -np.inf)
    # sums of doubles in another order differ in their last digits; equal gains stay equal
    f, c, side = np.unravel_index(int(np.argmax(np.round(gain, 9))), gain.shape)
    if not gain[f, c, side] > 1e-9:
        return None
    return Split(float(gain[f, c, side]), int(f), int(c) + 1, side == 0, left[f, c, side], right[f, c, side])


@dataclass
class Node:
    total: np.ndarray
    depth: int
    hist: np.ndarray | None = None
    split: Split | None = None
    children: tuple[int, int] | None = None


class Grower:
    """Grows one tree; ``count(tree, slots)`` gives the histograms of leaves (tree node number to slot) of a part-grown tree."""

    def __init__(self, count, columns: np.ndarray, p: Params):
        self.count, self.columns, self.p = count, columns, p
        root = count(self.build_leaf(), {0: 0})[0]
        self.nodes = [Node(root[0].sum(0), 0, root)]
        self.look(self.nodes[0])

    @staticmethod
    def build_leaf() -> Tree:
        t = Tree()
        t.leaf(0.0)
        return t

    def look(self, node: Node) -> None:
        if self.p.depth is None or node.depth < self.p.depth:
            node.split = best_split(node.hist, self.p)

    def build(self, wanted: set[int]) -> tuple[Tree, dict[int, int]]:
        """The tree whose inner nodes are ``wanted``, and the number in it of each node."""
        tree, number = Tree(), {}

        def put(i: int) -> int:
            node = self.nodes[i]
            at = number[i] = tree.leaf(float(-node.total[0] / max(node.total[1] + self.p.l2, 1e-300)) * self.p.step)
            if i in wanted:
                s = node.split
                tree.feature[at], tree.cut[at], tree.missing_left[at], tree.gain[at] = int(self.columns[s.feature]), s.cut, s.missing_left, s.gain
                tree.left[at], tree.right[at] = put(node.children[0]), put(node.children[1])
            return at

        put(0)
        return tree, number

    def divide(self, ids: Sequence[int]) -> None:
        for i in ids:
            node = self.nodes[i]
            node.children = (len(self.nodes), len(self.nodes) + 1)
            self.nodes += [Node(node.split.left, node.depth + 1), Node(node.split.right, node.depth + 1)]

    def expand(self, ids: Sequence[int]) -> None:
        """Divide nodes and find their children's histograms and best splits, in one pass."""
        self.divide(ids)
        small = {i: min(self.nodes[i].children, key=lambda c: self.nodes[c].total[2]) for i in ids}
        tree, number = self.build({i for i, n in enumerate(self.nodes) if n.children})
        hists = self.count(tree, {number[c]: k for k, c in enumerate(small.values())})
        for (i, c), hist in zip(small.items(), hists, strict=True):
            parent = self.nodes[i]
            other = sum(parent.children) - c
            self.nodes[c].hist, self.nodes[other].hist = hist, parent.hist - hist
            parent.hist = None
            for x in parent.children:
                self.look(self.nodes[x])

    def by_levels(self) -> Tree:
        level = [0]
        for depth in range(self.p.depth):
            level = [i for i in level if self.nodes[i].split]
            if not level:
                break
            # the last level's children are leaves: their sums are known from the splits
            (self.divide if depth + 1 == self.p.depth else self.expand)(level)
            level = [c for i in level for c in self.nodes[i].children]
        return self.build({i for i, n in enumerate(self.nodes) if n.children})[0]

    def ahead(self, queue: list[tuple[float, int]], left: int) -> list[int]:
        """Nodes whose children aren't known that may be chosen before the tree is full, below nodes expanded earlier as well."""
        queue, out = list(queue), []
        while queue and left:
            j = heapq.heappop(queue)[1]
            left -= 1
            if self.nodes[j].children is None:
                out.append(j)
                continue
            for c in self.nodes[j].children:
                if self.nodes[c].split:
                    heapq.heappush(queue, (-self.nodes[c].split.gain, c))
        return out

    def best_first(self) -> Tree:
        kept: set[int] = set()
        queue = [(-self.nodes[0].split.gain, 0)] if self.nodes[0].split else []
        while queue and len(kept) + 1 < self.p.leaves:
            i = heapq.heappop(queue)[1]
            kept.add(i)
            left = self.p.leaves - 1 - len(kept)
            if self.nodes[i].children is None:
                if not left:
                    self.divide([i])
                    break
                self.expand([i, *self.ahead(queue, left)])
            for c in self.nodes[i].children:
                if self.nodes[c].split:
                    heapq.heappush(queue, (-self.nodes[c].split.gain, c))
        return self.build(kept)[0]

    def grow(self) -> Tree:
        return self.best_first() if self.p.leaves else self.by_levels()


def margins(trees: Sequence[Tree], bins: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bins))
    for t in trees:
        out += np.array(t.value)[t.node_of(bins)]
    return out


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Values of a list column without nulls as a matrix (nulls inside: NaN)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def feature_edges(df: DataFrame, features: str, bins: int) -> list[np.ndarray]:
    """Inner quantiles of each feature's values, each once; what the driver holds is features x bins."""
    long = df.select(F.posexplode(features).alias("feature", "x")).filter("x is not null and not isnan(x)")
    probs = [i / bins for i in range(1, bins)]
    found = {r["feature"]: sorted({r[f"q{i}"] for i in range(len(probs))}) for r in exact_quantiles(long, "x", probs, ["feature"]).collect()}
    n = df.select(F.max(F.size(features))).first()[0] or 0
    return [np.array(found.get(f, []), float) for f in range(n)]


@dataclass
class BoostedModel:
    base: float
    edges: list[np.ndarray]
    trees: list[Tree]

    def pd_of(self, features: Column) -> Column:
        """P(class 1) from an array of feature values: a column of its own, so that other columns stay in the JVM."""
        base, edges, trees = self.base, self.edges, self.trees

        @pandas_udf("double")
        def run(x):
            import pandas as pd
            if not len(x):
                return pd.Series([], dtype=float)
            bins = to_bins(np.array(x.tolist(), float).reshape(len(x), -1), edges)
            return pd.Series(1 / (1 + np.exp(-(base + margins(trees, bins)))))

        return run(features)

    def gains(self) -> np.ndarray:
        """Total gain of each feature."""
        out = np.zeros(len(self.edges))
        for t in self.trees:
            for f, gain in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    out[f] += gain
        return out


def fit(df: DataFrame, features: str, label: str, key: Column, params: Params = Params()) -> BoostedModel:
    """Fit on rows with an array of doubles ``features`` (NULL or NaN inside: missing), a 0/1 ``label`` and a ``key`` to draw rows by."""
    if (params.depth is None) == (params.leaves is None):
        raise ValueError("trees grow either to a depth or to a number of leaves")
    if not 2 <= params.bins <= 255:
        raise ValueError("a bin is a byte: 2 to 255 bins")
    data = df.select(F.xxhash64(key).alias("key"), F.col(label).cast("double").alias("y"), F.col(features).alias("x"))
    edges = feature_edges(data, "x", params.bins)
    width = params.bins + 1
    schema = "key bigint, y double, bins binary, margin double"

    def put_in_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = [r.tobytes() for r in to_bins(_matrix(b.column(2), b.num_rows), edges)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary()), pa.array(np.zeros(b.num_rows))],
                                                 names=["key", "y", "bins", "margin"])

    rows = materialize(data.mapInArrow(put_in_bins, schema))
    n, bad = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n or not 0 < bad < n:
        raise ValueError("boosting needs rows of both classes")
    base = float(np.log(bad / (n - bad)))
    # a task for a few rows costs more than its work: passes are many; stored files may be fewer than the tasks that are due
    tasks = -(-n // TASK_ROWS)
    if rows.rdd.getNumPartitions() < tasks:
        rows = materialize(rows.repartition(tasks))
    tasks = min(rows.rdd.getNumPartitions(), tasks)
    rows = rows.coalesce(tasks)
    trees: list[Tree] = []
    pending: list[Tree] = []

    def count(tree: Tree, slots: dict[int, int], number: int, columns: np.ndarray) -> np.ndarray:
        waiting = list(pending)
        shape = (len(slots), len(columns), width, 3)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            slot_of = np.full(len(tree.value), -1)
            slot_of[list(slots)] = list(slots.values())
            for b in batches:
                if b.num_rows:
                    bins = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                    slot = np.where(drawn(b.column(0).to_numpy(), number, params.rows, params.seed), slot_of[tree.node_of(bins)], -1)
                    g, h = derivatives(base + b.column(3).to_numpy() + margins(waiting, bins), b.column(1).to_numpy())
                    total += add_up(bins[:, columns], slot, g, h, shape[0], width)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())],
                                             names=["task", "sums"])

        def total(table: pa.Table) -> pa.Table:
            found = sorted(zip(table.column("task").to_pylist(), table.column("sums").to_pylist(), strict=True))
            sums = sum(np.frombuffer(s) for _, s in found)
            return pa.table({"task": [found[0][0]], "sums": [sums.tobytes()]}, schema=pa.schema([("task", pa.int64()), ("sums", pa.binary())]))

        sent = rows.mapInArrow(partial, "task bigint, sums binary")
        if tasks > FAN_IN:
            sent = sent.groupBy(F.pmod("task", F.lit(FAN_IN))).applyInArrow(total, "task bigint, sums binary")
        found = sorted((r.task, bytes(r.sums)) for r in sent.collect())          # at most FAN_IN histograms
        return sum(np.frombuffer(s).reshape(shape) for _, s in found)

    def with_margins(batches: Iterator[pa.RecordBatch], waiting: list[Tree]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                new = pa.array(b.column(3).to_numpy() + margins(waiting, bins))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], new], names=["key", "y", "bins", "margin"])

    for number in range(params.trees):
        columns = drawn_columns(len(edges), number, params.columns, params.seed)
        grown = Grower(lambda tree, slots: count(tree, slots, number, columns), columns, params).grow()  # noqa: B023
        trees.append(grown)
        pending.append(grown)
        if len(pending) == STORE and number + 1 < params.trees:
            done = list(pending)
            rows = materialize(rows.mapInArrow(lambda batches: with_margins(batches, done), schema)).coalesce(tasks)  # noqa: B023
            pending = []
    return BoostedModel(base, edges, trees)


def with_params(params: Params, **changes) -> Params:
    return replace(params, **changes)
