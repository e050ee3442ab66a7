"""Operator 5: quality classifier by ordinal cumulative-link regression.

Labelled documents have graded ratings: 0 toxic, 1 of low quality, 2 good.  One
weight vector over hashed text features is shared by all grades; ordered
thresholds cut its score ``s`` into grades, ``P(grade >= j) = sigmoid(s -
threshold_j)``.  The expected grade is the sum of these tail probabilities,
and a document is kept if the tail probability of the best grade reaches a
cutoff chosen on held-out labelled documents: the one with the fewest errors
that still loses at most ``LOSS`` of the good ones.

Features are the distinct words of a text (letters and digits) and levels of a
few shape figures (capitals, symbols, repeated words, ...), all hashed into
``2 ** BITS`` places.

The model is fitted on at most ``FIT_ROWS`` labelled documents, chosen by hash
and with an equal bound for each grade; a fifth of them is held out.  All
documents are scored, block by block in numpy, with the weights (1 MB)
broadcast.  Nothing is shuffled.

Defined results: a null text counts as empty and is scored by its shape alone;
labels with a null grade are left out; with no labels, or labels of one grade
only, everything has the expected grade 2 and is kept; repeated rows are scored
each; all other columns pass through; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import documents, join_small, stash
from loanlens.llm.shingles import Shingler, blocks, mix, texts_of

BITS = 18
FIT_ROWS = 12_000
LOSS = 0.005
GRADES = 3
EPOCHS = 30
FAR = 5.0
HEADS = (4, 6, 8)      # bytes of a long word's beginning that make a feature of their own
LETTERS = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
SYMBOLS = b"#*$%&|<>"


class Features:
    """Hashed feature places of a block of texts."""

    def __init__(self):
        self.words = Shingler(1, LETTERS)
        self.is_symbol, self.is_capital = np.zeros(256, bool), np.zeros(256, bool)
        self.is_symbol[list(SYMBOLS)] = True
        self.is_capital[65:91] = True

    def places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Place and text number of every feature, each place once a text, in order of texts."""
        m = len(texts)
        h, own = self.words.words(texts, HEADS)
        place = lambda o, x: o.astype(np.int64) << BITS | (x >> np.uint64(64 - BITS)).astype(np.int64)
        word = np.unique(place(own, h))
        heads = [place(o, x) for x, o in self.words.heads]
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        start = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])[:-1]
        per = lambda mask: np.add.reduceat(mask.astype(np.int64), start) if m else np.empty(0, np.int64)
        n = np.bincount(own, minlength=m)
        distinct = np.bincount(word >> BITS, minlength=m)
        twin = np.concatenate([[False], (h[1:] == h[:-1]) & (own[1:] == own[:-1])]) if len(h) else np.empty(0, bool)
        again = np.bincount(own[twin], minlength=m)
        size = np.array([len(r) for r in raw], np.int64)
        lines = per(data == 10)
        some = np.maximum(n, 1)
        shape = [
            np.log2(1 + n), 8 * per(self.is_capital[data]) / some, 8 * per(self.is_symbol[data]) / some,
            8 * per(data == 33) / some, 10 * again / some, 10 * distinct / some, size / some, 20 * lines / some,
        ]
        level = np.stack([np.minimum(x, 15).astype(np.int64) for x in shape], 1) if m else np.empty((0, len(shape)), np.int64)
        codes = mix((level + 64 * np.arange(1, len(shape) + 1)).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        shapes = np.arange(m)[:, None] << BITS | (codes >> np.uint64(64 - BITS)).astype(np.int64)
        both = np.unique(np.concatenate([word, *heads, shapes.ravel()]))
        return both & ((1 << BITS) - 1), both >> BITS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray | None, thresholds: np.ndarray, cutoff: float):
        self.weights, self.thresholds, self.cutoff = weights, thresholds, cutoff

    def tails(self, places: np.ndarray, own: np.ndarray, m: int) -> np.ndarray:
        """P(grade >= j) for j = 1 .. GRADES - 1, a row for each of ``m`` texts."""
        if self.weights is None:
            return np.ones((m, GRADES - 1))
        s = np.bincount(own, self.weights[places], m)
        return _sigmoid(s[:, None] - self.thresholds)


def fit(rows: list[np.ndarray], grades: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-3, least: int = 5, far: float = FAR) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by maximum likelihood (adaptive gradient steps over blocks of texts)."""
    rng = np.random.default_rng(5)
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    cut, c2 = np.array([-1.0, 1.0]), np.full(GRADES - 1, 1e-6)
    weight = (len(grades) / np.maximum(np.bincount(grades, minlength=GRADES), 1)) ** 0.5
    weight /= weight[grades].mean()
    # only places that go with a grade: their share there is off by more than FAR standard errors
    m = len(rows)
    counts = np.stack([np.bincount(np.concatenate([r for r, y in zip(rows, grades, strict=True) if y == g] or [rows[0][:0]]),
                                   minlength=1 << BITS) for g in range(GRADES)])
    times = counts.sum(0)
    of_grade = np.bincount(grades, minlength=GRADES)[:, None] / m
    error = np.sqrt(np.maximum(times * of_grade * (1 - of_grade) * (1 - times / m), 1e-9))
    z = np.abs(counts - times * of_grade) / error
    useful = (times >= least) & (z.max(0) > far)
    rows = [r[useful[r]] for r in rows]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            idx = order[at:at + 64]
            own = np.repeat(np.arange(len(idx)), [len(rows[i]) for i in idx])
            places = np.concatenate([rows[i] for i in idx])
            y = grades[idx]
            s = np.bincount(own, w[places], len(idx))
            # P(y) = F(s - cut[y-1]) - F(s - cut[y]), with cuts at -inf and inf outside
            up = np.where(y > 0, _sigmoid(s - cut[np.maximum(y - 1, 0)]), 1.0)
            down = np.where(y < GRADES - 1, _sigmoid(s - cut[np.minimum(y, GRADES - 2)]), 0.0)
            p = np.maximum(up - down, 1e-12)
            du, dd = up * (1 - up), down * (1 - down)
            slope = weight[y] * (du - dd) / p
            grad = np.bincount(places, slope[own], 1 << BITS)
            hit = np.unique(places)
            gr = grad[hit] / len(idx) - decay * w[hit]
            g2[hit] += gr * gr
            w[hit] += rate * gr / np.sqrt(g2[hit])
            gc = np.zeros(GRADES - 1)
            np.add.at(gc, np.maximum(y - 1, 0)[y > 0], (-weight[y] * du / p)[y > 0])
            np.add.at(gc, np.minimum(y, GRADES - 2)[y < GRADES - 1], (weight[y] * dd / p)[y < GRADES - 1])
            gc /= len(idx)
            c2 += gc * gc
            cut = np.sort(cut + rate * gc / np.sqrt(c2))
    return w, cut


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          fit_rows: int = FIT_ROWS, loss: float = LOSS) -> OrdinalModel:
    """Model from ``labels`` (id, quality 0/1, toxic 0/1) and their texts."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rated = labels.select(F.col(id_col).alias("_id"), grade.alias("_grade")).filter("_grade is not null and _id is not null")
    counts = {r["_grade"]: r["count"] for r in rated.groupBy("_grade").count().collect()}
    nothing = OrdinalModel(None, np.zeros(GRADES - 1), 0.0)
    if len(counts) < 2:
        return nothing
    each = fit_rows // len(counts)
    draw = F.pmod(F.xxhash64("_id"), F.lit(1_000_000))
    share = F.lit(0)
    for g, n in counts.items():
        share = F.when(F.col("_grade") == g, int(1_000_000 * min(1.0, each / n))).otherwise(share)
    chosen = stash(rated.filter(draw < share))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sample = join_small(texts, chosen.dropDuplicates(["_id"]), ["_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats = Features()
        for batch in batches:
            at = 0
            for block in blocks(texts_of(batch.column(1))):
                places, own = feats.places(block)
                cuts = np.searchsorted(own, np.arange(len(block) + 1))
                part = batch.slice(at, len(block))
                at += len(block)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(
                    [places[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                    names=["_id", "_grade", "places"])

    schema = sample.select("_id", "_grade", F.lit(b"").alias("places")).schema
    got = sample.select("_id", "_text", "_grade").mapInArrow(run, schema).collect()     # at most about fit_rows rows
    got.sort(key=lambda r: (r["_id"], r["places"]))
    rows = [np.frombuffer(r["places"], np.int32) for r in got]
    grades = np.array([r["_grade"] for r in got], np.int64)
    held = np.arange(len(rows)) % 5 == 4
    if len(np.unique(grades[~held])) < 2:
        return nothing
    w, cut = fit([r for r, h in zip(rows, held, strict=True) if not h], grades[~held])
    model = OrdinalModel(w.astype(np.float32), cut, 0.5)
    test = [r for r, h in zip(rows, held, strict=True) if h]
    if test:
        own = np.repeat(np.arange(len(test)), [len(r) for r in test])
        p = model.tails(np.concatenate(test), own, len(test))[:, -1]
        good = grades[held] == GRADES - 1
        steps = np.arange(0.02, 1.0, 0.02)
        errors = np.array([(p[good] < c).mean() if good.any() else 0.0 for c in steps])
        missed = np.array([(p[~good] >= c).mean() if (~good).any() else 0.0 for c in steps])
        allowed = errors <= loss
        model.cutoff = float(steps[np.where(allowed, errors + missed, 9).argmin()]) if allowed.any() else float(steps[0])
    return model


def classify(docs: DataFrame, model: OrdinalModel, text_col: str = "text",
             grade_col: str = "expected_grade", tail_col: str = "p_good", keep_col: str = "kept") -> DataFrame:
    """``docs`` with expected grade, tail probability of the best grade and the verdict."""
    new = (grade_col, tail_col, keep_col)
    keep = [c for c in docs.columns if c not in new]
    schema = docs.select(*keep, F.lit(0.0).alias(grade_col), F.lit(0.0).alias(tail_col), F.lit(True).alias(keep_col)).schema
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.cutoff))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model, feats = OrdinalModel(*shared.value), Features()
        for batch in batches:
            at = 0
            for block in blocks(texts_of(batch.column(batch.schema.get_field_index(text_col)))):
                places, own = feats.places(block)
                tails = np.round(own_model.tails(places, own, len(block)), 6)
                part = batch.slice(at, len(block))
                at += len(block)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.round(tails.sum(1), 6)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= own_model.cutoff)],
                    names=[*part.schema.names, *new])

    return docs.select(*keep).mapInArrow(run, schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "p_good", "kept")
