"""Operator 1: language-model scoring with a log-bilinear neural model.

The model predicts the next token from the one before: the log score of token
``w`` after ``u`` is bilinear, ``(r_u * c) . q_w + b_w`` with learned vectors
``r`` and ``q``.  It is trained in numpy by noise-contrastive estimation: to
tell observed pairs from pairs whose second token is drawn from the unigram
distribution.  The expectation over the noise is taken exactly, so training
needs only how often each pair occurs in the training documents; these counts
come from all of them and are the model's sufficient statistics.  For scoring,
products of context blocks with all outputs give log-softmax rows, so token
log-probabilities are normalised.

The model's outputs are the ``VOCAB`` most frequent training words, the end of
a text, and ``GROUPS`` groups of all other words (by their last two bytes).  A
word of a group then has probability ``(c + 1) / (N_g + V_g + 1)`` in it, so
the whole is a distribution over the training words and an unseen one a group.

Scale: words are 64-bit keys made in numpy.  Counts are combined in each task
and summed in packed blocks.  Counts of at most ``HEAD`` frequent words are
broadcast; rarer ones, of which no single word is frequent, reach the documents
by a join.  The driver gets the frequent words and the pair counts, whose
size is bounded by ``HEAD`` and the square of the model's outputs.

Defined results: a null text counts as empty and is one token, the end; a null
id is hashed as an empty one; repeated rows are scored (and learned from) each;
without training documents every word has count 0 and the model is uniform;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import documents, stash
from loanlens.llm.shingles import Shingler, blocks, mix, texts_of

VOCAB = 1920
GROUPS = 128
HEAD = 1 << 18
DIMS = 32
NOISE = 16               # noise pairs for each observed one
EPOCHS = 40
CONTEXTS = 256           # contexts of a training block
END = np.uint64(0)       # key of the end of a text; words have keys from GROUPS on
FLUSH_TOKENS = 2_000_000


class Tokens:
    """Word keys of blocks of texts: a hash whose low bits are the word's group."""

    def __init__(self):
        self.words = Shingler(1)

    def load(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Key and text number of every token, the end of each text included, in order."""
        h, own = self.words.words(texts, tail=2)
        group = self.words.tails >> np.uint64(57)
        key = (h & ~np.uint64(GROUPS - 1)) | group
        key = np.where(key < GROUPS, key + np.uint64(GROUPS), key)
        at = np.searchsorted(own, np.arange(len(texts)), side="right")
        return np.insert(key, at, END), np.insert(own, at, np.arange(len(texts)))


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(7)) == 2


def _parts(spark: SparkSession) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_counts(train: DataFrame) -> DataFrame:
    """``key, c`` of every distinct token of the training texts."""
    n = _parts(train.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        keys, times, held = [], [], 0

        def merged():
            k, t = np.concatenate(keys), np.concatenate(times)
            k, at = np.unique(k, return_inverse=True)
            return k, np.bincount(at, t).astype(np.int64)

        def flush() -> pa.RecordBatch:
            k, t = merged()
            to = mix(k) % np.uint64(n)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(n + 1, dtype=np.uint64))
            out = [(i, k[o].tobytes(), t[o].tobytes()) for i in range(n) if len(o := order[cuts[i]:cuts[i + 1]])]
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())],
                                              names=["block", "keys", "times"])

        for batch in batches:
            for block in blocks(texts_of(batch.column(0))):
                k, t = np.unique(tokens.load(block)[0], return_counts=True)
                keys.append(k)
                times.append(t)
                held += len(k)
                if held >= FLUSH_TOKENS:
                    yield flush()
                    keys, times, held = [], [], 0
        if held:
            yield flush()

    def total(table: pa.Table) -> pa.Table:
        k = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
        t = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("times").to_pylist()])
        k, at = np.unique(k, return_inverse=True)
        return pa.table({"key": k.view(np.int64), "c": np.bincount(at, t).astype(np.int64)})

    packed = train.select("text").mapInArrow(count, "block int, keys binary, times binary")
    return packed.groupBy("block").applyInArrow(total, "key bigint, c bigint")


class Vocabulary:
    """Frequent words with their counts, the model's outputs, and what is left to each group."""

    def __init__(self, counts: DataFrame, vocab: int = VOCAB, head: int = HEAD):
        sums = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
        self.total, self.distinct = int(sums[0] or 0), int(sums[1])
        # the lowest count that at most ``head`` words reach
        left, self.least = head, 1 << 62
        for r in sorted(counts.groupBy("c").count().collect(), key=lambda r: -r["c"]):     # one row a count, not a word
            left -= r["count"]
            if left < 0:
                break
            self.least = r["c"]
        got = counts.filter(F.col("c") >= self.least).toArrow()                            # at most ``head`` rows
        key, c = got.column("key").to_numpy().view(np.uint64), got.column("c").to_numpy()
        order = np.argsort(key)
        self.key, self.count = key[order], c[order]
        ranked = np.lexsort((self.key, -self.count))
        ranked = ranked[self.key[ranked] != END][:vocab]
        # outputs: the end, the words, the groups
        self.output = np.full(len(self.key), -1, np.int32)
        self.output[ranked] = 1 + np.arange(len(ranked))
        self.output[self.key == END] = 0
        self.width = 1 + len(ranked) + GROUPS
        per = {r["g"]: (r["n"], r["v"]) for r in counts.groupBy((F.col("key").bitwiseAND(F.lit(GROUPS - 1))).alias("g")).agg(
            F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
        inside = self.output >= 0
        group = (self.key & np.uint64(GROUPS - 1)).astype(np.int64)
        n_in = np.bincount(group[inside], self.count[inside], GROUPS)
        v_in = np.bincount(group[inside], minlength=GROUPS)
        self.rest = np.array([sum(per.get(g, (0, 0))) for g in range(GROUPS)], float) - n_in - v_in + 1     # N_g + V_g + 1

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and count of each key; the count is -1 for a word that isn't among the frequent ones."""
        group = (self.width - GROUPS + (key & np.uint64(GROUPS - 1))).astype(np.int32)
        if not len(self.key):
            return np.where(key == END, 0, group), np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        known = self.key[at] == key
        out = np.where(known, self.output[at], -1)
        return np.where(key == END, 0, np.where(out >= 0, out, group)), np.where(known, self.count[at], -1)


def pair_counts(train: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each output follows each other in the training texts (a text begins after an end)."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    width = vocabulary.width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, v = Tokens(), shared.value
        seen = np.zeros(width * width, np.int64)
        for batch in batches:
            for block in blocks(texts_of(batch.column(0))):
                out = v.look_up(tokens.load(block)[0])[0].astype(np.int64)
                code, times = np.unique(np.concatenate([[0], out[:-1]]) * width + out, return_counts=True)
                seen[code] += times
        rows = seen.reshape(width, width)
        used = np.flatnonzero(rows.any(1))
        for at in range(0, len(used), 256):
            some = used[at:at + 256]
            cells = [np.flatnonzero(rows[u]) for u in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([c.astype(np.int32).tobytes() for c in cells], pa.binary()),
                 pa.array([rows[u][c].tobytes() for u, c in zip(some, cells, strict=True)], pa.binary())], names=["context", "outs", "times"])

    def total(table: pa.Table) -> pa.Table:
        o = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("outs").to_pylist()])
        t = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("times").to_pylist()])
        row = np.bincount(o, t, width).astype(np.int64)
        cells = np.flatnonzero(row)
        return pa.table({"context": pa.array([table.column("context")[0].as_py()], pa.int32()),
                         "outs": pa.array([cells.astype(np.int32).tobytes()], pa.binary()), "times": pa.array([row[cells].tobytes()], pa.binary())})

    schema = "context int, outs binary, times binary"
    got = train.select("text").mapInArrow(count, schema).groupBy("context").applyInArrow(total, schema).collect()   # at most width rows
    pairs = np.zeros((width, width), np.float32)
    for r in got:
        pairs[r["context"], np.frombuffer(r["outs"], np.int32)] = np.frombuffer(r["times"], np.int64)
    return pairs


class LogBilinear:
    """Context vectors, output vectors and output biases."""

    def __init__(self, contexts: np.ndarray, outputs: np.ndarray, bias: np.ndarray):
        self.contexts, self.outputs, self.bias = contexts, outputs, bias

    def log_probs(self, rows: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of all outputs after each context of ``rows``."""
        s = self.contexts[rows] @ self.outputs.T + self.bias
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))


def train_nce(pairs: np.ndarray, dims: int = DIMS, noise: int = NOISE, epochs: int = EPOCHS, rate: float = 0.02) -> LogBilinear:
    """Fit by noise-contrastive estimation over the pair counts (adaptive moments, blocks of contexts)."""
    rng = np.random.default_rng(11)
    width = len(pairs)
    total = float(pairs.sum())
    unigram = ((pairs.sum(0) + 0.5) / (total + 0.5 * width)).astype(np.float32)
    p = [rng.normal(0, 0.1, (width, dims)).astype(np.float32), rng.normal(0, 0.1, (width, dims)).astype(np.float32),
         np.log(unigram).astype(np.float32)]
    if not total:
        return LogBilinear(np.zeros_like(p[0]), np.zeros_like(p[1]), np.zeros_like(p[2]))
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    shift = np.log(noise * unigram)
    steps = 0
    for epoch in range(epochs):
        order = rng.permutation(width)
        pace = rate * (1 - epoch / epochs)
        for at in range(0, width, CONTEXTS):
            rows = order[at:at + CONTEXTS]
            seen = pairs[rows]
            n = seen.sum(1, keepdims=True)
            r = p[0][rows]
            data = 1 / (1 + np.exp(np.clip(shift - (r @ p[1].T + p[2]), -30, 30)))     # P(observed, not noise)
            # a context's weight: the root of its frequency, so that rare contexts learn as well
            slope = (seen * (1 - data) - noise * n * unigram * data) / np.sqrt(n + 1)
            scale = 1 / np.sqrt(total / width)
            grads = [np.zeros_like(p[0]), scale * (slope.T @ r), scale * slope.sum(0)]
            grads[0][rows] = scale * (slope @ p[1]) - 1e-4 * r
            steps += 1
            for i, g in enumerate(grads):
                part = rows if i == 0 else slice(None)
                m[i][part] = 0.9 * m[i][part] + 0.1 * g[part]
                v[i][part] = 0.99 * v[i][part] + 0.01 * g[part] ** 2
                p[i][part] += pace * (m[i][part] / (1 - 0.9 ** steps)) / (np.sqrt(v[i][part] / (1 - 0.99 ** steps)) + 1e-6)
    return LogBilinear(*p)


def score_texts(docs: DataFrame, vocabulary: Vocabulary, model: LogBilinear, counts: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, base_score, score`` from rows ``doc_id, held_out, text``."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))
    schema = ("doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double, "
              "rare array<bigint>, times array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, lm = shared.value
        tokens = Tokens()
        # all rows of the normalised model, a block of contexts at a time
        table = np.concatenate([lm.log_probs(np.arange(a, min(a + 512, v.width))) for a in range(0, v.width, 512)]) / np.float32(np.log(10))
        for batch in batches:
            at = 0
            for block in blocks(texts_of(batch.column(2))):
                m = len(block)
                key, own = tokens.load(block)
                out, c = v.look_up(key)
                common = c >= 0
                logc = np.log10(np.maximum(c, 0) + 1.0)
                step = table[np.concatenate([[0], out[:-1]]), out].astype(float)
                grouped = out >= v.width - GROUPS
                step -= np.where(grouped, np.log10(v.rest)[np.where(grouped, out - (v.width - GROUPS), 0)], 0.0)
                step += np.where(grouped & common, logc, 0.0)
                sums = [np.bincount(own, x, m) for x in (np.ones(len(own)), common & (c > 0), np.where(common, logc, 0.0), step)]
                pair = np.stack([own[~common].astype(np.uint64), key[~common]], 1)
                order = np.lexsort((pair[:, 1], pair[:, 0]))
                pair = pair[order]
                new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]).any(1)])) if len(pair) else np.empty(0, np.int64)
                times = np.diff(np.append(new, len(pair)))
                cuts = np.searchsorted(pair[new, 0], np.arange(m + 1, dtype=np.uint64)).astype(np.int32)
                part = batch.slice(at, m)
                at += m
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]),
                     pa.array(sums[3]), pa.ListArray.from_arrays(cuts, pa.array(pair[new, 1].view(np.int64))),
                     pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "times"])

    scored = stash(docs.select("doc_id", "held_out", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("t"))
    known = counts.filter(F.col("c") < vocabulary.least)
    found = rare.join(known, "key").groupBy("row").agg(F.sum("t").alias("_known"), F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("_logc"))
    both = scored.drop("rare", "times").join(found, "row", "left")
    logc = F.coalesce("_logc", F.lit(0.0))
    whole = float(np.log10(vocabulary.total + vocabulary.distinct + 1))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
                       F.lit(vocabulary.total).cast("long").alias("train_tokens"),
                       (F.col("base") + logc - F.col("n_tokens") * whole).alias("base_score"), (F.col("score") + logc).alias("score"))


def learn_and_score(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the documents that aren't held out, score all."""
    held = is_held_out(id_col) if held_out is None else held_out
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    train = named.filter(~F.col("held_out"))
    counts = stash(word_counts(train))
    vocabulary = Vocabulary(counts)
    model = train_nce(pair_counts(train, vocabulary))
    return score_texts(named, vocabulary, model, counts)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_and_score(documents(spark, sf_dir))
