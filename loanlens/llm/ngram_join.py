"""Operator 6: n-gram Jaccard join as a blocked sparse matrix product.

Documents are the rows and word n-grams the columns of a sparse incidence
matrix; the overlap of two documents is an entry of its product with its own
transpose.  The product is never formed as a whole:

1. *Classes.*  Documents with equal sets are one row (128-bit keys).
2. *Columns of two or more.*  The matrix is cut into column blocks by n-gram
   hash.  Each row counts its n-grams that another row has too.  A partner
   must hold ``ceil(t * n)`` of a row's ``n`` n-grams, so a row with fewer
   shared ones has no partner and leaves.  For long rows half of all columns,
   chosen by hash, is enough for that bound.
3. *Row blocks.*  For the rows that are left, n-grams are put in the order of
   their frequency, rarest first.  Two rows that link share one of their first
   ``n - ceil(t * n) + 1``.  Rows that share such an n-gram and whose sizes
   allow a link are joined into row blocks (connected components of these
   candidates), so that every link lies inside a row block.
4. *Products.*  Each row block's overlaps are accumulated through its inverted
   columns, some rows at a time; pairs below the bound that follows from both
   sizes are discarded, and the rest are links.  Rows known to be connected
   aren't multiplied again, so a group of near copies costs about one product
   with its hub and not all its pairs.  A row block of more than
   ``TASK_TOKENS`` n-grams is cut into tiles, and each pair of tiles is a task.

Everything is exact up to collisions of 64-bit n-gram hashes.  No pairs of a
group are written: the result is one row a document with its class and its
component.  Before the shuffle each flush of a task sends an n-gram once, so
a very common one costs a row a flush and not one a document.

Defined results: a null or blank text has no n-grams and links with nothing,
not even with another blank one; a text with fewer words than an n-gram has
its whole word sequence as its only one; equal rows fall in one class; a null
id is never the smallest of its component while there is another; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from loanlens.llm.common import OWN, documents, join_small, shielded, stash
from loanlens.llm.components import connected_components
from loanlens.llm.shingles import Shingler, blocks, mix, texts_of

GRAM = 4
SIMILAR = 85                   # per cent
#: Rows of at most so many n-grams use all columns in step 2, longer ones the columns below HALF.
SHORT = 80
HALF = np.uint64(1 << 63)
BLOCK_TOKENS = 1_000_000       # n-grams of a column block
TASK_TOKENS = 1_000_000        # n-grams of a product task
FLUSH_TOKENS = 500_000
MARK = np.uint32(0xFFFFFFFF)   # "two rows or more have it", in place of a row


def least_overlap(n, percent: int):
    """n-grams of a row of size ``n`` that any partner must have: ceil(t * n)."""
    return -(-n * percent // 100)


def _keys(s: np.ndarray) -> tuple[int, int]:
    sums = np.array([np.add.reduce(mix(s + np.uint64(1))), np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))], np.uint64)
    one, two = mix(sums + np.uint64(len(s))).view(np.int64).tolist()
    return one, two


def _probe(s: np.ndarray) -> int:
    """How many of a sorted set's n-grams count in step 2."""
    # partners of a row of at most 0.85 * SHORT are at most SHORT long themselves, and bring all their n-grams
    return len(s) if len(s) <= SHORT * 3 // 5 else int(np.searchsorted(s, HALF))


def row_table(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, tie, n, probe, k1, k2``: size and class keys of every document's set."""
    schema = "doc_id bigint, tie bigint, n bigint, probe bigint, k1 bigint, k2 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            out = []
            for block in blocks(texts_of(batch.column(1))):
                for s in shingler.sets(block):
                    out.append((len(s), _probe(s), *_keys(s)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, pa.int64()) for c in cols]],
                                             names=["doc_id", "tie", "n", "probe", "k1", "k2"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(run, schema)


def _column_blocks(docs: DataFrame, k: int, n_blocks: int, whole: bool) -> DataFrame:
    """The incidence matrix in column blocks: ``block, keys, sizes, rows, grams`` (packed), combined for each flush.

    With ``whole`` every n-gram is sent with its row.  Else only what step 2
    needs: an n-gram that two rows of a flush share is counted for both at
    once (``block`` below 0: ``keys`` and counts in ``sizes``) and sent as a
    mark.
    """
    schema = "block int, keys binary, sizes binary, rows binary, grams binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        seen: dict[int, int] = {}
        sets: list[np.ndarray] = []
        held = flushes = 0

        def flush() -> pa.RecordBatch:
            keys = np.fromiter(seen.keys(), np.int64, len(seen))
            sizes = np.array([len(s) for s in sets], np.uint32)
            out = []
            if whole:
                part = sets
            else:
                part = [s if len(s) <= SHORT else s[: np.searchsorted(s, HALF)] for s in sets]
            grams = np.concatenate(part) if part else np.empty(0, np.uint64)
            rows = np.repeat(np.arange(len(part), dtype=np.uint32), [len(s) for s in part])
            order = np.argsort(grams, kind="stable")
            grams, rows = grams[order], rows[order]
            if not whole and len(grams):
                first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
                times = np.diff(np.append(first, len(grams)))
                shared = np.repeat(times > 1, times)
                counts = _counted(grams, rows, shared, sizes)
                out.append((-1 - flushes % 64, keys.tobytes(), counts.astype(np.uint32).tobytes(), b"", b""))
                grams, rows = grams[first], np.where(times > 1, MARK, rows[first])
            to = (grams >> np.uint64(20)) % np.uint64(n_blocks)
            order = np.argsort(to, kind="stable")
            grams, rows, to = grams[order], rows[order], to[order]
            cuts = np.searchsorted(to, np.arange(n_blocks + 1, dtype=np.uint64))
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    # keys and sizes of the rows in this block only
                    used, at = np.unique(rows[a:b], return_inverse=True)
                    real = used[used != MARK]
                    at = np.where(rows[a:b] == MARK, MARK, at.astype(np.uint32))
                    out.append((i, keys[real].tobytes(), sizes[real].tobytes(), at.astype(np.uint32).tobytes(), grams[a:b].tobytes()))
            seen.clear()
            sets.clear()
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                                              names=["block", "keys", "sizes", "rows", "grams"])

        for batch in batches:
            for block in blocks(texts_of(batch.column(0))):
                for s in shingler.sets(block):
                    if len(s) and (key := _keys(s)[0]) not in seen:
                        seen[key] = len(sets)
                        sets.append(s)
                        held += len(s)
                if held >= FLUSH_TOKENS:
                    yield flush()
                    held, flushes = 0, flushes + 1
        yield flush()

    return docs.select("text").mapInArrow(run, schema)


def _counted(grams: np.ndarray, rows: np.ndarray, shared: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of each row's probed n-grams are shared."""
    probed = (sizes[rows] <= SHORT * 3 // 5) | (grams < HALF)
    return np.bincount(rows[shared & probed], minlength=len(sizes))


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, size and n-gram of every entry of a column block; marks have size 0. Equal entries of equal rows once."""
    keys, sizes, grams = [], [], []
    for r in table.to_pylist():
        k, s = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["sizes"], np.uint32)
        at = np.frombuffer(r["rows"], np.uint32)
        mark = at == MARK
        at = np.where(mark, 0, at)
        k, s = (np.append(k, 0), np.append(s, 0)) if not len(k) else (k, s)
        keys.append(np.where(mark, 0, k[at]))
        sizes.append(np.where(mark, 0, s[at]))
        grams.append(np.frombuffer(r["grams"], np.uint64))
    k, s, g = np.concatenate(keys), np.concatenate(sizes), np.concatenate(grams)
    order = np.lexsort((k, g))
    k, s, g = k[order], s[order], g[order]
    same = np.concatenate([[False], (g[1:] == g[:-1]) & (k[1:] == k[:-1]) & (s[1:] > 0) & (s[:-1] > 0)])
    k, s, g = k[~same], s[~same], g[~same]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
    runs = np.diff(np.append(first, len(g)))
    times = np.add.reduceat(np.where(s > 0, 1, 2), first) if len(g) else runs
    return k, s, g, np.repeat(times, runs)


def _shared_counts(blocks_: DataFrame, n_buckets: int) -> DataFrame:
    """``k1, shared``: how many of each row's probed n-grams another row has too.

    A block's counts are sent packed by bucket of the row's key, and a bucket
    sums up those of its rows: rows are made for (block, bucket) and for
    matrix rows, not for every row of every block.
    """
    packed = "bucket int, keys binary, counts binary"

    def partial(table: pa.Table) -> pa.Table:
        if table.num_rows and table.column("block")[0].as_py() < 0:
            k = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("keys").to_pylist()])
            c = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("sizes").to_pylist()])
            k, c = _summed(k, c)
        else:
            k, s, g, times = _unpacked(table)
            use = (s > 0) & (times > 1) & ((s <= SHORT * 3 // 5) | (g < HALF))
            k, c = np.unique(k[use], return_counts=True)
        k, c = k[c > 0], c[c > 0].astype(np.uint32)
        out = [(i, k[o].tobytes(), c[o].tobytes()) for i, o in _dealt(k, n_buckets)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.table([pa.array(cols[0], pa.int32()), *[pa.array(x, pa.binary()) for x in cols[1:]]], names=["bucket", "keys", "counts"])

    def total(table: pa.Table) -> pa.Table:
        join = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
        k, c = _summed(join("keys", np.int64), join("counts", np.uint32))
        return pa.table({"k1": k, "shared": c})

    return (blocks_.groupBy("block").applyInArrow(partial, packed)
            .groupBy("bucket").applyInArrow(total, "k1 bigint, shared bigint"))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _dealt(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(bucket, positions)`` of the buckets that hold any of ``keys``."""
    to = keys.view(np.uint64) % np.uint64(n_buckets)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(n_buckets + 1, dtype=np.uint64))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            yield i, order[a:b]


def _rare_prefix(blocks_: DataFrame, n_buckets: int, percent: int) -> DataFrame:
    """``k1, n, gram``: of each row the n-grams of its prefix that another row has too."""
    packed = "bucket int, keys binary, sizes binary, grams binary, times binary"

    def frequencies(table: pa.Table) -> pa.Table:
        k, s, g, times = _unpacked(table)
        use = times > 1
        k, s, g, times = k[use], s[use], g[use], times[use]
        out = [(i, k[o].tobytes(), s[o].astype(np.uint32).tobytes(), g[o].tobytes(), times[o].astype(np.uint32).tobytes())
               for i, o in _dealt(k, n_buckets)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                        names=["bucket", "keys", "sizes", "grams", "times"])

    def prefix(table: pa.Table) -> pa.Table:
        join = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
        k, s, g, f = join("keys", np.int64), join("sizes", np.uint32), join("grams", np.uint64), join("times", np.uint32)
        order = np.lexsort((g, f, k))
        k, s, g = k[order], s[order].astype(np.int64), g[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        runs = np.diff(np.append(first, len(k)))
        # n-grams that no other row has come first in the prefix, and can't meet a partner's
        left = runs - least_overlap(s[first], percent) + 1
        use = np.arange(len(k)) - np.repeat(first, runs) < np.repeat(left, runs)
        return pa.table({"k1": k[use], "n": s[use], "gram": g[use].view(np.int64)})

    return (blocks_.groupBy("block").applyInArrow(frequencies, packed)
            .groupBy("bucket").applyInArrow(prefix, "k1 bigint, n bigint, gram bigint"))


def link_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what the links of ``sets`` connect (positions, a spanning forest and some more)."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), size)
    width = int(gram.max()) + 1
    parent = np.arange(m)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def columns(of: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Inverted columns of some rows, and the number of these."""
        keep = of[row]
        order = np.argsort(gram[keep], kind="stable")
        return int(of.sum()), np.concatenate([[0], np.cumsum(np.bincount(gram[keep], minlength=width))]), row[keep][order]

    links: list[tuple[int, int]] = []
    done = np.zeros(m, bool)
    queue: list[int] = []
    fresh, take = 0, 1
    # columns of all undone rows, and those without the component of a row
    whole, part, member = None, None, -1
    while True:
        if queue:
            r = root(queue[-1])
            chosen = []
            while queue and len(chosen) < 64:
                x = queue.pop()
                if root(x) != r:
                    queue.append(x)
                    break
                if not done[x]:
                    chosen.append(x)
            if not chosen:
                continue
            # rows that are connected with these already needn't be multiplied
            roots = np.fromiter(map(root, range(m)), np.int64, m)
            wanted = ~done & (roots != r)
        else:
            r = -1
            chosen = []
            while fresh < m and len(chosen) < take:
                if not done[fresh]:
                    chosen.append(fresh)
                fresh += 1
            if not chosen:
                return links
            wanted = ~done
        undone = ~done
        done[chosen] = True
        live = int(wanted.sum())
        built = None
        if live:
            # what a component leaves out may be used for it alone: others still look for its rows
            if r >= 0 and part and root(member) == r:
                if 2 * live < part[0]:
                    part = columns(wanted)
                built = part
            else:
                left = int(undone.sum())
                if whole is None or 2 * left < whole[0]:
                    whole = columns(undone)
                if r >= 0 and 2 * live < left:
                    part, member = columns(wanted), r
                    built = part
                else:
                    built = whole
        found = False
        if live:
            _, begin, column = built
            for x in chosen:
                g = gram[start[x]:start[x + 1]]
                a, n = begin[g], begin[g + 1] - begin[g]
                total = int(n.sum())
                if not total:
                    continue
                at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
                overlap = np.bincount(column[at], minlength=m)
                # 100 * overlap >= percent * union
                hit = np.flatnonzero(((100 + percent) * overlap >= percent * (size + size[x])) & wanted)
                for y in hit.tolist():
                    if y != x and root(x) != root(y):
                        parent[root(y)] = root(x)
                        links.append((x, y))
                        found = True
                        if not done[y]:
                            queue.append(y)
        take = 1 if found else min(64, take * 2)


def _links(docs: DataFrame, places: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b``: links between classes, enough to connect what links connect. ``places``: ``doc_id, k1, task``."""
    sent = join_small(docs.select("doc_id", "text"), places.groupBy("doc_id").agg(
        F.collect_list(F.struct("k1", "task")).alias("places")), ["doc_id"])   # a document's tiles

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            at = 0
            goes = batch.column(1).to_pylist()
            for block in blocks(texts_of(batch.column(0))):
                out = []
                for s, places_ in zip(shingler.sets(block), goes[at:at + len(block)], strict=True):
                    key = _keys(s)[0]
                    out += [(p["task"], key, s.tobytes()) for p in places_ if p["k1"] == key]
                at += len(block)
                cols = list(zip(*out, strict=True)) if out else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())],
                                                 names=["task", "k1", "grams"])

    def product(table: pa.Table) -> pa.Table:
        keys, at = np.unique(table.column("k1").to_numpy(), return_index=True)
        grams = table.column("grams")
        found = link_forest([np.frombuffer(grams[int(i)].as_py(), np.uint64) for i in at], percent)
        return pa.table({"a": pa.array([int(keys[x]) for x, _ in found], pa.int64()), "b": pa.array([int(keys[y]) for _, y in found], pa.int64())})

    made = sent.select("text", "places").mapInArrow(sets, "task bigint, k1 bigint, grams binary")
    return made.groupBy("task").applyInArrow(product, "a bigint, b bigint")


def similar_components(docs: DataFrame, k: int = GRAM, percent: int = SIMILAR,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tie, n_shingles, class_id, component_id, component`` of every document (``tie``: hash of the text).

    Documents of equal sets have one ``class_id``; ``component_id`` is the
    smallest id that links reach, and ``component`` a key of the component
    (null for a document without words).  Two classes link if their Jaccard
    similarity is at least ``percent`` per cent.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stash(row_table(named, k))
    classes = stash(rows.filter("n > 0").groupBy("k1", "k2", "n", "probe").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    tokens = classes.agg(F.sum("n")).first()[0] or 0
    parts = lambda n, each: int(max(2 * int(spark.sparkContext.defaultParallelism), -(-n // each)))

    # step 2: rows that share enough n-grams with others at all
    # a row has a count in few blocks, and a count is small beside a block's n-grams: few buckets do
    shared = _shared_counts(_column_blocks(named, k, parts(tokens, 2 * BLOCK_TOKENS), whole=False), parts(tokens, 32 * BLOCK_TOKENS))
    need = F.col("probe") - (F.col("n") - F.ceil(F.col("n") * percent / 100))
    left = stash(classes.join(shared, "k1", "left").filter(F.coalesce(F.col("shared"), F.lit(0)) >= need).select("k1", "n", "least"))

    # step 3: row blocks
    of_left = join_small(named, left.groupBy("least").agg(F.lit(True).alias("_in")).withColumnRenamed("least", "doc_id"), ["doc_id"])
    some = parts(left.agg(F.sum("n")).first()[0] or 0, BLOCK_TOKENS)
    firsts = _rare_prefix(_column_blocks(of_left, k, some, whole=True), some, percent)
    w = Window.partitionBy("gram").orderBy("n", "k1")
    firsts = firsts.withColumn("_before", F.lag("n").over(w))
    # sizes too far apart cut the list of an n-gram's rows
    cut = F.col("_before").isNull() | (100 * F.col("_before") < percent * F.col("n"))
    run = firsts.withColumn("_head", F.last(F.when(cut, F.col("k1")), ignorenulls=True).over(w))
    near = connected_components(run.filter("k1 <> _head").select(F.col("_head").alias("a"), F.col("k1").alias("b")).distinct())
    near = stash(near.join(left, near["node"] == left["k1"]).select("k1", "n", "least", "root"))

    # step 4: products; a large row block is cut into tiles
    sizes = near.groupBy("root").agg(F.sum("n").alias("_tokens"))
    tasks = parts(sizes.agg(F.sum("_tokens")).first()[0] or 0, TASK_TOKENS)
    near = join_small(near, stash(sizes), ["root"])
    tiles = F.ceil(F.col("_tokens") / TASK_TOKENS).cast("int")
    tile = F.pmod(F.xxhash64("k1"), tiles).cast("int")
    other = F.explode(F.sequence(F.lit(0), tiles - 1))
    near = near.withColumn("_tiles", tiles).withColumn("_tile", tile).withColumn("_other", other)
    task = F.when(F.col("_tiles") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(
        F.xxhash64("root", F.least("_tile", "_other"), F.greatest("_tile", "_other")))
    places = stash(near.select(F.col("least").alias("doc_id"), "k1", task.alias("task")))
    linked = connected_components(_links(named, places, k, percent))

    # back to documents: only classes with copies or links need a look-up
    known = classes.join(linked.withColumnRenamed("node", "k1"), "k1", "left")
    low = known.filter("root is not null").groupBy("root").agg(F.min("least").alias("_low"))
    known = known.join(low, "root", "left").select(
        "k1", "k2", F.col("least").alias("class_id"), F.coalesce("_low", "least").alias("component_id"),
        F.coalesce("root", "k1").alias("component"), "copies", "root")
    known = stash(known.filter("copies > 1 or root is not null").drop("copies", "root"))
    out = join_small(rows, known, ["k1", "k2"], "left")
    return out.select("doc_id", "tie", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"),
                      F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.when(F.col("n") > 0, F.coalesce("component", "k1")).alias("component"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the first by id (null last), then by the text's hash.

    Equal rows of one id and text fall to one row; documents without words all stay.
    """
    return shielded(docs, lambda d: _one_of_each(d, k, percent, id_col, text_col), {*OWN, id_col, text_col})


def _one_of_each(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    found = stash(similar_components(docs, k, percent, id_col, text_col).filter("component is not null").select("doc_id", "tie", "component"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tie")
    groups = stash(found.groupBy("component").agg(F.count(F.lit(1)).alias("_times"), F.min(order).alias("_first")).filter("_times > 1"))
    several = join_small(found, groups, ["component"])
    first = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tie").eqNullSafe(F.col("_first"))
    verdict = stash(several.withColumn("_stays", first).groupBy("doc_id", "tie").agg(
        F.max("_stays").alias("_stays"), F.count(F.lit(1)).alias("_rows")).select(
        F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), "_stays", "_rows"))
    marked = docs.withColumn("_d", F.col(id_col).cast("long")).withColumn("_t", F.xxhash64(F.col(text_col)))
    out = join_small(marked, verdict, ["_d", "_t"], "left").filter("coalesce(_stays, true)")
    if verdict.filter("_stays and _rows > 1").limit(1).count():
        again = F.coalesce(F.col("_rows"), F.lit(1)) > 1
        out = out.filter(~again).unionByName(out.filter(again).dropDuplicates(["_d", "_t"]))
    return out.select(*docs.columns)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class_id")


ORACLE_OP6 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')))) END AS g FROM t),
n AS (SELECT doc_id, g, len(g)::BIGINT AS n, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY g) END AS class_id FROM s),
x AS (SELECT DISTINCT class_id, n, unnest(g) AS gram FROM n WHERE n > 0 AND doc_id = class_id),
p AS (SELECT a.class_id AS a, b.class_id AS b FROM x a JOIN x b ON a.gram = b.gram AND a.class_id <> b.class_id
      GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT class_id AS a, class_id AS b FROM n UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT doc_id, n AS n_shingles, class_id, (SELECT min(b) FROM r WHERE r.a = class_id) AS component_id FROM n
"""
