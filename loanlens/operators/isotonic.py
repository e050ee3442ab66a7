"""Isotonic calibration of scores (H8) as a merge of block lists.

Pool-adjacent-violators on a stretch of the ordered points gives a list of
blocks; pooling the joined lists of two neighbouring stretches gives what
pooling all their points would, as pooled points are never split again.  So:

1. points (distinct score, sum of labels, count) are dealt by ranges of the score;
2. each task pools its points in order, holding blocks only;
3. neighbouring tasks' lists are joined and pooled, ``FAN_IN`` at a time, until one is left.

Means of blocks are compared by cross-multiplied sums, which are exact for
0/1 labels.  For such labels the blocks' means are rising fractions whose
denominators add up to the number of rows n, so that there are at most about 3 *
n^(2/3) blocks: that bounds what the last merge and the driver hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.operators.ordered import edges_below, join_checked
from loanlens.session import materialize

FAN_IN = 8
BLOCK = "part bigint, lo double, hi double, total double, weight double"


def isotonic_blocks(df: DataFrame, score: str, label: str, buckets: int | None = None) -> DataFrame:
    """``lo, hi, value, weight``: blocks of the rising step function that fits ``label`` best, in squares, over ``score``.

    Rows without a score (NULL, NaN) or a label don't count.
    """
    x, y = F.col(score).cast("double"), F.col(label).cast("double")
    points = df.select(x.alias("x"), y.alias("y")).filter("x is not null and not isnan(x) and y is not null").groupBy("x").agg(
        F.sum("y").alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = df.sparkSession.createDataFrame([], BLOCK).schema
    names = schema.names

    def pool(blocks: Iterator[tuple]) -> list[list[float]]:
        done: list[list[float]] = []
        for block in blocks:
            done.append(list(block))
            while len(done) > 1 and done[-2][2] * done[-1][3] >= done[-1][2] * done[-2][3]:
                last = done.pop()
                top = done[-1]
                top[1] = last[1]
                top[2] += last[2]
                top[3] += last[3]
        return done

    def table(part: int, blocks: list[list[float]]) -> pa.RecordBatch:
        columns = list(zip(*blocks, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array([part] * len(blocks), pa.int64()), *[pa.array(c, pa.float64()) for c in columns]], names=names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((x, x, t, w) for b in batches for x, t, w in zip(*[c.to_pylist() for c in b.columns], strict=True))
        yield table(TaskContext.get().partitionId(), pool(rows))

    def merge(key: tuple, batch: pa.Table) -> pa.Table:
        rows = sorted(zip(*[batch.column(c).to_pylist() for c in names[1:]], strict=True))
        return pa.Table.from_batches([table(key[0].as_py(), pool(rows))])

    lists = points.repartitionByRange(n, "x").sortWithinPartitions("x").mapInArrow(first, schema)
    while n > 1:
        n = -(-n // FAN_IN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(merge, schema)
    return materialize(lists.select("lo", "hi", (F.col("total") / F.col("weight")).alias("value"), "weight"))


def apply_isotonic(df: DataFrame, blocks: DataFrame, score: str, out: str) -> DataFrame:
    """``df`` with the fitted value at ``score``: straight lines between blocks, clipped outside of them.

    A NULL or NaN score, and a fit without blocks, give NULL.  Rows find their place in the JVM.
    """
    spark = df.sparkSession
    found = [(r.lo, r.hi, r.value) for r in blocks.orderBy("lo").collect()]        # bounded, see above
    knots = [k for lo, hi, v in found for k in ([(lo, v), (hi, v)] if hi > lo else [(lo, v)])]
    if not knots:
        return df.withColumn(out, F.lit(None).cast("double"))
    ends = [knots[0], *knots, knots[-1]]
    rows = [(i, *a, *b) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
    lines = materialize(spark.createDataFrame(rows, "_line long, _x0 double, _y0 double, _x1 double, _y1 double"))
    j = join_checked(edges_below(df.drop(out), score, [x for x, _ in knots], "_line"), lines, ["_line"], "left")
    x = F.col(score).cast("double")
    on_line = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * ((x - F.col("_x0")) / (F.col("_x1") - F.col("_x0")))
    flat = (F.col("_x0") == F.col("_x1")) | (F.col("_y0") == F.col("_y1")) | (x == F.col("_x1"))
    value = F.when(flat, F.col("_y1")).otherwise(on_line)
    return j.select(*[c for c in df.columns if c != out], value.alias(out))
