"""Connected components of an edge table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import stash


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``edges`` (two long columns); the root is the component's smallest node.

    Alternating large-star and small-star steps: each node's neighbours are
    hooked to its smallest neighbour until only stars are left.  The rounds
    grow with the logarithm of the longest path, and every round writes its
    edges to the shared folder, so that lost executors cost one round.
    """
    both = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    both = stash(both)
    state = None
    while True:
        # large star: larger neighbours of u go to the smallest around u
        around = both.select("u", "v").unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = around.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
        both = stash(small.distinct())
        now = both.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state:
            break
        state = now
    return both.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        both.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
