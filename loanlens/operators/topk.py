"""Top-k per group and latest-row-per-group.

A filter on ``row_number`` lets Spark keep the first k rows of every group in
each task before the shuffle (window group limit), so a group with a large
share of all rows sends at most k rows a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    rank_col: str = "rn") -> DataFrame:
    """Keep the first ``k`` rows of every group under ``order`` (ties must be broken
    by the caller), numbering them 1..k in ``rank_col``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def latest_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last row per group under ``order`` ascending (F4: ``groupby().tail(1)``)."""
    desc = [o.desc() if isinstance(o, Column) else F.col(o).desc() for o in order]
    return top_k_per_group(df, keys, desc, 1, "_latest_rn").drop("_latest_rn")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k report (F5): ``orderBy(...).limit(k)`` plans as a
    TakeOrderedAndProject -- each task keeps k rows, the driver merges k x tasks."""
    return df.orderBy(*order).limit(k)
