"""Stored tables: a bucketed gold table with atomic replacement, and a panel that takes in extracts as they arrive."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.session import materialize
from loanlens.sources.ingest import ORDER_COLS, dedupe_last

ARRIVAL = "_arrival"


def replace_table(df: DataFrame, name: str, bucket_by: Sequence[str], buckets: int, root: str | None = None, keep: int = 1) -> DataFrame:
    """Make ``df`` the content of table ``name`` (A8, A9) and return that table.

    Each content is a table of its own, ``name__v000001`` and so on, bucketed and
    sorted by ``bucket_by``, so that joins and groupings by these columns need no
    shuffle.  ``name`` is a view of the newest; switching it is one catalog
    operation, so readers see the old content or the new one, never a part.
    The ``keep`` contents before stay for queries that are running; older ones go.
    ``root``: a folder for the files, if they aren't to be in the warehouse.
    """
    spark = df.sparkSession
    version = re.compile(re.escape(name) + r"__v(\d{6,})")
    old = sorted(int(m[1]) for t in spark.catalog.listTables() if (m := version.fullmatch(t.name)))
    new = f"{name}__v{(old[-1] if old else 0) + 1:06d}"
    writer = df.write.bucketBy(buckets, *bucket_by).sortBy(*bucket_by).format("parquet")
    (writer.option("path", f"{root.rstrip('/')}/{new}") if root else writer).saveAsTable(new)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {new}")
    for v in old[: len(old) - keep]:
        spark.sql(f"DROP TABLE {name}__v{v:06d}")
    return spark.table(name)


def merge_extract(spark: SparkSession, new: DataFrame, arrival: int, path: str, keys: Sequence[str], part: str,
                  order_cols: Sequence[str] = ORDER_COLS) -> None:
    """Take an extract into the stored panel at ``path`` (D5, G1): the last record of each key stays.

    Records are in the order of ``arrival`` (the extract's number, whenever it comes in)
    and then ``order_cols``; these are stored with them, so that the result is what
    all extracts together would give, also if they come out of order or twice.
    Only partitions (``part``, one of ``keys``) that the extract has rows in are read and rewritten.
    """
    if part not in keys:
        raise ValueError(f"{part} has to be among the keys: a record must not change its partition")
    came = materialize(new.withColumn(ARRIVAL, F.lit(arrival).cast("long")))
    merged = came
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        touched = [r[0] for r in came.select(part).distinct().collect()]              # partitions of one extract: months
        stored = spark.read.parquet(path)
        mine = F.col(part).isin([t for t in touched if t is not None])
        stored = stored.filter(mine | F.col(part).isNull() if None in touched else mine)
        merged = stored.unionByName(came, allowMissingColumns=True)
    last = materialize(dedupe_last(merged, list(keys), [ARRIVAL, *order_cols]))       # read in full before its partitions are rewritten
    last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
