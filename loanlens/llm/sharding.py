"""Operator 8: sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime
size: a start and a step from its name's hash.  The shards take turns, each
claiming the first slot of its order that is still free, until the table is
full; so all shards hold almost the same number of slots, and when a shard
comes or goes few other slots change hands.  A row's key is hashed to a slot,
and the slot names its shard: constant time a row, however many shards.

The table has ``SLOTS`` rows whatever the data (a proven bound), and is
broadcast; rows aren't shuffled to be placed.  Keys are hashed with the text's
hash, so that rows that share an id are spread as well.

Defined results: a null id or text is hashed as an empty one; equal rows fall
in one shard; all other columns pass through; an empty table stays empty; no
shards, or two of one name, are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import documents

SLOTS = 65_537               # prime, and far more than shards
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}|{name}".encode()).digest()[:8], "big")


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Number of the shard that holds each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need names that differ, one at least")
    place = [_hash(s, "start") % slots for s in shards]
    step = [1 + _hash(s, "step") % (slots - 1) for s in shards]
    table = [-1] * slots
    free = slots
    while free:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            table[place[i]] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a string key (first 52 bits of its MD5)."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key, F.lit(""))), 1, 13), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def assign_shards(df: DataFrame, key: Column, shards: Sequence[str] = SHARDS, slots: int = SLOTS,
                  slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard of each row."""
    rows = [(i, shards[s]) for i, s in enumerate(fill_table(shards, slots))]
    table = df.sparkSession.createDataFrame(rows, f"_slot int, {shard_col} string")
    keep = [c for c in df.columns if c not in (slot_col, shard_col)]
    placed = df.select(*keep, slot_of(key, slots).alias(slot_col))
    return placed.join(F.broadcast(table), F.col(slot_col) == F.col("_slot")).select(*keep, slot_col, shard_col)


def write_shards(df: DataFrame, path: str, shard_col: str = "shard", rows_per_file: int = 1_000_000) -> None:
    """One folder a shard; a task writes the rows it has, so a large shard is many files and no task gets it whole."""
    df.write.option("maxRecordsPerFile", rows_per_file).partitionBy(shard_col).parquet(path)


def document_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir), document_key()).select("doc_id", "slot", "shard")

