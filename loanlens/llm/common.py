"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.session import checkpoint_dir

# White space that separates words, as characters and as a pattern.
SPACES = " \t\n\x0b\f\r"
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A table is broadcast only after it was counted and found to have at most so many rows.
BROADCAST_ROWS = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the text's words; empty for a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` made a single time, however often ``use`` names it.

    The value goes through an array of one, so that a lambda variable holds it.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage and lets later branches read only the columns they need;
    the files outlive any executor.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Columns of ``documents``.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(docs: DataFrame, work, own=OWN) -> DataFrame:
    """``work(docs)``, with columns that aren't ``own`` packed into one struct, so that no name in ``work`` can clash with theirs.

    All columns of ``docs`` come back in their order, then what ``work`` adds;
    what it makes under the name of a further column replaces that.
    """
    further = [c for c in docs.columns if c not in own]
    if not further:
        return work(docs)
    box = F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(further)])
    out = work(docs.select(*[c for c in docs.columns if c in own], box.alias("further")))
    made = [c for c in out.columns if c not in own and c != "further"]
    back = {c: F.col("further").getField(f"f{i}").alias(c) for i, c in enumerate(further) if c not in made}
    return out.select(*[back.get(c, F.col(f"`{c}`")) for c in docs.columns], *[c for c in made if c not in docs.columns])


def join_small(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
               rows: int = BROADCAST_ROWS) -> DataFrame:
    """Null-safe join with a table that is usually small.

    ``small`` has one row per key and is stored already, so that counting it
    is cheap.  Up to ``rows`` rows it is broadcast; beyond that Spark shuffles
    both sides and splits hot keys of ``df`` (adaptive skew join).  The key
    columns of ``df`` stay, those of ``small`` go.
    """
    right = small.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                         *[c for c in small.columns if c not in keys])
    if small.limit(rows + 1).count() <= rows:
        right = F.broadcast(right)
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return df.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


def join_rows(df: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join with a table that grows with ``df``: both sides are shuffled, at every size.

    ``right`` has one row per key.  The key columns of ``df`` stay, those of ``right`` go.
    """
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return df.join(named.hint("merge"), cond, how).drop(*[f"_r_{k}" for k in keys])
