"""Feature preparation fitted on the training population (H1, H2).

* Numeric: exact medians, and mean and standard deviation (of n) of the imputed
  values, from one table of distinct values and one aggregate.
* Categorical: a dictionary table ``column, value, n, mode, keep, slot``.  A null
  takes the mode (of equal counts the smallest value); values that are then seen
  fewer than ``min_frequency`` times share one slot after the others; slots are
  numbered by value within a column, from range partitions and their offsets.
  Values the dictionary doesn't have get no slot.

The dictionary is as large as the data's categories are many: it stays a table,
and rows find their slots by a join whose small side is broadcast only when it
was counted.  The driver holds a few numbers a column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.operators.ordered import exact_quantiles, join_checked, row_ranks
from loanlens.session import materialize

RARE = "__rare__"


def _stacked(df: DataFrame, columns: Sequence[str], kind: str, value: str) -> DataFrame:
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias(value)) for c in columns])))


def numeric_stats(train: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """``column, n, missing, median, mean, std``: of each column, mean and std after the median took the place of missing values.

    A column without any value counts as zeros.
    """
    long = _stacked(train, numeric, "double", "x").withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    medians = exact_quantiles(long, "x", [0.5], ["column"]).select("column", F.col("q0").alias("median"))
    plain = long.groupBy("column").agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"),
                                       F.coalesce(F.avg("x"), F.lit(0.0)).alias("_m"), F.coalesce(F.var_pop("x"), F.lit(0.0)).alias("_v"))
    j = plain.join(F.broadcast(medians), "column", "left").fillna(0.0, ["median"])           # a row a column
    n, k, all_ = F.col("n"), F.col("missing"), F.col("n") + F.col("missing")
    mean = (n * F.col("_m") + k * F.col("median")) / all_
    square = lambda c: c * c
    var = (n * (F.col("_v") + square(F.col("_m") - mean)) + k * square(F.col("median") - mean)) / all_
    return j.select("column", "n", "missing", "median", mean.alias("mean"), F.sqrt(var).alias("std"))


def category_dictionary(train: DataFrame, categorical: Sequence[str], min_frequency: int = 25) -> DataFrame:
    """One row per (column, distinct value): ``column, value, n, mode, keep, slot``; ``n`` counts nulls for the mode."""
    long = _stacked(train, categorical, "string", "value")
    counts = materialize(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    seen = counts.filter("value is not null")
    # a row a column
    modes = seen.groupBy("column").agg(F.expr("min_by(value, struct(-n, value))").alias("mode")).join(
        counts.filter("value is null").select("column", F.col("n").alias("_nulls")), "column", "left")
    levels = seen.join(F.broadcast(modes), "column").select(
        "column", "value", (F.col("n") + F.when(F.col("value") == F.col("mode"), F.coalesce("_nulls", F.lit(0))).otherwise(0)).alias("n"), "mode")
    levels = materialize(levels.withColumn("keep", F.col("n") >= min_frequency))
    kept = row_ranks(levels.filter("keep"), "value", "value", ["column"], out="_rank").withColumn("slot", F.col("_rank") - 1).drop("_rank")
    last = levels.groupBy("column").agg(F.count_if("keep").alias("slot"))
    rare = levels.filter("not keep").join(F.broadcast(last), "column")
    return materialize(kept.unionByName(rare))


@dataclass
class Preparation:
    """What was fitted: a few numbers a column, and the dictionary table."""

    numeric: list[str]
    categorical: list[str]
    stats: dict[str, tuple[float, float, float]]
    dictionary: DataFrame | None
    modes: dict[str, str]
    sizes: dict[str, int]

    def names(self) -> list[str]:
        """Names of the feature slots, as many as a fitted model has."""
        out = list(self.numeric)
        if self.dictionary is not None:
            place = {c: i for i, c in enumerate(self.categorical)}
            slots = self.dictionary.select("column", "slot", F.when(F.col("keep"), F.col("value")).otherwise(F.lit(RARE)).alias("level")).distinct()
            out += [f"{r['column']}_{r.level}" for r in sorted(slots.collect(), key=lambda r: (place[r["column"]], r.slot))]
        return out

    def slots(self, df: DataFrame) -> DataFrame:
        """``df`` with ``{column}__idx``: the slot of each categorical value (the number of slots if it has none)."""
        out = df
        for c in self.sizes:
            mine = self.dictionary.filter(F.col("column") == c).select(F.col("value").alias(f"{c}__value"), F.col("slot").alias(f"{c}__slot"))
            out = join_checked(out.withColumn(f"{c}__value", F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(self.modes[c]))), mine, [f"{c}__value"], "left")
            out = out.withColumn(f"{c}__idx", F.coalesce(F.col(f"{c}__slot"), F.lit(self.sizes[c])).cast("double")).drop(f"{c}__slot", f"{c}__value")
        return out

    def stages(self, scale: bool) -> list:
        """Fitted stages from imputed numbers and slots to the vector ``features``."""
        made = []
        for c, (median, mean, std) in self.stats.items():
            x = f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), NULL), {median!r}D)"
            made.append(f"({x} - {mean!r}D) / {(std or 1.0)!r}D AS `{c}__num`" if scale else f"{x} AS `{c}__num`")
        out = [SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__")] if made else []
        inputs = [f"{c}__num" for c in self.stats]
        if self.sizes:
            spark = self.dictionary.sparkSession
            idx, hot = [f"{c}__idx" for c in self.sizes], [f"{c}__oh" for c in self.sizes]
            # one row with each column's highest number: the encoder then drops that one, which means "no slot"
            top = spark.createDataFrame([tuple(float(n) for n in self.sizes.values())], ", ".join(f"`{c}` double" for c in idx))
            out.append(OneHotEncoder(inputCols=idx, outputCols=hot, dropLast=True, handleInvalid="error").fit(top))
            inputs += hot
        return [*out, VectorAssembler(inputCols=inputs, outputCol="features")]


def fit_preparation(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], min_frequency: int = 25) -> Preparation:
    stats = {r["column"]: (r.median, r["mean"], r.std) for r in numeric_stats(train, numeric).collect()} if numeric else {}
    dictionary, modes, sizes = None, {}, {}
    if categorical:
        dictionary = category_dictionary(train, categorical, min_frequency)
        found = {r["column"]: r for r in dictionary.groupBy("column").agg(F.first("mode").alias("mode"), (F.max("slot") + 1).alias("size")).collect()}
        modes, sizes = {c: r["mode"] for c, r in found.items()}, {c: found[c]["size"] for c in categorical if c in found}
    return Preparation(list(numeric), list(categorical), {c: stats.get(c, (0.0, 0.0, 1.0)) for c in numeric}, dictionary, modes, sizes)
