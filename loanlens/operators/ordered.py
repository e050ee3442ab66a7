"""Global order without one partition.

Ranks, prefix sums and exact quantiles need a global order.  A window with
``orderBy`` and no ``partitionBy`` moves every row into one task.  Instead:

1. Spark range-partitions the rows by (groups, order columns).  It samples the
   columns themselves, so any type that can be ordered will do, every
   partition holds about as many rows, and a large group, or one ordering
   value with a third of all rows, is cut by what comes next in the order.
2. The partitioned rows are written once, each with its partition number.
3. Totals for each (group, partition) give running offsets: a table with at
   most (groups + partitions) rows, as a range partition that starts a new
   group ends the one before.
4. A window inside each (group, partition) adds the local running sum.

Where a quantity only depends on distinct values, these are aggregated first
(map-side partial), so a value shared by many rows is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.session import materialize

#: A table is broadcast only after it was counted and found to have at most so many rows.
BROADCAST_ROWS = 100_000


def join_checked(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table of one row per key that is usually small.

    ``small`` is stored, so counting it is cheap.  Beyond ``BROADCAST_ROWS``
    Spark shuffles both sides and splits hot keys (adaptive skew join).
    Without keys ``small`` has one row, or none.
    """
    if not keys:
        return df.join(F.broadcast(small), F.lit(True), how)
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(small) if few else small, list(keys), how)


def edges_below(df: DataFrame, value: str, edges: Sequence[float], out: str) -> DataFrame:
    """``df`` with the number of ``edges`` (distinct, ascending) that lie strictly below ``value``: right-closed intervals.

    A binary search a row in the JVM.  NULL and NaN get NULL.  The edges travel
    with the plan; callers check how many there are.
    """
    x = F.col(value).cast("double")
    if not edges:
        return df.withColumn(out, F.when(x.isNotNull() & ~F.isnan(x), F.lit(0).cast("long")))
    # the search is left-closed; with the signs changed it is closed where it is wanted
    named = df.withColumn("_minus", F.when(~F.isnan(x), -x))
    found = Bucketizer(splits=[float("-inf"), *[-float(e) for e in reversed(edges)], float("inf")], inputCol="_minus",
                       outputCol="_above", handleInvalid="keep").transform(named)
    return found.withColumn(out, F.when(F.col("_minus").isNotNull(), F.lit(len(edges)) - F.col("_above").cast("long"))).drop("_minus", "_above")


def sums_up_to(df: DataFrame, value: str, thresholds: DataFrame, sum_cols: Sequence[str], lookup_rows: int = BROADCAST_ROWS) -> DataFrame:
    """For each row of ``thresholds`` (one column, distinct doubles) the sums of ``sum_cols`` over rows with ``value`` up to it.

    Returns the threshold column, ``cum_{c}`` and, equal in all rows, ``all_{c}``
    over all rows of ``df`` (a NULL or NaN value is above every threshold).
    However many thresholds there are, a row of ``df`` is looked at once:

    * up to ``lookup_rows`` thresholds each row finds its interval between two
      of them, and one map-side aggregate makes a table of interval sums;
    * beyond that values and thresholds are put in one order by range
      partitions, and running sums are read off where the thresholds are.
    """
    (t,) = thresholds.columns
    sum_cols = list(sum_cols)
    few = [r[0] for r in thresholds.orderBy(t).limit(lookup_rows + 1).collect()]
    if len(few) <= lookup_rows:
        cut = edges_below(df, value, few, "_i")
        sums = cut.groupBy("_i").agg(*[F.sum(c).alias(c) for c in sum_cols])
        # thresholds without a row between them and the one before
        named = df.sparkSession.createDataFrame([(i, e) for i, e in enumerate(few)], f"_i long, {t} double")
        table = materialize(named.join(sums, "_i", "full"))
        upto = Window.orderBy(F.col("_i").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)     # at most lookup_rows + 2 rows
        whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return table.select(t, *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"cum_{c}") for c in sum_cols],
                            *[F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"all_{c}") for c in sum_cols]).filter(F.col(t).isNotNull())
    x = F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))            # NaN comes last
    rows = df.groupBy(F.struct(x.alias("x"), F.lit(0).alias("kind")).alias("_at")).agg(*[F.sum(c).alias(c) for c in sum_cols])
    types = dict(rows.dtypes)
    marks = thresholds.select(F.struct(F.col(t).cast("double").alias("x"), F.lit(1).alias("kind")).alias("_at"),
                              *[F.lit(0).cast(types[c]).alias(c) for c in sum_cols])
    run = prefix_sums(rows.unionByName(marks), "_at", sum_cols, total="all_")
    return run.filter("_at.kind = 1").select(F.col("_at.x").alias(t), *[f"cum_{c}" for c in sum_cols], *[f"all_{c}" for c in sum_cols])


def _ranged(df: DataFrame, groups: list[str], order: list[Column], buckets: int | None) -> DataFrame:
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *[F.col(g) for g in groups], *order)
    return materialize(cut.withColumn("_part", F.spark_partition_id()))


def _offsets(ranged: DataFrame, groups: list[str], sums: dict[str, Column], firsts: dict[str, Column] | None = None) -> DataFrame:
    """For each (group, partition) the sums over earlier partitions (``_o_*``) and over the whole group (``_w_*``), and the
    ``firsts`` of the group's next partition (``_f_*``)."""
    firsts = firsts or {}
    totals = ranged.groupBy(*groups, "_part").agg(*[c.alias(f"_t_{n}") for n, c in sums.items()],
                                                  *[c.alias(f"_h_{n}") for n, c in firsts.items()])
    group = Window.partitionBy(*groups)
    parts = group.orderBy("_part")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    return materialize(totals.select(
        *groups, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(group).alias(f"_w_{n}") for n in sums],
        *[F.lead(f"_h_{n}").over(parts).alias(f"_f_{n}") for n in firsts]))


def prefix_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str], groups: Sequence[str] = (),
                descending: bool = False, buckets: int | None = None,
                prefix: str = "cum_", total: str | None = None, following: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ``order_col`` order per group.

    ``order_col`` must be unique within a group (aggregate to distinct values
    first).  Adds ``{prefix}{c}`` for every sum column and ``{prefix}rows``, the
    1-based position; with ``total`` also ``{total}{c}``, the group's sums.
    ``following`` names columns of which ``next_{c}`` is the next row's value in
    the group (NULL in the last row): a lead inside a partition, and over its
    end the first row of the group's next partition.  ``order_col`` must not be
    NULL then.
    """
    groups, sum_cols, following = list(groups), list(sum_cols), list(following)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    ranged = _ranged(df, groups, [order], buckets)
    pick = F.max_by if descending else F.min_by
    offsets = _offsets(ranged, groups, {**{c: F.sum(c) for c in sum_cols}, "rows": F.count(F.lit(1))},
                       {c: pick(c, order_col) for c in following})
    part = Window.partitionBy(*groups, "_part").orderBy(order)
    w = part.rowsBetween(Window.unboundedPreceding, 0)
    ahead = [F.when(F.lead(F.lit(1)).over(part).isNull(), F.col(f"_f_{c}")).otherwise(F.lead(c).over(part)) for c in following]
    joined = join_checked(ranged, offsets, [*groups, "_part"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{c}") + F.sum(c).over(w)).alias(f"{prefix}{c}") for c in sum_cols],
        (F.col("_o_rows") + F.count(F.lit(1)).over(w)).alias(f"{prefix}rows"),
        *[F.col(f"_w_{c}").alias(f"{total}{c}") for c in sum_cols if total],
        *[x.alias(f"next_{c}") for c, x in zip(following, ahead, strict=True)])


def row_ranks(df: DataFrame, order_col: str, tie_col: str, groups: Sequence[str] = (),
              out: str = "rank", buckets: int | None = None) -> DataFrame:
    """1-based rank of every row by (order_col, tie_col) within each group.

    Both columns may have any type that can be ordered; text is put in code
    point order.  Rows with a NULL ``order_col`` get a NULL rank.  ``tie_col``
    must be unique within (group, order value).
    """
    groups = list(groups)
    order = [F.col(order_col).asc(), F.col(tie_col).asc()]
    ranged = _ranged(df.filter(F.col(order_col).isNotNull()), groups, order, buckets)
    offsets = _offsets(ranged, groups, {"rows": F.count(F.lit(1))})
    w = Window.partitionBy(*groups, "_part").orderBy(*order)
    ranked = join_checked(ranged, offsets, [*groups, "_part"]).select(
        *df.columns, (F.col("_o_rows") + F.row_number().over(w)).alias(out))
    nulls = df.filter(F.col(order_col).isNull()).withColumn(out, F.lit(None).cast("long"))
    return ranked.unionByName(nulls)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (),
                    buckets: int | None = None, out_prefix: str = "q") -> DataFrame:
    """Exact linear-interpolation quantiles (numpy 'linear', SQL quantile_cont).

    Returns one row per group with columns ``{out_prefix}0 .. {out_prefix}{k-1}``
    plus ``_n`` (non-null count); no row for a group without values.  Works
    from distinct-value counts and prefix sums, so no group is ever collected
    into one buffer: each target position lies in the run of one distinct
    value, and an aggregate picks it.
    """
    groups = list(groups)
    base = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_x"))
    counts = base.groupBy(*groups, "_x").agg(F.count(F.lit(1)).alias("_c"))
    return count_quantiles(counts, "_x", "_c", probs, groups, buckets, out_prefix)


def count_quantiles(counts: DataFrame, value: str, times: str, probs: Sequence[float], groups: Sequence[str] = (),
                    buckets: int | None = None, out_prefix: str = "q") -> DataFrame:
    """``exact_quantiles`` of values given once each with how often they occur."""
    groups = list(groups)
    named = counts.select(*groups, F.col(value).alias("_x"), F.col(times).alias("_c"))
    run = prefix_sums(named, "_x", ["_c"], groups, buckets=buckets, prefix="_p", total="_n")
    at = [(F.col("_n_c") - 1).cast("double") * F.lit(float(p)) for p in probs]
    holds = lambda pos: (pos > F.col("_p_c") - F.col("_c") - 1) & (pos <= F.col("_p_c") - 1)
    picked = run.groupBy(*groups).agg(
        F.max("_n_c").alias("_n"),
        *[F.max(F.when(holds(F.floor(p)), F.col("_x"))).alias(f"_lo{i}") for i, p in enumerate(at)],
        *[F.max(F.when(holds(F.ceil(p)), F.col("_x"))).alias(f"_hi{i}") for i, p in enumerate(at)])
    part = lambda p: (F.col("_n") - 1).cast("double") * F.lit(float(p)) - F.floor((F.col("_n") - 1).cast("double") * F.lit(float(p)))
    return materialize(picked.filter("_n is not null").select(*groups, "_n", *[
        (F.col(f"_lo{i}") + part(p) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"{out_prefix}{i}") for i, p in enumerate(probs)]))
