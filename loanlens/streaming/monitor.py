"""Score monitoring over a stream of scored records (optional M1).

Baseline bin edges are computed once, in batch, from a baseline population
(exact quantiles, one row); the stream assigns each record to a baseline bin
and counts records per (event-time day, bin).  A watermark bounds the state:
a day is emitted once the watermark passes its end, and later records for it
are dropped as late.  The batch function gives the same counts for a bounded
input, which is how the stream is tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loanlens.functions.scalar import quarter_label
from loanlens.operators.ordered import exact_quantiles
from loanlens.operators.stability import monitoring_from_counts
from loanlens.session import materialize

BINS = 10


def baseline_edges(baseline: DataFrame, score: str = "score", bins: int = BINS) -> DataFrame:
    """One row ``_inner``: distinct inner quantile edges of the baseline scores."""
    q = exact_quantiles(baseline, score, [i / bins for i in range(bins + 1)], out_prefix="_e")
    u = F.array_distinct(F.array(*[F.col(f"_e{i}") for i in range(bins + 1)]))
    return q.select(F.slice(u, 2, F.greatest(F.size(u) - 2, F.lit(0))).alias("_inner"))


def assign_bins(df: DataFrame, edges: DataFrame, score: str = "score") -> DataFrame:
    s = F.col(score)
    return (df.crossJoin(F.broadcast(edges))
              .withColumn("bin", F.size(F.filter(F.col("_inner"), lambda e: e < s)))
              .drop("_inner"))


def daily_score_bins(scores: DataFrame, edges: DataFrame, ts: str = "ts", score: str = "score") -> DataFrame:
    """Batch form: records per (day, baseline bin)."""
    b = assign_bins(scores, edges, score)
    return b.groupBy(F.to_date(F.col(ts)).alias("day"), "bin").agg(F.count(F.lit(1)).alias("records"))


def start_score_monitor(spark: SparkSession, source_dir: str, schema, edges: DataFrame, checkpoint_location: str,
                        score: Column | str = "score", sink: str = "parquet", query_name: str = "score_bins", watermark: str = "1 day",
                        available_now: bool = True, output_path: str | None = None) -> StreamingQuery:
    """Stream parquet score files from ``source_dir``; emit (day window, bin, records).

    ``score`` is a column of the files, or an expression over their columns;
    the sink is a Parquet folder (``output_path``) unless ``memory`` is asked for.
    """
    stream = spark.readStream.schema(schema).parquet(source_dir)
    scored = stream.select(F.col("ts").cast("timestamp").alias("ts"),
                           (F.col(score) if isinstance(score, str) else score).alias("score"))
    binned = assign_bins(scored, edges)
    counts = (binned.withWatermark("ts", watermark)
              .groupBy(F.window("ts", "1 day").alias("w"), "bin")
              .agg(F.count(F.lit(1)).alias("records"))
              .select(F.to_date(F.col("w.start")).alias("day"), "bin", "records"))
    writer = counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint_location)
    if sink == "memory":
        writer = writer.format("memory").queryName(query_name)
    else:
        writer = writer.format("parquet").option("path", output_path)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


# -- cohort monitoring as a stream (J5) --------------------------------------------

def _counts(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of ``cohort, score, label`` rows by (cohort, baseline bin); a score without a value has no bin."""
    s = F.col("score")
    has = s.isNotNull() & ~F.isnan(s)
    binned = scores.join(F.broadcast(edges), F.lit(True)).withColumn("_bin", F.when(has, F.size(F.filter("_inner", lambda e: e < s))))   # one row
    return binned.groupBy("cohort", "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.count("score").alias("_scored"), F.sum("score").alias("_score"),
        F.count("label").alias("_labelled"), F.sum("label").alias("_bad"))


def _named(scores: DataFrame, score: str, label: str, date: str) -> DataFrame:
    return scores.select(quarter_label(date).alias("cohort"), F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("label"))


def start_cohort_monitor(spark: SparkSession, source_dir: str, schema, edges: DataFrame, checkpoint_location: str, counts_path: str,
                         score: str, label: str, date: str, available_now: bool = True) -> StreamingQuery:
    """Count arriving scores by (cohort, baseline bin).

    Each micro-batch writes its counts below ``counts_path`` under its batch id,
    in place of what an earlier try of the same batch wrote: a restart counts
    nothing twice.  Counts of late rows add to their cohort's, so that nothing is dropped
    and no state is kept.
    """
    edges = materialize(edges)

    def write(batch: DataFrame, batch_id: int) -> None:
        _counts(_named(batch, score, label, date), edges).write.mode("overwrite").parquet(f"{counts_path}/batch_id={batch_id}")

    writer = spark.readStream.schema(schema).parquet(source_dir).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_location)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def cohort_status(spark: SparkSession, counts_path: str, baseline: DataFrame, edges: DataFrame, score: str, label: str, date: str) -> DataFrame:
    """The cohort monitoring table (size, bad rate, mean score, PSI, status) of all that has arrived, against ``baseline``.

    Reads the batches' counts, a few rows a batch and cohort, and the baseline.
    """
    base = _counts(_named(baseline, score, label, date), edges).groupBy("_bin").agg(F.sum("_n").alias("_ne"))
    counts = spark.read.parquet(counts_path).filter("cohort is not null")
    few = materialize(edges.agg(F.coalesce(F.max(F.size("_inner")), F.lit(0)).alias("k"))).first().k < 1
    return monitoring_from_counts(counts, materialize(base), F.lit(few))
