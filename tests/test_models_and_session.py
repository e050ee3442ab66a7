"""Feature slots and their names, guards, and whose settings count."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from loanlens.operators import models as ML
from loanlens.operators import split as SP

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _loans(spark, n=1200):
    return spark.range(n).select(
        F.col("id").cast("string").alias("loan_id"),
        (F.col("id") % 17).cast("double").alias("noise"),
        F.when(F.col("id") % 3 == 0, "Y").when(F.col("id") % 3 == 1, "X").otherwise("Z").alias("purpose"),
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("channel"),
        ((F.col("id") % 3 == 0) | (F.col("id") % 41 == 0)).cast("int").alias(SP.LABEL))


def test_unseen_category_has_no_slot_and_gain_has_the_right_name(spark):
    m = ML.fit(_loans(spark), "boosted", ML.boosted(max_iter=3, min_instances=5))
    assert m.feature_names() == ["noise", "purpose_X", "purpose_Y", "purpose_Z", "channel_A", "channel_B"]
    assert ML.importance(m).first()["feature"] == "purpose_Y"
    unseen = _loans(spark, 1).withColumn("purpose", F.lit("new")).withColumn("channel", F.lit(None).cast("string"))
    x = m.pipeline.transform(ML.apply_categorical(unseen, m.prep, m.categorical)).first()["features"].toArray().tolist()
    assert len(x) == 6 and x[1:4] == [0, 0, 0] and sum(x[4:]) == 1       # null takes the training mode


def test_split_guard(spark):
    loans = _loans(spark, 60)
    SP.check_split(loans, loans)
    with pytest.raises(ValueError, match="test"):
        SP.check_split(loans, loans.filter(f"{SP.LABEL} = 0"))
    with pytest.raises(ValueError, match="train"):
        SP.check_split(loans.limit(0), loans)
    with pytest.raises(ValueError, match="numeric"):
        SP.feature_groups(loans.select("loan_id", "purpose"))


def test_the_launcher_wins():
    code = ("from loanlens.session import get_spark; s = get_spark(); "
            "print('GOT', s.conf.get('spark.sql.shuffle.partitions'), s.conf.get('spark.sql.adaptive.enabled'))")
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS":
                        "--master local[1] --conf spark.sql.shuffle.partitions=2000 --conf spark.sql.adaptive.enabled=false pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert "GOT 2000 false" in out.stdout, out.stderr[-500:]


def test_cohort_guards(spark):
    from loanlens.operators import stability as S
    one = spark.createDataFrame([(i / 10, i % 2, "2024-02-01") for i in range(10)], "pd double, bad int, d string").withColumn("d", F.to_date("d"))
    with pytest.raises(Exception, match="two quarters"):
        S.monitoring_table(one, "pd", "bad", "d").collect()


def test_fit_spreads_a_table_stored_in_one_file(spark, monkeypatch):
    """Solvers work in the partitions that they get: many rows in one file are dealt to the cores, few rows stay."""
    one = spark.range(5000).coalesce(1)
    assert ML.spread(one).rdd.getNumPartitions() == 1
    monkeypatch.setattr(ML, "TASK_ROWS", 1000)
    many = ML.spread(one)
    assert many.rdd.getNumPartitions() == min(5, spark.sparkContext.defaultParallelism)
    assert many.count() == 5000 and many.distinct().count() == 5000
