"""SparkSession helper.

ANSI mode stays on (the Spark 4 default); dirty input is handled with
``try_*`` functions instead.  AQE is enabled so shuffle partition counts and
join strategies are re-planned at runtime from real statistics.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


#: SQL settings that are put in place where nobody has set them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "loanlens") -> SparkSession:
    """Return (or create) a session configured for this library.

    What the launcher or a running session has set stays.  ``master`` and
    ``shuffle_partitions`` are for callers that launch Spark themselves
    (tests, benchmark); without them everything is the launcher's choice.
    """
    running = SparkSession.getActiveSession()
    builder = SparkSession.builder.appName(app_name)
    if master and not running:
        builder = (builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
                   .config("spark.driver.memory", os.environ.get("LOANLENS_DRIVER_MEMORY", "16g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not running:
        launched = spark.sparkContext.getConf()
        wanted = dict(DEFAULTS)
        if shuffle_partitions or _local(spark):
            wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions or os.environ.get("BENCH_CPUS", "8"))
        for k, v in wanted.items():
            if not launched.contains(k):
                spark.conf.set(k, v)
    return spark


_FOLDERS: dict[tuple[str, str], str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """This application's folder below the reliable checkpoint folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is read
    from the session.  A private scratch folder stands in for
    it only where driver and executors are one local process.  The
    application's own folder goes when the driver's JVM ends, or by ``clean_up``.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not _local(spark):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="loanlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    key = (configured, spark.sparkContext.applicationId)
    if key not in _FOLDERS:
        folder = f"{configured.rstrip('/')}/loanlens-{key[1]}"
        fs, path = _file_system(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _FOLDERS[key] = folder
    return _FOLDERS[key]


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def clean_up(spark: SparkSession) -> None:
    """Delete all stored intermediate tables of this application; results that still read them can't be used any more."""
    fs, path = _file_system(spark, checkpoint_dir(spark))
    fs.delete(path, True)
    fs.mkdirs(path)


def materialize(df):
    """Cut lineage by writing ``df`` as Parquet in the shared checkpoint folder and reading it back.

    Used for small reused tables (edges, offsets, totals) and for gold tables
    that several branches of one plan read; what follows reads only the
    columns it needs from the written files, which survive executor loss, and
    the upstream plan runs once.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
