"""Session settings and durable intermediate storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Merge sessions map-side before the shuffle, so one busy key does not land in one task.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(master: str | None = None, app: str = "basketry", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Removes the shuffle files of a query when it ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Folders that this process made for local runs; they go when it ends.
_OWN: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Where it is unset, a local run gets a folder of its own,
    which is removed when the process ends; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN.append(tempfile.TemporaryDirectory(prefix="basketry-", ignore_cleanup_errors=True))
        named = _OWN[-1].name
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; never one that already holds data."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Store the rows as a table in the shared folder and read them from there.

    The lineage ends at the files, so a lost executor never changes what was read; later scans prune columns, and joins
    are planned by the true size. What was shuffled on the way goes as soon as the rows are stored, not when the driver next
    collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stored")
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(stored: DataFrame) -> None:
    """Remove the files of rows that `durable` stored and nothing reads any more."""
    spark = stored.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in stored.inputFiles()}:
        if not folder.rsplit("/", 1)[-1].startswith("stored-"):
            raise ValueError(f"not a stored table: {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
