"""Session defaults and the shared scratch area."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes the shuffle files of a query when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch handed to Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_local_scratch: dict[str, str] = {}


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "finsieve") -> SparkSession:
    """Single-machine session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FINSIEVE_DRIVER_MEMORY", "12g"))
        .config("spark.checkpoint.dir", os.environ.get("FINSIEVE_SCRATCH") or tempfile.mkdtemp(prefix="finsieve-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    A temporary folder is only acceptable when driver and executors are one
    process, so anything but a local master must configure the setting.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="finsieve-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/{app}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as a scratch table and return a scan of it.

    Used instead of caching: the table survives executor loss, later reads
    prune columns and the plan starts from a fresh scan with known size.
    ``batch_bytes`` bounds the batches that Python tasks of ``df`` are handed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    # the stored table replaces the shuffles it came from
    wanted = {SHUFFLE_CLEANUP: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {SHUFFLE_CLEANUP: spark.conf.get(SHUFFLE_CLEANUP, "false")} | ({BATCH_BYTES: spark.conf.get(BATCH_BYTES)} if batch_bytes else {})
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)
