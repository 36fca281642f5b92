"""Giving back the space of stored tables that nothing reads any more."""

from __future__ import annotations

from pyspark.sql import DataFrame


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables made by ``materialize``; no plan may read them again."""
    for stored in tables:
        spark = stored.sparkSession
        folders = {path.rsplit("/", 1)[0] for path in stored.inputFiles()}
        for folder in folders:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
