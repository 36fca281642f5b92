"""Transaction files taken in as they arrive.

A log too large for one read is loaded piece by piece: each trigger takes a
bounded number of new files, types and labels their rows and appends them to a
table. Progress is kept in the checkpoint folder, so a restarted load goes on
where it stopped and takes no file twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from finsieve.functions.cleaning import ground_truth_labels, type_transactions
from finsieve.schema import RAW_COLUMNS, text_schema


def read_transaction_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Typed and labelled rows of the CSV files that appear in ``folder``."""
    raw = (
        spark.readStream.schema(text_schema(RAW_COLUMNS))
        .option("header", True)
        .option("enforceSchema", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(folder)
    )
    return ground_truth_labels(type_transactions(raw))


def load_incrementally(
    spark: SparkSession, folder: str, table: str, checkpoint: str, files_per_trigger: int = 64
) -> StreamingQuery:
    """Append all files that are there now to the parquet table and stop."""
    return (
        read_transaction_stream(spark, folder, files_per_trigger)
        .writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
