"""Pattern files: transaction rows in blocks between BEGIN and END lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finsieve.functions.cleaning import BEGIN_MARKER, END_MARKER, enforce_types, pattern_type, to_timestamp
from finsieve.schema import RAW_COLUMNS


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines with their file, the input split they came from and their order in it.

    A split is a bounded piece of a file, so no task needs a whole file.
    """
    return (
        spark.read.text(path)
        .select(
            F.trim("value").alias("line"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("piece"),
            F.monotonically_increasing_id().alias("pos"),
        )
        .filter("line <> ''")
    )


def parse_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Typed transaction rows with ``pattern_type``, ``pattern_block_id`` and ``file_pos``.

    Blocks are numbered from 1 in each file. A line with too many fields is
    dropped with its block data; a row without a readable timestamp is dropped.
    :func:`dropped_lines` counts both.
    """
    typed = _typed(spark, path).filter(F.col("_surplus").isNull() & F.col("timestamp").isNotNull())
    # every row of a pattern file is illicit
    return typed.drop("_surplus").withColumn("is_laundering_csv", F.lit(1))


def dropped_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of each file that :func:`parse_patterns` drops: ``file, surplus_fields, bad_timestamp``."""
    surplus = F.col("_surplus").isNotNull()
    return _typed(spark, path).groupBy(F.col("file_pos.file").alias("file")).agg(
        F.count_if(surplus).alias("surplus_fields"), F.count_if(~surplus & F.col("timestamp").isNull()).alias("bad_timestamp")
    )


def _typed(spark: SparkSession, path: str) -> DataFrame:
    """Every line that is none of the markers, with what exceeds its fields as ``_surplus``."""
    lines = _numbered_lines(spark, path).withColumn("is_begin", F.col("line").startswith(BEGIN_MARKER).cast("int"))
    lines = lines.withColumn("own_type", F.when(F.col("is_begin") == 1, pattern_type(F.col("line"))))

    # what earlier pieces of the file leave behind: blocks begun and the open type
    ordered = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        lines.groupBy("file", "piece")
        .agg(F.sum("is_begin").alias("begun"), F.max_by("own_type", F.when(F.col("is_begin") == 1, F.col("pos"))).alias("open"))
        .select(
            "file",
            "piece",
            F.coalesce(F.sum("begun").over(ordered), F.lit(0)).alias("begun_before"),
            F.last("open", ignorenulls=True).over(ordered).alias("open_before"),
        )
    )
    here = Window.partitionBy("file", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.withColumns(
        {"begun_here": F.sum("is_begin").over(here), "open_here": F.last("own_type", ignorenulls=True).over(here)}
    ).join(carried, ["file", "piece"])
    rows = placed.filter(
        (F.col("is_begin") == 0)
        & ~F.col("line").startswith(END_MARKER)
    )
    # a comma inside quotes is none of the fields' limits; one field more shows a line with too many
    fields = ", ".join(f"{c} STRING" for c in [*RAW_COLUMNS, "_surplus"])
    parsed = rows.select(
        F.from_csv("line", fields).alias("f"),
        F.coalesce("open_here", "open_before", F.lit("UNKNOWN")).alias("pattern_type"),
        (F.col("begun_before") + F.col("begun_here")).alias("pattern_block_id"),
        F.struct("file", "piece", "pos").alias("file_pos"),
    ).select("f.*", "pattern_type", "pattern_block_id", "file_pos")
    return enforce_types(parsed.withColumn("timestamp", to_timestamp(F.col("timestamp"))))
