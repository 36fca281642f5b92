"""Transaction and account files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.functions.cleaning import type_transactions
from finsieve.schema import ACCOUNT_COLUMNS, RAW_COLUMNS, text_schema


def scan_raw(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under fixed names; the header line, which repeats a name, is skipped."""
    return spark.read.csv(path, schema=text_schema(RAW_COLUMNS), header=True, enforceSchema=True)


def load_transactions(spark: SparkSession, path: str) -> DataFrame:
    return type_transactions(scan_raw(spark, path))


def load_accounts(spark: SparkSession, path: str) -> DataFrame:
    """Account rows, without entirely empty ones, and their position in the file order."""
    raw = spark.read.csv(path, schema=text_schema(ACCOUNT_COLUMNS), header=True, enforceSchema=True)
    return raw.na.drop("all").withColumn(
        "file_pos",
        F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        ),
    )
