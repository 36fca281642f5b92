"""Typing and normalisation of raw text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.schema import (
    AMOUNT_COLUMNS,
    KEY_COLUMNS,
    RAW_COLUMNS,
    TEXT_COLUMNS,
    TIMESTAMP_FORMAT,
    require_columns,
)

# fixed values: block marker of the pattern file and the type that follows it
BEGIN_MARKER = "BEGIN LAUNDERING ATTEMPT"
END_MARKER = "END LAUNDERING ATTEMPT"
TYPE_PATTERN = r"BEGIN LAUNDERING ATTEMPT\s*-\s*([^:]+)"


def to_timestamp(text: Column, fmt: str = TIMESTAMP_FORMAT) -> Column:
    """Parsed timestamp, null where the text does not fit the format."""
    return F.try_to_timestamp(text, F.lit(fmt))


def to_number(text: Column) -> Column:
    """Double, null where the text is not a finite number."""
    number = F.trim(text).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def to_label(text: Column) -> Column:
    """0/1 label as int; unreadable labels and those beyond an int count as 0."""
    return F.coalesce(to_number(text).try_cast("int"), F.lit(0))


def enforce_types(df: DataFrame) -> DataFrame:
    """Trim the text columns and convert the amounts that are present."""
    casts = {c: F.trim(F.col(c).cast("string")) for c in TEXT_COLUMNS if c in df.columns}
    casts |= {c: to_number(F.col(c).cast("string")) for c in AMOUNT_COLUMNS if c in df.columns}
    return df.withColumns(casts)


def type_transactions(raw: DataFrame) -> DataFrame:
    """Raw text rows to typed rows; rows without a readable timestamp are dropped."""
    require_columns(raw, RAW_COLUMNS)
    typed = enforce_types(raw.withColumn("timestamp", to_timestamp(F.col("timestamp"))))
    return typed.withColumn("is_laundering_csv", to_label(F.col("is_laundering_csv"))).filter(
        F.col("timestamp").isNotNull()
    )


def timestamp_quality(raw: DataFrame) -> DataFrame:
    """One row: rows read, kept and dropped for an unreadable timestamp."""
    bad = to_timestamp(F.col("timestamp")).isNull()
    return raw.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~bad).alias("n_kept"),
        F.count_if(bad).alias("n_dropped"),
    )


def canonical(df: DataFrame) -> DataFrame:
    """The eight identifying columns, in order."""
    return df.select(*KEY_COLUMNS)


def ground_truth_labels(df: DataFrame) -> DataFrame:
    """Label columns from the file's own flag, pattern columns at their defaults."""
    return df.withColumns(
        {
            "label_existing_csv": F.col("is_laundering_csv"),
            "label": F.col("is_laundering_csv"),
            "label_from_patterns": F.lit(0),
            "mismatch_flag": F.lit(0),
            "pattern_type": F.lit("NONE"),
            "pattern_block_id": F.lit(-1).cast("bigint"),
        }
    )


def match_key() -> Column:
    """Pipe-separated identity of a transaction.

    Text is trimmed and lower-cased with leading zeros kept, time is cut to the
    minute, the amount has two decimals. Null without a time or an amount, so
    such a row never matches.
    """
    amount = F.col("amount_paid").try_cast("decimal(38,2)").cast("string")
    text = {c: F.coalesce(F.lower(F.trim(F.col(c))), F.lit("nan")) for c in KEY_COLUMNS if c in TEXT_COLUMNS}
    return F.when(
        F.col("timestamp").isNotNull() & F.col("amount_paid").isNotNull(),
        F.concat_ws(
            "|",
            F.date_format("timestamp", "yyyy-MM-dd HH:mm"),
            text["from_bank"],
            text["from_account"],
            text["to_bank"],
            text["to_account"],
            amount,
            text["payment_currency"],
            text["payment_format"],
        ),
    )


def pattern_type(line: Column) -> Column:
    """Type named on a block's first line, ``UNKNOWN`` when there is none."""
    found = F.trim(F.regexp_extract(line, TYPE_PATTERN, 1))
    return F.when(found != "", found).otherwise(F.lit("UNKNOWN"))
