"""Chronological train / validation / test split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_ratios(train_ratio: float, val_ratio: float) -> None:
    if not 0.0 < train_ratio < 1.0:
        raise ValueError(f"train_ratio must lie in (0, 1): {train_ratio}")
    if not 0.0 < val_ratio < 1.0:
        raise ValueError(f"val_ratio must lie in (0, 1): {val_ratio}")
    if train_ratio + val_ratio >= 1.0:
        raise ValueError("train_ratio + val_ratio must be below 1")


def split_bounds(n: int, train_ratio: float = 0.70, val_ratio: float = 0.15) -> tuple[int, int]:
    """First row number of validation and of test."""
    check_ratios(train_ratio, val_ratio)
    return int(n * train_ratio), int(n * (train_ratio + val_ratio))


def split_chronological(df: DataFrame, train_ratio: float = 0.70, val_ratio: float = 0.15) -> DataFrame:
    """Add ``split`` to a table numbered 0..N-1 in time order by ``row_idx``."""
    train_end, val_end = split_bounds(df.count(), train_ratio, val_ratio)
    return df.withColumn(
        "split",
        F.when(F.col("row_idx") < train_end, "train").when(F.col("row_idx") < val_end, "val").otherwise("test"),
    )


def split_stats(df: DataFrame) -> DataFrame:
    """Rows, classes, ratio and time range of each split."""
    n, pos = F.count(F.lit(1)), F.sum("label")
    return df.groupBy("split").agg(
        n.alias("n_rows"),
        pos.cast("bigint").alias("n_positive"),
        (n - pos).cast("bigint").alias("n_negative"),
        F.round(pos / n, 8).alias("illicit_ratio"),
        F.date_format(F.min("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("date_start"),
        F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("date_end"),
    )


def split_manifest(df: DataFrame, train_ratio: float = 0.70, val_ratio: float = 0.15) -> DataFrame:
    """One row: creation time, the ratios and the statistics of the three splits."""
    stats = split_stats(df)
    return stats.agg(F.collect_list(F.struct(*stats.columns)).alias("splits")).select(
        F.current_timestamp().alias("created_at"),
        F.lit(train_ratio).alias("train_ratio"),
        F.lit(val_ratio).alias("val_ratio"),
        F.round(F.lit(1.0 - train_ratio - val_ratio), 6).alias("test_ratio"),
        "splits",
    )
