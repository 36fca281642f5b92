"""Data checks on a labelled transaction table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.operators.ranking import even_quantiles


def dataset_summary(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    pos = F.sum(F.col("label").cast("bigint"))
    return df.agg(
        n.alias("n_rows"),
        pos.alias("n_illicit"),
        (pos / n).alias("illicit_ratio"),
        F.date_format(F.min("timestamp"), "yyyy-MM-dd HH:mm").alias("first_time"),
        F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm").alias("last_time"),
    )


def cross_tab(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """Counts of each pair, one column per entry of ``values``."""
    cells = [F.count_if(F.col(columns) == v).alias(f"{columns}_{v}") for v in values]
    return df.groupBy(rows).agg(*cells)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value")


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of a numeric column."""
    base = df.agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
    q = even_quantiles(df, column, 4)
    at = {"q25": 1, "q50": 2, "q75": 3}
    # one row on either side
    quartiles = q.agg(*[F.max(F.when(F.col("j") == j, F.col("quantile"))).alias(name) for name, j in at.items()])
    return base.join(F.broadcast(quartiles))


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing values per column, one row per column, from a single pass."""
    names = columns or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return wide.unpivot([], names, "column_name", "n_null")


def daily_volume(df: DataFrame) -> DataFrame:
    """Rows, positives and their ratio for every day from the first to the last.

    Days without rows appear with zero counts and a null ratio.
    """
    day = F.to_date("timestamp")
    busy = df.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("label").cast("bigint")).alias("illicit")
    )
    span = busy.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    total = F.coalesce("total", F.lit(0)).cast("bigint")
    illicit = F.coalesce("illicit", F.lit(0)).cast("bigint")
    return days.join(busy, "day", "left").select(
        "day", total.alias("total"), illicit.alias("illicit"), F.when(total > 0, illicit / total).alias("illicit_ratio")
    )
