"""Joining a large table with a smaller one when single keys hold many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.operators.ordering import CHUNK_BITS
from finsieve.session import materialize

#: A table of so many rows at most is sent to every task.
BROADCAST_ROWS = 100_000


def lookup(
    df: DataFrame, table: DataFrame, column: str, key: str, keys_from: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = 1 << CHUNK_BITS,
) -> DataFrame:
    """``df`` with the other columns of the stored ``table``'s row whose ``key`` equals ``column``, null without one.

    ``table`` has one row per key. Up to ``broadcast_rows`` rows it is broadcast.
    Beyond, only rows of keys that occur ``hot_rows`` times or less are shuffled:
    hot keys, of which there are at most one per ``hot_rows`` rows, are found by
    count and their table rows broadcast; rows without a key are not joined at
    all. ``keys_from`` may name a cheaper table with the same keys to count.
    """
    if table.count() <= broadcast_rows:
        return df.join(F.broadcast(table), F.col(column) == F.col(key), "left").drop(key)
    counts = (df if keys_from is None else keys_from).filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialize(counts.filter(F.col("_n") > hot_rows).select("_hot"), "hot-keys")
    there = df.filter(F.col(column).isNotNull())
    none = df.filter(F.col(column).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != key])
    if hot.isEmpty():
        return there.join(table, F.col(column) == F.col(key), "left").drop(key).unionByName(none)
    is_hot = F.col(column) == F.col("_hot")
    rare = there.join(F.broadcast(hot), is_hot, "left_anti").join(table, F.col(column) == F.col(key), "left").drop(key)
    wanted = hot.join(table, F.col("_hot") == F.col(key), "left").drop(key)
    often = there.join(F.broadcast(wanted), is_hot).drop("_hot")
    return rare.unionByName(often).unionByName(none)
