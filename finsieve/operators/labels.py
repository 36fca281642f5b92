"""Linking transactions to the pattern file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.functions.cleaning import ground_truth_labels, match_key
from finsieve.session import materialize


def first_by_key(df: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each key by ``position``; rows without a key are dropped.

    An aggregate, not a window: rows of one key are combined before the shuffle.
    """
    others = [c for c in df.columns if c != key]
    picked = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*others), F.col(position)).alias("_first"))
    return picked.select(key, "_first.*")


def attach_patterns(txn: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pattern type and block of the first pattern row with the same match key.

    Unmatched rows get ``NONE`` and -1. Rows without a key get a key of their own
    that nothing equals, so that they do not meet in one task.
    """
    side = first_by_key(
        patterns.select(match_key().alias("_key"), "pattern_type", "pattern_block_id", "file_pos"), "_key", "file_pos"
    ).select(F.col("_key").alias("_pkey"), F.col("pattern_type").alias("_type"), F.col("pattern_block_id").alias("_block"))
    # stored, so that the join is planned by the true size of the pattern list
    side = materialize(side, "pattern-keys")
    keyed = txn.withColumn("_key", F.coalesce(match_key(), F.concat(F.lit("none#"), F.col("row_idx").cast("string"))))
    return (
        keyed.join(side, F.col("_key") == F.col("_pkey"), "left")
        .withColumns(
            {
                "pattern_type": F.coalesce("_type", F.lit("NONE")),
                "pattern_block_id": F.coalesce("_block", F.lit(-1)).cast("bigint"),
                "label_from_patterns": F.col("_pkey").isNotNull().cast("int"),
            }
        )
        .drop("_key", "_pkey", "_type", "_block")
    )


def create_labels(txn: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Label columns of typed transactions.

    Without ``patterns`` the pattern columns stay at their defaults. With them,
    they are filled and ``mismatch_flag`` marks positives the pattern file lacks.
    """
    labelled = ground_truth_labels(txn)
    if patterns is None:
        return labelled
    linked = attach_patterns(labelled.drop("pattern_type", "pattern_block_id", "label_from_patterns"), patterns)
    missed = (F.col("label_existing_csv") == 1) & (F.col("label_from_patterns") == 0)
    return linked.withColumn("mismatch_flag", missed.cast("int"))


def unmatched_keys(patterns: DataFrame, txn: DataFrame) -> DataFrame:
    """Distinct pattern keys that no transaction has."""
    keys = lambda df: df.select(match_key().alias("match_key")).filter("match_key IS NOT NULL")
    return keys(patterns).subtract(keys(txn))


def labelling_summary(labelled: DataFrame) -> DataFrame:
    """One row of totals for a labelled table."""
    n = F.count(F.lit(1))
    csv, pat = F.col("label_existing_csv"), F.col("label_from_patterns")
    return labelled.agg(
        n.alias("n_rows"),
        F.sum(csv.cast("bigint")).alias("n_illicit_csv"),
        F.sum(pat.cast("bigint")).alias("n_illicit_patterns"),
        F.sum(F.col("mismatch_flag").cast("bigint")).alias("n_mismatch"),
        (F.sum(csv.cast("bigint")) / n).alias("illicit_ratio"),
        F.count_distinct(F.when(pat == 1, F.col("pattern_block_id"))).alias("n_blocks"),
    )


def pattern_type_counts(labelled: DataFrame) -> DataFrame:
    """Matched transactions per pattern type."""
    return labelled.filter("label_from_patterns = 1").groupBy("pattern_type").agg(F.count(F.lit(1)).alias("n"))
