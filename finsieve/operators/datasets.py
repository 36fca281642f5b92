"""From files to the labelled, numbered and split table in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.operators.labels import create_labels, labelling_summary
from finsieve.operators.ordering import with_global_position
from finsieve.operators.splitting import check_ratios, split_chronological, split_manifest
from finsieve.schema import RAW_COLUMNS
from finsieve.sources.patterns import parse_patterns
from finsieve.sources.stored import load_features, path_exists, save_json, save_parquet
from finsieve.sources.transactions import load_accounts, load_transactions

LABELLED = "labelled"
SPLIT_MANIFEST = "split_manifest"


@dataclass
class Dataset:
    """``rows``: the stored table; ``summary``: one row of totals; ``path``: where both lie."""

    rows: DataFrame
    summary: DataFrame
    path: str

    def split(self, name: str) -> DataFrame:
        """Rows of one split, reading its folder only."""
        return load_features(self.rows.sparkSession, f"{self.path}/{LABELLED}", name)


def build_dataset(
    spark: SparkSession, out: str, transactions: str, accounts: str | None = None, patterns: str | None = None,
    train_ratio: float = 0.70, val_ratio: float = 0.15,
) -> Dataset:
    """Read, number by time, label and split the transactions, and store the result below ``out``.

    ``out/labelled`` has a folder per split, ``out/split_manifest`` the ratios and
    the statistics of the splits. Files that do not exist and ratios that leave a
    split empty are refused before anything is read. Rows of equal time are in the
    order of their other columns, so files may come in any number of parts.
    """
    check_ratios(train_ratio, val_ratio)
    absent = [path for path in (transactions, accounts, patterns) if path is not None and not path_exists(spark, path)]
    if absent:
        raise FileNotFoundError(f"no such input: {', '.join(absent)}")
    numbered = with_global_position(load_transactions(spark, transactions), RAW_COLUMNS)
    labelled = create_labels(numbered, None if patterns is None else parse_patterns(spark, patterns))
    path = f"{out}/{LABELLED}"
    save_parquet(split_chronological(labelled, train_ratio, val_ratio), path, ["split"])
    rows = spark.read.parquet(path)
    save_json(split_manifest(rows, train_ratio, val_ratio), f"{out}/{SPLIT_MANIFEST}")
    times = rows.agg(F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"))
    # one row each
    summary = labelling_summary(rows).join(F.broadcast(times))
    listed = F.lit(None).cast("bigint") if accounts is None else F.lit(load_accounts(spark, accounts).count()).cast("bigint")
    return Dataset(rows, summary.withColumn("n_accounts", listed), out)
