"""Category codes fitted on one table and applied to others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finsieve.schema import CATEGORY_FEATURES
from finsieve.session import materialize


def fit_codes(train: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values with codes 0, 1, 2, … as ``(category, code)``.

    Text nulls count as the category ``nan``. The window runs over the distinct
    values only, one row per category.
    """
    values = train.select(F.coalesce(F.col(column), F.lit("nan")).alias("category")).distinct()
    return values.withColumn("code", (F.row_number().over(Window.orderBy("category")) - 1).cast("double"))


def apply_codes(df: DataFrame, codes: DataFrame, column: str, out: str) -> DataFrame:
    """Attach the code of ``column`` as ``out``; null for a value not seen in the fit."""
    table = codes.select(F.col("category").alias("_category"), F.col("code").alias(out))
    key = F.coalesce(F.col(column), F.lit("nan"))
    return df.join(table, key == F.col("_category"), "left").drop("_category")


def fit_encoder(train: DataFrame, columns: list[str] = CATEGORY_FEATURES) -> DataFrame:
    """Codes of several columns as one stored table ``(feature, category, code)``.

    It is written out, so that a join against it is planned by its true size:
    sent to all tasks while small, shuffled beyond Spark's threshold.
    """
    parts = [fit_codes(train, c).select(F.lit(c).alias("feature"), "category", "code") for c in columns]
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    return materialize(table, "encoder")


def encode(df: DataFrame, encoder: DataFrame, columns: list[str] = CATEGORY_FEATURES, suffix: str = "_code") -> DataFrame:
    """Attach the code of each column; null for a value the encoder has not seen."""
    for c in columns:
        df = apply_codes(df, encoder.filter(F.col("feature") == c), c, f"{c}{suffix}")
    return df
