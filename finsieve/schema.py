"""Column names and types shared by all modules.

The name lists and their order are fixed values: they are the table formats
that readers, features and models agree on.
"""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: raw transaction file, by position
RAW_COLUMNS = [
    "timestamp",
    "from_bank",
    "from_account",
    "to_bank",
    "to_account",
    "amount_received",
    "receiving_currency",
    "amount_paid",
    "payment_currency",
    "payment_format",
    "is_laundering_csv",
]

# fixed values: the eight columns that identify a transaction
KEY_COLUMNS = [
    "timestamp",
    "from_bank",
    "from_account",
    "to_bank",
    "to_account",
    "amount_paid",
    "payment_currency",
    "payment_format",
]

# fixed values: account file, by position
ACCOUNT_COLUMNS = ["bank_name", "bank_id", "account_number", "entity_id", "entity_name"]

# fixed values: raw timestamp format
TIMESTAMP_FORMAT = "yyyy/MM/dd HH:mm"

AMOUNT_COLUMNS = [c for c in RAW_COLUMNS if c.startswith("amount_")]
TEXT_COLUMNS = [c for c in RAW_COLUMNS if c not in ("timestamp", "is_laundering_csv", *AMOUNT_COLUMNS)]

# fixed values: model input order
NUMERIC_FEATURES = ["amount_paid", "amount_received"]
CATEGORY_FEATURES = ["payment_format", "payment_currency"]
DERIVED_FEATURES = [
    "hour",
    "day_of_week",
    "same_bank_flag",
    "self_transfer_flag",
    "currency_mismatch",
    "amount_ratio",
    "fan_in_score",
    "fan_out_score",
]
ROLE_FEATURES = [
    "tx_count_1d",
    "tx_count_7d",
    "tx_count_30d",
    "avg_amount_7d",
    "avg_amount_30d",
    "unique_counterparties_7d",
    "unique_counterparties_30d",
    "cross_bank_ratio_30d",
    "entity_type",
]
ACCOUNT_FEATURES = [f"{role}_{name}" for role in ("sender", "receiver") for name in ROLE_FEATURES]
FEATURES = NUMERIC_FEATURES + CATEGORY_FEATURES + DERIVED_FEATURES + ACCOUNT_FEATURES


def text_schema(names: list[str]) -> T.StructType:
    """Every column as a string; typing happens after the read."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def require_columns(df, names) -> None:
    """Fail at plan time when ``df`` lacks a column."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
