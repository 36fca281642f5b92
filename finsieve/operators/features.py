"""The thirty model inputs of a transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.functions import scalars as S
from finsieve.functions.encoding import encode, fit_encoder
from finsieve.operators.joins import lookup
from finsieve.operators.rolling import with_rolling
from finsieve.schema import ACCOUNT_FEATURES, DERIVED_FEATURES, FEATURES, require_columns
from finsieve.session import materialize

_NEEDED = [
    "row_idx", "timestamp", "from_bank", "from_account", "to_bank", "to_account",
    "amount_paid", "amount_received", "payment_currency", "receiving_currency", "payment_format",
]


def row_features(df: DataFrame) -> DataFrame:
    """Features that need nothing but the row itself."""
    return df.withColumns(
        {
            "hour": S.hour_of(F.col("timestamp")),
            "day_of_week": S.weekday_of(F.col("timestamp")),
            "same_bank_flag": S.same_bank(),
            "self_transfer_flag": S.self_transfer(),
            "currency_mismatch": S.currency_mismatch(),
            "amount_ratio": S.amount_ratio(F.col("amount_received"), F.col("amount_paid")),
            "log_paid": F.log1p("amount_paid"),
            "log_received": F.log1p("amount_received"),
            "cross_bank": S.cross_bank(),
            "us": F.unix_micros(F.col("timestamp").cast("timestamp")),
        }
    )


def entity_types(accounts: DataFrame) -> DataFrame:
    """``(account, entity_type)``; of several rows for an account the last in the file counts.

    ``accounts`` carries ``file_pos``, the position of a row in its file.
    """
    return accounts.groupBy(F.trim("account_number").alias("account")).agg(
        F.max_by(S.entity_class(F.col("entity_name")), F.col("file_pos")).alias("entity_type")
    )


def with_entity_types(df: DataFrame, types: DataFrame, keys_from: DataFrame | None = None, **sizes) -> DataFrame:
    """Type of both parties, 2 for an unknown account.

    The types are stored first: they are worked out once for both joins. An
    account that holds many rows does not meet them in one task, however many
    accounts there are.
    """
    types = materialize(types, "entity-types")
    for role, column in (("sender", "from_account"), ("receiver", "to_account")):
        side = types.select(F.col("account").alias("_acc"), F.col("entity_type").alias("_type"))
        df = lookup(df, side, column, "_acc", keys_from, **sizes).withColumn(f"{role}_entity_type", F.coalesce("_type", F.lit(2))).drop("_type")
    return df


def account_features(
    df: DataFrame, types: DataFrame, scope: tuple[str, ...] = ("split",), keys_from: DataFrame | None = None, **rolling
) -> DataFrame:
    """Rolling columns of both roles and the two entity types, 2 for an unknown account.

    The receiver pass runs over the sender pass's output, so the rows are
    shuffled twice in all and no join by row number is needed. The types, stored
    first, are joined where the rows of an account lie together for its windows.
    """
    base = df if {"log_paid", "cross_bank", "us"} <= set(df.columns) else row_features(df)
    keys_from = base if keys_from is None else keys_from
    types = materialize(types, "entity-types")
    of = lambda name: types.select("account", F.col("entity_type").alias(name))
    sent = with_rolling(base, "from_account", "to_account", "sender", scope, keys_from=keys_from, facts=of("_sender_type"), **rolling)
    both = with_rolling(sent, "to_account", "from_account", "receiver", scope, keys_from=keys_from, facts=of("_receiver_type"), **rolling)
    named = {f"{r}_entity_type": F.coalesce(f"_{r}_type", F.lit(2)) for r in ("sender", "receiver")}
    return both.withColumns(named).drop("_sender_type", "_receiver_type")


def fan_scores(df: DataFrame) -> DataFrame:
    """Fan-in and fan-out from the two parties' 7-day windows."""
    return df.withColumns(
        {
            "fan_in_score": S.bounded_share(F.col("receiver_tx_count_7d"), F.col("sender_tx_count_7d")),
            "fan_out_score": S.bounded_share(
                F.col("sender_unique_counterparties_7d"), F.col("receiver_unique_counterparties_7d")
            ),
        }
    )


def assemble(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the thirty inputs as doubles, in model order."""
    values = {
        "amount_paid": F.col("log_paid"),
        "amount_received": F.col("log_received"),
        "payment_format": F.col("payment_format_code"),
        "payment_currency": F.col("payment_currency_code"),
    }
    values |= {c: F.col(c) for c in DERIVED_FEATURES + ACCOUNT_FEATURES}
    return df.select(*keep, *[values[c].cast("double").alias(c) for c in FEATURES])


def feature_table(
    df: DataFrame,
    accounts: DataFrame,
    scope: tuple[str, ...] = ("split",),
    keep: tuple[str, ...] = ("row_idx", "split", "label"),
    encoder: DataFrame | None = None,
    **rolling,
) -> DataFrame:
    """Feature table of a labelled, split transaction table.

    Category codes come from ``encoder``, or from the rows of the training split.
    An unseen category is null. ``scope`` separates account histories: by default
    each split starts without any; ``()`` carries them across splits.
    """
    require_columns(df, _NEEDED)
    # short columns only from here on: the rolling passes carry them through two shuffles
    encoder = fit_encoder(df.filter(F.col("split") == "train")) if encoder is None else encoder
    coded = encode(df, encoder)
    carried = [
        *keep, "row_idx", "from_account", "to_account", *scope, "us", "cross_bank", "log_paid", "log_received",
        "payment_format_code", "payment_currency_code", *[c for c in DERIVED_FEATURES if not c.startswith("fan_")],
    ]
    base = row_features(coded).select(*dict.fromkeys(carried))
    rolled = account_features(base, entity_types(accounts), scope, keys_from=row_features(df), **rolling)
    return assemble(fan_scores(rolled), list(keep))
