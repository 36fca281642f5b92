"""Queries on row features, codes, rolling windows and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from finsieve.functions import encoding as E
from finsieve.functions import scalars as S
from finsieve.operators import features as FT
from finsieve.operators.rolling import with_rolling
from finsieve.plans import tables as T
from finsieve.plans.oracle_views import VIEWS, role_columns
from finsieve.plans.registry import query
from finsieve.schema import ACCOUNT_FEATURES, FEATURES
from finsieve.session import scratch_path
from finsieve.sources import stored


def _rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "temporal_features",
    "SELECT row_idx, CAST(hour(ts) AS DOUBLE) AS hour, CAST((dayofweek(ts) + 6) % 7 AS DOUBLE) AS day_of_week FROM txn",
)
def temporal_features(spark, sf_dir):
    return FT.row_features(T.txn(spark, sf_dir)).select("row_idx", "hour", "day_of_week")


@query(
    "event_temporal_features",
    "SELECT event_id, CAST(hour(ts) AS DOUBLE) AS hour, CAST((dayofweek(ts) + 6) % 7 AS DOUBLE) AS day_of_week FROM events",
    (),
)
def event_temporal_features(spark, sf_dir):
    T.pin_utc(spark)
    return T.read(spark, sf_dir, "events").select(
        "event_id", S.hour_of(F.col("ts")).alias("hour"), S.weekday_of(F.col("ts")).alias("day_of_week")
    )


@query(
    "flag_features",
    """SELECT row_idx, CAST(from_bank = to_bank AS DOUBLE) AS same_bank_flag, CAST(from_account = to_account AS DOUBLE) AS self_transfer_flag,
       CAST(payment_currency <> receiving_currency AS DOUBLE) AS currency_mismatch FROM txn""",
)
def flag_features(spark, sf_dir):
    return FT.row_features(T.txn(spark, sf_dir)).select("row_idx", "same_bank_flag", "self_transfer_flag", "currency_mismatch")


@query(
    "amount_ratio",
    """SELECT row_idx, round(greatest(0.0, least(10.0, CASE WHEN amount_paid > 0 THEN amount_received / amount_paid ELSE 1.0 END)), 6) AS amount_ratio
FROM typed WHERE amount_received IS NOT NULL UNION ALL
SELECT row_idx, CASE WHEN amount_paid > 0 THEN NULL ELSE CAST(1 AS DOUBLE) END FROM typed WHERE amount_received IS NULL""",
    ("typed",),
)
def amount_ratio(spark, sf_dir):
    from finsieve.functions.cleaning import type_transactions

    typed = type_transactions(T.raw(spark, sf_dir))
    ratio = S.amount_ratio(F.col("amount_received"), F.col("amount_paid"))
    return typed.select("row_idx", F.round(ratio, 6).alias("amount_ratio"))


@query(
    "log_amounts",
    "SELECT row_idx, round(ln(1 + amount_paid), 6) AS log_paid, round(ln(1 + amount_received), 6) AS log_received FROM txn",
)
def log_amounts(spark, sf_dir):
    return _rounded(FT.row_features(T.txn(spark, sf_dir)).select("row_idx", "log_paid", "log_received"), ["log_paid", "log_received"])


@query(
    "entity_class",
    """SELECT account_number, entity_name, CASE WHEN contains(entity_name, 'Corporation') THEN 0
       WHEN contains(entity_name, 'Partnership') THEN 1 ELSE 2 END AS entity_type FROM listed""",
    ("listed",),
)
def entity_class(spark, sf_dir):
    return T.listed_accounts(spark, sf_dir).select(
        "account_number", "entity_name", S.entity_class(F.col("entity_name")).alias("entity_type")
    )


@query(
    "entity_join",
    """SELECT t.row_idx, COALESCE(a.kind, 2) AS sender_entity_type, COALESCE(b.kind, 2) AS receiver_entity_type
FROM txn t LEFT JOIN entity a ON t.from_account = a.account LEFT JOIN entity b ON t.to_account = b.account""",
    ("txn", "entity"),
)
def entity_join(spark, sf_dir):
    types = FT.entity_types(T.listed_accounts(spark, sf_dir))
    rows = T.txn(spark, sf_dir).select("row_idx", "from_account", "to_account")
    return FT.with_entity_types(rows, types).drop("from_account", "to_account")


_CODES = "(SELECT {c} AS category, CAST(row_number() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT {c} FROM train))"


@query(
    "ordinal_fit",
    "SELECT 'payment_format' AS feature, category, code FROM " + _CODES.format(c="payment_format")
    + " UNION ALL SELECT 'payment_currency', category, code FROM " + _CODES.format(c="payment_currency"),
    ("train",),
)
def ordinal_fit(spark, sf_dir):
    return E.fit_encoder(T.train(spark, sf_dir))


# fitted on the positives only, so that categories without one are unseen
_SEEN = "(SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT payment_format AS category FROM train WHERE label = 1))"


@query(
    "ordinal_apply",
    f"SELECT t.row_idx, s.code AS payment_format_code FROM txn t LEFT JOIN {_SEEN} s ON t.payment_format = s.category",
    ("txn", "train"),
)
def ordinal_apply(spark, sf_dir):
    encoder = E.fit_encoder(T.train(spark, sf_dir).filter("label = 1"), ["payment_format"])
    rows = T.txn(spark, sf_dir).select("row_idx", "payment_format")
    return E.encode(rows, encoder, ["payment_format"]).drop("payment_format")


def _windowed(spark, sf_dir):
    """The columns that windows need; others would be shuffled along."""
    return FT.row_features(T.txn(spark, sf_dir)).select("row_idx", "split", "from_account", "to_account", "us", "log_paid", "cross_bank")


def _rolled(spark, sf_dir, names):
    """Both roles' rolling columns whose name contains one of ``names``."""
    base = _windowed(spark, sf_dir)
    sent = with_rolling(base, "from_account", "to_account", "sender", ("split",), keys_from=base)
    both = with_rolling(sent, "to_account", "from_account", "receiver", ("split",), keys_from=base)
    # means come from whole numbers by one division, so they need no rounding
    return both.select("row_idx", *[c for c in ACCOUNT_FEATURES if any(n in c for n in names)])


def _picked(names):
    """The matching columns of both roles from the self-join views."""
    columns = [c for c in ACCOUNT_FEATURES if any(n in c for n in names)]
    inner = f"SELECT s.row_idx, {role_columns('s', 'sender')}, {role_columns('g', 'receiver')} FROM sent s JOIN got g ON s.row_idx = g.row_idx"
    return f"SELECT row_idx, {', '.join(columns)} FROM ({inner})"


@query("rolling_count", _picked(["tx_count"]), ("sent", "got"))
def rolling_count(spark, sf_dir):
    return _rolled(spark, sf_dir, ["tx_count"])


@query("rolling_mean", _picked(["avg_amount"]), ("sent", "got"))
def rolling_mean(spark, sf_dir):
    return _rolled(spark, sf_dir, ["avg_amount"])


@query("rolling_distinct", _picked(["unique_counterparties"]), ("sent", "got"))
def rolling_distinct(spark, sf_dir):
    return _rolled(spark, sf_dir, ["unique_counterparties"])


@query("rolling_ratio", _picked(["cross_bank_ratio"]), ("sent", "got"))
def rolling_ratio(spark, sf_dir):
    return _rolled(spark, sf_dir, ["cross_bank_ratio"])


_ACCOUNT_SQL = f"""SELECT s.row_idx, {role_columns('s', 'sender')}, COALESCE(a.kind, 2) AS sender_entity_type,
       {role_columns('g', 'receiver')}, COALESCE(b.kind, 2) AS receiver_entity_type
FROM txn t JOIN sent s ON t.row_idx = s.row_idx JOIN got g ON t.row_idx = g.row_idx
LEFT JOIN entity a ON t.from_account = a.account LEFT JOIN entity b ON t.to_account = b.account"""


@query("account_features", _ACCOUNT_SQL, ("txn", "sent", "got", "entity"))
def account_features(spark, sf_dir):
    types = FT.entity_types(T.listed_accounts(spark, sf_dir))
    return FT.account_features(_windowed(spark, sf_dir), types).select("row_idx", *ACCOUNT_FEATURES)


_FANS = """round(CASE WHEN s.n7 > 0 THEN least(100.0, g.n7 / (s.n7 + 1e-6)) ELSE 0.0 END, 6) AS fan_in_score,
       round(CASE WHEN g.u7 > 0 THEN least(100.0, s.u7 / (g.u7 + 1e-6)) ELSE 0.0 END, 6) AS fan_out_score"""


@query("fan_scores", f"SELECT s.row_idx, {_FANS} FROM sent s JOIN got g ON s.row_idx = g.row_idx", ("sent", "got"))
def fan_scores(spark, sf_dir):
    base = _windowed(spark, sf_dir)
    sent = with_rolling(base, "from_account", "to_account", "sender", ("split",), keys_from=base)
    both = with_rolling(sent, "to_account", "from_account", "receiver", ("split",), keys_from=base)
    return _rounded(FT.fan_scores(both).select("row_idx", "fan_in_score", "fan_out_score"), ["fan_in_score", "fan_out_score"])


_MATRIX_SQL = f"""SELECT t.row_idx, t.split, t.label, round(ln(1 + t.amount_paid), 6) AS amount_paid, round(ln(1 + t.amount_received), 6) AS amount_received,
       f.code AS payment_format, c.code AS payment_currency, CAST(hour(t.ts) AS DOUBLE) AS hour,
       CAST((dayofweek(t.ts) + 6) % 7 AS DOUBLE) AS day_of_week, CAST(t.from_bank = t.to_bank AS DOUBLE) AS same_bank_flag,
       CAST(t.from_account = t.to_account AS DOUBLE) AS self_transfer_flag,
       CAST(t.payment_currency <> t.receiving_currency AS DOUBLE) AS currency_mismatch,
       round(greatest(0.0, least(10.0, CASE WHEN t.amount_paid > 0 THEN t.amount_received / t.amount_paid ELSE 1.0 END)), 6) AS amount_ratio,
       {_FANS}, a.* EXCLUDE (row_idx)
FROM txn t JOIN sent s ON t.row_idx = s.row_idx JOIN got g ON t.row_idx = g.row_idx
JOIN ({_ACCOUNT_SQL}) a ON t.row_idx = a.row_idx
LEFT JOIN {_CODES.format(c="payment_format")} f ON t.payment_format = f.category
LEFT JOIN {_CODES.format(c="payment_currency")} c ON t.payment_currency = c.category"""
_WHOLE = [c for c in FEATURES if "count" in c or "unique" in c or "entity" in c]
_MATRIX_SQL = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _WHOLE)}) FROM ({_MATRIX_SQL})"
VIEWS["matrix"] = (("txn", "train", "sent", "got", "entity"), _MATRIX_SQL)
_ROUNDED = ["amount_paid", "amount_received", "amount_ratio", "fan_in_score", "fan_out_score"]


def rounded_features(features):
    """The feature table as SQL has it: logarithms and ratios to six digits."""
    return _rounded(features, _ROUNDED)


@query("assemble_features", _MATRIX_SQL, ("txn", "train", "sent", "got", "entity"))
def assemble_features(spark, sf_dir):
    return _rounded(FT.feature_table(T.txn(spark, sf_dir), T.listed_accounts(spark, sf_dir)), _ROUNDED)


@query(
    "feature_cache_roundtrip",
    f"SELECT * FROM ({_MATRIX_SQL}) WHERE split = 'val'",
    ("txn", "train", "sent", "got", "entity"),
)
def feature_cache_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "features")
    if not stored.has_features(spark, path, "val"):
        stored.save_features(FT.feature_table(T.txn(spark, sf_dir), T.listed_accounts(spark, sf_dir)), path)
    return _rounded(stored.load_features(spark, path, "val"), _ROUNDED)
