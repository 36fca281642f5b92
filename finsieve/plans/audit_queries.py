"""Queries on data checks and class balance arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from finsieve.functions import scalars as S
from finsieve.functions.cleaning import type_transactions
from finsieve.operators import audit as A
from finsieve.operators import sampling as SM
from finsieve.plans import tables as T
from finsieve.plans.registry import query

_COUNTS = "count(*) AS n_total, CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg"


@query(
    "dataset_summary",
    """SELECT count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_illicit, round(CAST(sum(label) AS DOUBLE) / count(*), 8) AS illicit_ratio,
       strftime(min(ts), '%Y-%m-%d %H:%M') AS first_time, strftime(max(ts), '%Y-%m-%d %H:%M') AS last_time FROM txn""",
)
def dataset_summary(spark, sf_dir):
    return A.dataset_summary(T.txn(spark, sf_dir)).withColumn("illicit_ratio", F.round("illicit_ratio", 8))


@query("class_counts", f"SELECT split, {_COUNTS}, round(CAST(sum(label) AS DOUBLE) / count(*), 8) AS prevalence FROM txn GROUP BY split")
def class_counts(spark, sf_dir):
    return SM.class_counts(T.txn(spark, sf_dir), ["split"]).withColumn("prevalence", F.round("prevalence", 8))


@query(
    "label_crosstab",
    """SELECT label_from_patterns, count(*) FILTER (WHERE label = 0) AS label_0, count(*) FILTER (WHERE label = 1) AS label_1
FROM linked GROUP BY label_from_patterns""",
    ("linked",),
)
def label_crosstab(spark, sf_dir):
    from finsieve.operators.labels import attach_patterns

    linked = attach_patterns(T.txn(spark, sf_dir), T.patterns(spark, sf_dir))
    return A.cross_tab(linked, "label_from_patterns", "label", [0, 1])


@query(
    "document_label_crosstab",
    "SELECT quality, count(*) FILTER (WHERE toxic = 0) AS toxic_0, count(*) FILTER (WHERE toxic = 1) AS toxic_1 FROM labels GROUP BY quality",
    (),
)
def document_label_crosstab(spark, sf_dir):
    return A.cross_tab(T.read(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


@query(
    "value_counts",
    """SELECT 'payment_format' AS feature, payment_format AS value, count(*) AS n FROM txn GROUP BY payment_format
UNION ALL SELECT 'payment_currency', payment_currency, count(*) FROM txn GROUP BY payment_currency""",
)
def value_counts(spark, sf_dir):
    t = T.txn(spark, sf_dir)
    parts = [A.value_counts(t, c).withColumn("feature", F.lit(c)) for c in ("payment_format", "payment_currency")]
    return parts[0].unionByName(parts[1])


@query(
    "describe_amount",
    """SELECT count(amount_paid) AS count, round(avg(amount_paid), 4) AS mean, round(stddev_samp(amount_paid), 4) AS std,
       min(amount_paid) AS min, max(amount_paid) AS max, round(quantile_cont(amount_paid, 0.25), 6) AS q25,
       round(quantile_cont(amount_paid, 0.5), 6) AS q50, round(quantile_cont(amount_paid, 0.75), 6) AS q75 FROM typed""",
    ("typed",),
)
def describe_amount(spark, sf_dir):
    d = A.describe(type_transactions(T.raw(spark, sf_dir)), "amount_paid")
    digits = {"mean": 4, "std": 4, "q25": 6, "q50": 6, "q75": 6}
    return d.withColumns({c: F.round(c, n) for c, n in digits.items()})


_NULLABLE = ["timestamp", "from_bank", "amount_received", "amount_paid", "payment_currency", "is_laundering_csv"]


@query(
    "null_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM raw" for c in _NULLABLE),
    ("raw",),
)
def null_counts(spark, sf_dir):
    return A.null_counts(T.raw(spark, sf_dir), _NULLABLE)


_DAYS = """SELECT strftime(d.day, '%Y-%m-%d') AS day, COALESCE(n, 0) AS total, COALESCE(p, 0) AS illicit,
       CASE WHEN n > 0 THEN round(CAST(p AS DOUBLE) / n, 8) END AS illicit_ratio
FROM (SELECT unnest(generate_series((SELECT min(date_trunc('day', {ts})) FROM {t}), (SELECT max(date_trunc('day', {ts})) FROM {t}), INTERVAL 1 DAY)) AS day) d
LEFT JOIN (SELECT date_trunc('day', {ts}) AS day, count(*) AS n, CAST(sum({label}) AS BIGINT) AS p FROM {t} GROUP BY 1) x ON d.day = x.day"""


def _daily(df):
    return A.daily_volume(df).withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "illicit_ratio": F.round("illicit_ratio", 8)})


@query("daily_volume", _DAYS.format(ts="ts", t="txn", label="label"))
def daily_volume(spark, sf_dir):
    return _daily(T.txn(spark, sf_dir))


@query("event_daily_volume", _DAYS.format(ts="ts", t="events", label="CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END"), ())
def event_daily_volume(spark, sf_dir):
    T.pin_utc(spark)
    events = T.read(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"), (F.col("event_type") == "purchase").cast("int").alias("label")
    )
    return _daily(events)


_PREV = "SELECT payment_format, CAST(sum(label) AS DOUBLE) / count(*) AS p, sum(label) AS pos, count(*) - sum(label) AS neg FROM train GROUP BY payment_format"


def _by_format(spark, sf_dir):
    return SM.class_counts(T.train(spark, sf_dir), ["payment_format"])


@query(
    "prevalence_ratio",
    f"SELECT payment_format, round(p / (1 - p), 10) AS ratio FROM ({_PREV})",
    ("train",),
)
def prevalence_ratio(spark, sf_dir):
    return _by_format(spark, sf_dir).select("payment_format", F.round(S.prevalence_ratio(F.col("prevalence")), 10).alias("ratio"))


@query(
    "class_weight_target",
    f"SELECT payment_format, CAST(1 AS DOUBLE) AS w0, round((1 - p) / p, 6) AS w1 FROM ({_PREV}) WHERE pos > 0",
    ("train",),
)
def class_weight_target(spark, sf_dir):
    some = _by_format(spark, sf_dir).filter("n_pos > 0")
    return some.select("payment_format", F.lit(1.0).alias("w0"), F.round(S.positive_weight(F.col("prevalence")), 6).alias("w1"))


@query(
    "class_weight_observed",
    "SELECT n_pos, n_neg, CAST(1 AS DOUBLE) AS w0, round(CAST(n_neg AS DOUBLE) / n_pos, 6) AS w1 FROM classes",
    ("classes",),
)
def class_weight_observed(spark, sf_dir):
    n_pos, n_neg = SM.count_classes(T.train(spark, sf_dir))
    w = SM.observed_weights(n_pos, n_neg)
    return spark.createDataFrame([(n_pos, n_neg, w[0], w[1])], "n_pos bigint, n_neg bigint, w0 double, w1 double").withColumn("w1", F.round("w1", 6))
