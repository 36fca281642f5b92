"""Scalar expressions for features, weights, metrics and run names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def hour_of(ts: Column) -> Column:
    return F.hour(ts).cast("double")


def weekday_of(ts: Column) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(ts).cast("double")


def same_bank() -> Column:
    return _flag(F.col("from_bank").eqNullSafe(F.col("to_bank")))


def self_transfer() -> Column:
    return _flag(F.col("from_account").eqNullSafe(F.col("to_account")))


def currency_mismatch() -> Column:
    return _flag(~F.col("payment_currency").eqNullSafe(F.col("receiving_currency")))


def cross_bank() -> Column:
    return (~F.col("from_bank").eqNullSafe(F.col("to_bank"))).cast("int")


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def amount_ratio(received: Column, paid: Column) -> Column:
    """Received over paid in [0, 10]; 1 when nothing was paid."""
    return clip(F.when(paid > 0, received / paid).otherwise(F.lit(1.0)), 0.0, 10.0)


def bounded_share(part: Column, whole: Column) -> Column:
    """``part / whole`` in [0, 100], 0 when ``whole`` is 0."""
    # fixed value: keeps the ratio finite
    eps = 1e-6
    return clip(F.when(whole > 0, part / (whole + F.lit(eps))).otherwise(F.lit(0.0)), 0.0, 100.0)


def entity_class(name: Column) -> Column:
    """0 corporation, 1 partnership, 2 anything else; case matters."""
    n = F.coalesce(F.trim(name), F.lit(""))
    return F.when(n.contains("Corporation"), 0).when(n.contains("Partnership"), 1).otherwise(2)


def prevalence_ratio(p: Column) -> Column:
    """Positives per negative at prevalence ``p``."""
    return p / (F.lit(1.0) - p)


def positive_weight(p: Column) -> Column:
    """Weight of a positive that makes the classes count as at prevalence ``p``."""
    return (F.lit(1.0) - p) / p


def fbeta(precision: Column, recall: Column, beta: float) -> Column:
    b2 = float(beta) ** 2
    bottom = F.lit(b2) * precision + recall
    return F.when(bottom > 0, F.lit(1.0 + b2) * precision * recall / bottom).otherwise(F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 when ``whole`` is 0."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def fp_per_tp(fp: Column, tp: Column) -> Column:
    """False alarms per hit, null without a hit."""
    return F.when(tp > 0, fp.cast("double") / tp)


def prevalence_tag(p: Column) -> Column:
    """Per-mille tag such as ``p010``."""
    return F.format_string("p%03d", F.round(p * 1000).cast("int"))


def run_id(model: Column, strategy: Column, p: Column, stamp: Column | None = None) -> Column:
    parts = [model, strategy, prevalence_tag(p)] + ([stamp] if stamp is not None else [])
    return F.concat_ws("__", *parts)


def run_id_part(run: Column, position: int) -> Column:
    """0 model, 1 strategy, 2 prevalence tag, 3 time stamp."""
    return F.get(F.split(run, "__"), F.lit(position))


def predicted(score: Column, threshold: Column | float) -> Column:
    """1 at or above the threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (score >= t).cast("int")
