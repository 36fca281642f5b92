"""Exact ranking curve and the metrics read off it.

Scores are grouped first; everything else works on one row per (key, score).
Keys name independent score sets, such as run and split, so one job evaluates
all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.functions import scalars as S
from finsieve.operators.ordering import prefix_sums
from finsieve.session import materialize


def score_groups(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Rows and positives of each distinct score."""
    return df.groupBy(*keys, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("p")
    )


def curve_of_groups(groups: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Predicted positives ``cum_n`` and hits ``cum_p`` at each distinct score, with the totals of the key."""
    return prefix_sums(groups, keys, score, ["n", "p"], descending=True)


def curve_rates() -> dict[str, Column]:
    """Precision, recall and F1 of a curve point."""
    return {
        "precision": S.share(F.col("cum_p"), F.col("cum_n")),
        # without positives every threshold counts as full recall
        "recall": F.when(F.col("tot_p") > 0, F.col("cum_p").cast("double") / F.col("tot_p")).otherwise(F.lit(1.0)),
        "f1": S.share(2 * F.col("cum_p"), F.col("cum_n") + F.col("tot_p")),
    }


def pr_curve(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Precision and recall at every distinct score."""
    return curve_of_groups(score_groups(df, keys, score, label), keys, score).withColumns(curve_rates())


#: Parts that the fraction of a number is counted in when it is summed exactly.
FRACTIONS = 1 << 53


def exact_sums(value: Column, name: str) -> list[Column]:
    """Aggregates ``name_whole`` and ``name_parts`` of numbers of 0 or more; see :func:`exact_total`.

    Whole numbers and fractions in units of 2^-53 are summed as integers, so the
    result has the same bits in whatever order the rows come.
    """
    whole = F.floor(value)
    parts = F.floor((value - whole) * F.lit(float(FRACTIONS)))
    return [F.sum(whole.cast("decimal(18,0)")).alias(f"{name}_whole"), F.sum(parts.cast("decimal(16,0)")).alias(f"{name}_parts")]


def exact_total(name: str) -> Column:
    """The sum as a double, rounded once."""
    whole, parts = F.col(f"{name}_whole"), F.col(f"{name}_parts")
    unit = F.lit(FRACTIONS).cast("decimal(16,0)")
    carried = whole + F.call_function("div", parts, unit)
    return carried.cast("double") + (parts % unit).cast("double") / F.lit(float(FRACTIONS))


def _curve_sums() -> list[Column]:
    neg = F.col("n") - F.col("p")
    return [
        F.sum("n").alias("n_rows"),
        F.sum("p").alias("n_pos"),
        # each group's positives at the precision reached with it
        *exact_sums(F.col("p") * (F.col("cum_p") / F.col("cum_n")), "_ap"),
        # pairs won by a positive, ties as half; doubled to stay whole
        F.sum((neg * (2 * F.col("cum_p") - F.col("p"))).cast("decimal(38,0)")).alias("_pairs2"),
    ]


def _ap() -> Column:
    return F.when(F.col("n_pos") > 0, exact_total("_ap") / F.col("n_pos")).otherwise(F.lit(0.0))


def _auc() -> Column:
    n_neg = F.col("n_rows") - F.col("n_pos")
    pairs = F.col("n_pos").cast("double") * n_neg
    return F.when(pairs > 0, F.col("_pairs2").cast("double") / 2 / pairs)


def ranking_quality(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Average precision over distinct scores, and ROC area with ties at one half.

    Average precision is 0 without positives; the ROC area is null when a class is missing.
    """
    curve = curve_of_groups(score_groups(df, keys, score, label), keys, score)
    agg = curve.groupBy(*keys).agg(*_curve_sums())
    return agg.select(*keys, "n_rows", "n_pos", _ap().alias("pr_auc"), _auc().alias("roc_auc"))


def confusion(df: DataFrame, keys: list[str], threshold: Column | float, score: str = "score", label: str = "label") -> DataFrame:
    """Counts of hits, false alarms, true negatives and misses at a threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    said, true = F.col(score) >= t, F.col(label) == 1
    return df.groupBy(*keys).agg(
        F.count_if(said & true).alias("tp"),
        F.count_if(said & ~true).alias("fp"),
        F.count_if(~said & ~true).alias("tn"),
        F.count_if(~said & true).alias("fn"),
    )


def threshold_metrics() -> dict[str, Column]:
    """Precision, recall, F1, F2 and weighted accuracy from ``tp, fp, tn, fn``.

    Weighted accuracy gives both classes the same total weight; without
    positives it is plain accuracy.
    """
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = S.share(tp, tp + fp), S.share(tp, tp + fn)
    # counts give F-beta directly, free of rounding in precision and recall
    f1 = S.share(2 * tp, 2 * tp + fp + fn)
    f2 = S.share(5 * tp, 5 * tp + 4 * fn + fp)
    balanced = F.when((tn + fp) > 0, (recall + S.share(tn, tn + fp)) / 2).otherwise(F.lit(0.0))
    plain = S.share(tn, tn + fp)
    return {
        "precision": precision,
        "recall": recall,
        "f1": f1,
        "f2": f2,
        "weighted_accuracy": F.when(tp + fn > 0, balanced).otherwise(plain),
    }


# fixed values: order of a metric record
METRICS = ["pr_auc", "roc_auc", "precision", "recall", "f1", "f2", "weighted_accuracy", "tp", "fp", "tn", "fn", "threshold"]


def record_of_curve(curve: DataFrame, keys: list[str], threshold: Column, score: str = "score") -> DataFrame:
    """Metric record of each key of a curve; ``threshold`` is constant per key."""
    said = F.col(score) >= threshold
    agg = curve.groupBy(*keys).agg(
        *_curve_sums(),
        F.max(threshold).cast("double").alias("threshold"),
        F.coalesce(F.sum(F.when(said, F.col("p"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(said, F.col("n") - F.col("p"))), F.lit(0)).alias("fp"),
    )
    full = agg.withColumns(
        {
            "fn": F.col("n_pos") - F.col("tp"),
            "tn": F.col("n_rows") - F.col("n_pos") - F.col("fp"),
            "pr_auc": _ap(),
            "roc_auc": _auc(),
        }
    ).withColumns(threshold_metrics())
    return full.select(*keys, *METRICS)


def metric_record(
    df: DataFrame, keys: list[str], threshold: str | float = 0.5, score: str = "score", label: str = "label"
) -> DataFrame:
    """The twelve metrics of each score set in one pass over the grouped scores.

    ``threshold`` is a number or the name of a column that is constant per key.
    """
    if isinstance(threshold, str):
        by, t = [*keys, threshold], F.col(threshold)
    else:
        by, t = keys, F.lit(float(threshold))
    curve = curve_of_groups(score_groups(df, by, score, label), by, score)
    return record_of_curve(curve, keys, t, score)


def score_stats(df: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.avg(score).alias("mean_score")
    )


def quantiles_of_counts(values: DataFrame, parts: int) -> DataFrame:
    """:func:`even_quantiles` of values that are counted already: columns ``v`` and ``n``."""
    n = values.agg(F.sum("n")).first()[0]
    if not n:
        return values.sparkSession.createDataFrame([], "j bigint, quantile double")
    last, d = n - 1, parts
    # the rows a value stands for: a up to b - 1
    ranked = prefix_sums(values, [], "v", ["n"]).select(
        F.col("v").cast("double").alias("v"), (F.col("cum_n") - F.col("n")).alias("a"), F.col("cum_n").alias("b")
    )
    if last == 0:
        bounds = {"low": ("CAST(0 AS bigint)", f"CAST({d} AS bigint)"), "high": ("CAST(0 AS bigint)", f"CAST({d} AS bigint)")}
    else:
        # rank j * last / d, rounded down or up, falls on a value for these j
        bounds = {
            "low": (f"(a * {d} + {last} - 1) div {last}", f"(b * {d} + {last} - 1) div {last} - 1"),
            "high": (f"CASE WHEN a = 0 THEN CAST(0 AS bigint) ELSE ((a - 1) * {d}) div {last} + 1 END", f"((b - 1) * {d}) div {last}"),
        }
    sides = F.array(
        *[
            F.struct(F.lit(side).alias("side"), F.expr(start).alias("s"), F.least(F.expr(stop), F.lit(d).cast("bigint")).alias("e"))
            for side, (start, stop) in bounds.items()
        ]
    )
    # at most parts + 1 rows on each side
    picked = ranked.select("v", F.inline(sides)).filter("s <= e").select("side", F.explode(F.sequence("s", "e")).alias("j"), "v")
    ends = picked.groupBy("j").agg(*[F.max(F.when(F.col("side") == x, F.col("v"))).alias(x) for x in bounds])
    part = (F.col("j") * last % d) / F.lit(float(d))
    return ends.select("j", (F.col("low") + (F.col("high") - F.col("low")) * part).alias("quantile"))


def even_quantiles(df: DataFrame, value: str, parts: int) -> DataFrame:
    """Exact linear-interpolated quantiles ``j / parts`` for j = 0..parts as ``(j, quantile)``.

    Distinct values are counted and running counts locate the two neighbours of
    each rank; no value list is collected anywhere.
    """
    values = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return quantiles_of_counts(materialize(values, "value-counts"), parts)
