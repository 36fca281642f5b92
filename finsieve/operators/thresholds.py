"""Threshold selection on validation scores."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finsieve.functions import scalars as S
from finsieve.operators.ranking import (
    curve_of_groups,
    curve_rates,
    quantiles_of_counts,
    record_of_curve,
    score_groups,
    threshold_metrics,
)
from finsieve.session import materialize

CRITERIA = ("f1", "recall", "precision")
STRATEGIES = ("f1_max", "f2_max", "precision_constrained")
# fixed value: threshold when there is nothing to choose from
FALLBACK = 0.5
# fixed values: how a threshold was chosen, as recorded with it
CHOSEN_BY_GOAL = "argmax_{strategy}_on_validation"
CHOSEN_BY_TIER = {
    1: "max_f1_subject_to_precision_constraint_tiebreak_utility",
    2: "fallback_max_precision_with_nonzero_recall",
    3: "fallback_threshold_0_5",
}


def _goal(criterion: str):
    """Value to maximise at a curve point."""
    if criterion not in CRITERIA:
        raise ValueError(f"unknown criterion {criterion!r}, expected one of {CRITERIA}")
    rates = curve_rates()
    p, r = rates["precision"], rates["recall"]
    return {
        "f1": rates["f1"],
        "recall": F.when(p > 0, r).otherwise(F.lit(-1.0)),
        "precision": F.when(r > 0, p).otherwise(F.lit(-1.0)),
    }[criterion]


def best_threshold(df: DataFrame, keys: list[str], criterion: str = "f1", score: str = "score", label: str = "label") -> DataFrame:
    """Best threshold of each key over all distinct scores; ties go to the lowest.

    ``recall`` looks at thresholds with precision above 0 and ``precision`` at
    those with recall above 0, when there are any.
    """
    return best_of_groups(score_groups(df, keys, score, label), keys, criterion, score)


def best_of_groups(groups: DataFrame, keys: list[str], criterion: str = "f1", score: str = "score") -> DataFrame:
    """:func:`best_threshold` on grouped scores."""
    curve = curve_of_groups(groups, keys, score).withColumns(curve_rates())
    rank = F.struct(_goal(criterion).alias("v"), (-F.col(score)).alias("s"))
    point = F.struct(F.col(score).cast("double").alias("t"), "precision", "recall", "f1")
    return (
        curve.groupBy(*keys)
        .agg(F.max_by(point, rank).alias("_b"))
        .select(
            *keys,
            F.coalesce(F.col("_b.t"), F.lit(FALLBACK)).alias("threshold"),
            "_b.precision", "_b.recall", "_b.f1",
        )
    )


def threshold_grid(df: DataFrame, n_dense: int = 1000, score: str = "score") -> DataFrame:
    """Candidate thresholds: all distinct scores, or ``n_dense`` even quantiles if there are more."""
    groups = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"))
    return grid_of_groups(materialize(groups, "grid-scores"), n_dense, score)


def grid_of_groups(groups: DataFrame, n_dense: int = 1000, score: str = "score") -> DataFrame:
    """:func:`threshold_grid` on grouped scores."""
    values = groups.select(F.col(score).alias("v"), "n")
    if values.count() <= n_dense:
        return values.select(F.col("v").cast("double").alias("threshold"))
    return quantiles_of_counts(values, n_dense - 1).select(F.col("quantile").alias("threshold")).distinct()


def confusion_on_grid(df: DataFrame, grid: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Confusion counts at every grid threshold."""
    return confusion_of_groups(score_groups(df, [], score, label), grid, score)


def confusion_of_groups(groups: DataFrame, grid: DataFrame, score: str = "score") -> DataFrame:
    """:func:`confusion_on_grid` on grouped scores.

    Each distinct score adds to the thresholds at or below it, so scores are
    binned by the grid and summed from the top. The grid holds at most
    ``n_dense`` values and is read to the driver for the binning.
    """
    values = sorted(r["threshold"] for r in grid.collect())
    if not values:
        return groups.sparkSession.createDataFrame([], "threshold double, tp bigint, fp bigint, tn bigint, fn bigint")
    binned = (
        Bucketizer(splits=[float("-inf"), *values, float("inf")], inputCol="_s", outputCol="_k")
        .transform(groups.withColumn("_s", F.col(score).cast("double")))
        .groupBy(F.col("_k").cast("int").alias("k"))
        .agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    )
    table = groups.sparkSession.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "k int, threshold double")
    above = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    # one row per grid value
    summed = binned.join(table, "k", "full_outer").withColumns(
        {
            "_n": F.sum(F.coalesce("n", F.lit(0))).over(above),
            "tp": F.sum(F.coalesce("p", F.lit(0))).over(above),
            "_all_n": F.sum("n").over(everything),
            "_all_p": F.sum("p").over(everything),
        }
    )
    return summed.filter("threshold IS NOT NULL").select(
        "threshold",
        "tp",
        (F.col("_n") - F.col("tp")).alias("fp"),
        (F.col("_all_n") - F.col("_all_p") - F.col("_n") + F.col("tp")).alias("tn"),
        (F.col("_all_p") - F.col("tp")).alias("fn"),
    )


def curve_points(groups: DataFrame, score: str = "score") -> DataFrame:
    """Confusion counts at every distinct score, from grouped scores."""
    curve = curve_of_groups(groups, [], score)
    return curve.select(
        F.col(score).cast("double").alias("threshold"),
        F.col("cum_p").alias("tp"),
        (F.col("cum_n") - F.col("cum_p")).alias("fp"),
        (F.col("tot_n") - F.col("tot_p") - F.col("cum_n") + F.col("cum_p")).alias("tn"),
        (F.col("tot_p") - F.col("cum_p")).alias("fn"),
    )


def _at_fallback(points: DataFrame) -> DataFrame:
    """One row: the counts at the fallback threshold, zeros where there are no points at all."""
    counts = ("tp", "fp", "tn", "fn")
    # the lowest point from the fallback on predicts the same rows as the fallback
    reached = F.col("threshold") >= FALLBACK
    one = points.agg(
        F.min_by(F.when(reached, F.struct(*counts)), F.when(reached, F.col("threshold"))).alias("at"),
        F.coalesce(F.max(F.col("tp") + F.col("fn")), F.lit(0)).alias("pos"),
        F.coalesce(F.max(F.col("fp") + F.col("tn")), F.lit(0)).alias("neg"),
    )
    nothing = {"tp": F.lit(0), "fp": F.lit(0), "tn": F.col("neg"), "fn": F.col("pos")}
    return one.select(F.lit(FALLBACK).alias("threshold"), *[F.coalesce(F.col(f"at.{c}"), nothing[c]).cast("bigint").alias(c) for c in counts])


def select_threshold(
    points: DataFrame, strategy: str, min_precision: float = 0.10, lambda_fp: float = 0.05
) -> DataFrame:
    """One row: the chosen threshold with its validation counts and metrics.

    ``precision_constrained`` takes the best F1 among thresholds that keep the
    precision; failing that the best precision with any recall; failing that 0.5
    with the counts there. Without any point every strategy gives 0.5.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, expected one of {STRATEGIES}")
    counts = ["threshold", "tp", "fp", "tn", "fn"]
    # the last resort is one more candidate, behind all others
    candidates = points.select(*counts, F.lit(False).alias("_last")).unionByName(_at_fallback(points).withColumn("_last", F.lit(True)))
    scored = candidates.withColumns(threshold_metrics()).withColumn("utility", F.col("tp") - F.lit(lambda_fp) * F.col("fp"))
    if strategy in ("f1_max", "f2_max"):
        goal = F.col(strategy[:2])
        ranked = scored.withColumns(
            {
                "tier": F.when(F.col("_last"), 3).otherwise(1),
                "_goal": goal,
                "_tie": F.lit(0.0),
                "selection": F.when(F.col("_last"), F.lit(CHOSEN_BY_TIER[3])).otherwise(F.lit(CHOSEN_BY_GOAL.format(strategy=strategy))),
            }
        )
    else:
        # without positives every recall is 1, yet nothing is found
        ok = ~F.col("_last") & (F.col("precision") >= min_precision)
        some = ~F.col("_last") & (F.col("recall") > 0)
        ranked = scored.withColumns(
            {
                "tier": F.when(ok, 1).when(some, 2).when(F.col("_last"), 3).otherwise(4),
                "_goal": F.when(ok, F.col("f1")).when(some, F.col("precision")).otherwise(F.lit(0.0)),
                "_tie": F.col("utility"),
                "selection": F.when(ok, F.lit(CHOSEN_BY_TIER[1]))
                .when(some, F.lit(CHOSEN_BY_TIER[2]))
                .otherwise(F.lit(CHOSEN_BY_TIER[3])),
            }
        )
    first = ranked.orderBy("tier", F.col("_goal").desc(), F.col("_tie").desc(), "threshold").limit(1)
    return first.select(
        F.lit(strategy).alias("strategy"), "selection", "threshold",
        "tp", "fp", "tn", "fn", "precision", "recall", "f1", "f2", "utility",
    )


def operating_points(
    val: DataFrame,
    test: DataFrame,
    strategies: tuple[str, ...] = STRATEGIES,
    min_precision: float = 0.10,
    lambda_fp: float = 0.05,
) -> DataFrame:
    """Several thresholds chosen on ``val``, applied to ``test`` once, against the F1 optimum.

    All points share one score set; the ranking metric must not differ between them.
    """
    val_groups = materialize(score_groups(val, []), "val-scores")
    test_groups = materialize(score_groups(test, []), "test-scores")
    points = materialize(curve_points(val_groups), "points")
    chosen = None
    for s in strategies:
        one = select_threshold(points, s, min_precision, lambda_fp).select("strategy", "selection", "threshold")
        chosen = one if chosen is None else chosen.unionByName(one)
    reference = best_of_groups(val_groups, []).select(
        F.lit("reference").alias("strategy"), F.lit("f1").alias("selection"), "threshold"
    )
    # a handful of rows: the points to evaluate
    rows = chosen.unionByName(reference).collect()
    # one curve of the test scores, read at every point
    tau = F.array(*[F.struct(F.lit(r["strategy"]).alias("strategy"), F.lit(r["selection"]).alias("selection"), F.lit(r["threshold"]).alias("tau")) for r in rows])
    curve = curve_of_groups(test_groups, [])
    spread = curve.select(*curve.columns, F.inline(tau))
    by = ["strategy", "selection", "tau"]
    measured = materialize(record_of_curve(spread, by, F.col("tau")), "measured")
    ref = measured.filter("strategy = 'reference'").select(
        *[F.col(c).alias(f"ref_{c}") for c in ("precision", "recall", "f1", "f2", "fp", "pr_auc")]
    )
    out = measured.filter("strategy <> 'reference'").join(F.broadcast(ref))
    deltas = {f"delta_{c}": F.col(c) - F.col(f"ref_{c}") for c in ("precision", "recall", "f1", "f2", "fp")}
    return out.withColumns(deltas | {"pr_auc_same": F.abs(F.col("pr_auc") - F.col("ref_pr_auc")) <= 1e-9})


def reevaluate_groups(groups: DataFrame, criterion: str = "f1", keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """:func:`reevaluate` on scores that are grouped by key, split and score already."""
    k = list(keys)
    curve = curve_of_groups(groups.filter("split IN ('val', 'test')"), [*k, "split"])
    rank = F.struct(_goal(criterion).alias("v"), (-F.col("score")).alias("s"))
    on_val = F.col("split") == "val"
    # one row per key, stored so that the join below is planned by its true size
    best = curve.groupBy(*k).agg(
        F.coalesce(F.max_by(F.when(on_val, F.col("score").cast("double")), F.when(on_val, rank)), F.lit(FALLBACK)).alias("tau")
    )
    best = materialize(best, "thresholds")
    return record_of_curve(curve.join(best, k), [*k, "split"], F.col("tau")).withColumn("criterion", F.lit(criterion))


def reevaluate(scored: DataFrame, criterion: str = "f1", keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Threshold of every run from its validation rows, metrics of both splits at it.

    One job for all runs, reading the scores once. They carry ``split`` with
    values ``val`` and ``test``.
    """
    groups = materialize(score_groups(scored, [*keys, "split"]), "score-groups")
    return reevaluate_groups(groups, criterion, keys)
