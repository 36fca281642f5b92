"""Experiment grid, leaderboard and comparison tables over run records.

Run tables hold one row per experiment, so plain sorts and windows are fine here.
Only the Pareto front also takes tables of any size, such as all thresholds of all runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finsieve.functions import scalars as S
from finsieve.operators.joins import lookup
from finsieve.operators.ordering import running_best
from finsieve.schema import require_columns
from finsieve.session import materialize

# fixed values: the published grid
GRID_MODELS = ("random_forest", "xgboost")
GRID_STRATEGIES = ("baseline", "random_undersampling", "smote", "adasyn", "class_weighting")
GRID_PREVALENCES = (0.010, 0.005, 0.001)

# fixed values: row order of the result tables
MODEL_ORDER = ("xgboost", "random_forest")
STRATEGY_ORDER = ("baseline", "random_undersampling", "smote", "class_weighting")

# fixed values: columns of a leaderboard row
CONFIG_COLUMNS = [
    "run_id", "model", "strategy", "target_prevalence", "achieved_train_prevalence",
    "train_rows_after_sampling", "train_positives_after_sampling", "n_synthetic_samples",
    "val_rows", "val_positives", "test_rows", "test_positives", "train_time_sec", "created_at",
]
DEFAULT_METRICS = ["pr_auc", "roc_auc", "precision", "recall", "f1", "f2", "weighted_accuracy", "tp", "fp", "tn", "fn"]
THRESHOLD_METRICS = DEFAULT_METRICS[2:]


def experiment_grid(
    spark: SparkSession, models=GRID_MODELS, strategies=GRID_STRATEGIES, prevalences=GRID_PREVALENCES
) -> DataFrame:
    """Every (strategy, model, prevalence) cell in run order, with its run name."""
    cells = [(s, m, float(p)) for s in strategies for m in models for p in prevalences]
    grid = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cells)], "run_no int, strategy string, model string, target_prevalence double"
    )
    return grid.withColumns(
        {
            "tag": S.prevalence_tag(F.col("target_prevalence")),
            "run_id": S.run_id(F.col("model"), F.col("strategy"), F.col("target_prevalence")),
        }
    )


def completed_cells(run_ids: DataFrame) -> DataFrame:
    """Cells that run names stand for."""
    r = F.col("run_id")
    return run_ids.select(
        S.run_id_part(r, 0).alias("model"), S.run_id_part(r, 1).alias("strategy"), S.run_id_part(r, 2).alias("tag")
    ).distinct()


def pending_cells(grid: DataFrame, run_ids: DataFrame) -> DataFrame:
    """Grid cells without a completed run."""
    return grid.join(completed_cells(run_ids), ["model", "strategy", "tag"], "left_anti")


def status_summary(statuses: DataFrame) -> DataFrame:
    """Runs per status."""
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n_runs"))


def leaderboard(configs: DataFrame, metrics: dict[str, DataFrame], thresholds: DataFrame | None) -> DataFrame:
    """One wide row per run.

    ``metrics`` maps ``val``, ``test``, ``val_thresh``, ``test_thresh`` to metric
    records by run; runs without a record get nulls. ``thresholds`` holds
    ``run_id, optimal_threshold, threshold_criterion``.
    """
    board = configs.filter(F.col("strategy").isNotNull() & F.col("target_prevalence").isNotNull())
    board = board.select(*[c for c in CONFIG_COLUMNS if c in board.columns])
    for tag, names in (
        ("val", DEFAULT_METRICS), ("test", DEFAULT_METRICS),
        ("val_thresh", THRESHOLD_METRICS), ("test_thresh", THRESHOLD_METRICS),
    ):
        if tag in metrics:
            present = set(metrics[tag].columns)
            side = metrics[tag].select(
                "run_id",
                *[(F.col(m) if m in present else F.lit(None).cast("double")).alias(f"{m}_{tag}") for m in names],
            )
            board = board.join(side, "run_id", "left")
        else:
            board = board.withColumns({f"{m}_{tag}": F.lit(None).cast("double") for m in names})
    if thresholds is not None:
        return board.join(thresholds, "run_id", "left")
    return board.withColumns({"optimal_threshold": F.lit(None).cast("double"), "threshold_criterion": F.lit(None).cast("string")})


def ranked(board: DataFrame) -> DataFrame:
    """Best ranking quality first, then recall: at the chosen threshold when any run has one."""
    everything = Window.partitionBy()
    any_thresh = F.max(F.col("recall_test_thresh").isNotNull()).over(everything)
    recall = F.when(any_thresh, F.col("recall_test_thresh")).otherwise(F.col("recall_test"))
    order = Window.orderBy(F.col("pr_auc_test").desc_nulls_last(), F.col("_recall").desc_nulls_last(), "run_id")
    return board.withColumn("_recall", recall).withColumn("rank", F.row_number().over(order)).drop("_recall")


def top_runs(board: DataFrame, n: int = 10) -> DataFrame:
    return ranked(board).filter(F.col("rank") <= n)


def _position(column: str, order: tuple[str, ...]):
    place = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        place = F.when(F.col(column) == name, F.lit(i)).otherwise(place)
    return place


def filter_runs(
    board: DataFrame, model: str | None = None, strategy: str | None = None, prevalence: float | None = None,
    drop_strategy: str | None = None, tolerance: float = 1e-9,
) -> DataFrame:
    """Runs by model, strategy and prevalence; smoke runs are left out when marked."""
    if "is_smoke" in board.columns:
        board = board.filter(~F.coalesce("is_smoke", F.lit(False)))
    if model is not None:
        board = board.filter(F.col("model") == model)
    if strategy is not None:
        board = board.filter(F.col("strategy") == strategy)
    if drop_strategy is not None:
        board = board.filter(F.col("strategy") != drop_strategy)
    if prevalence is not None:
        board = board.filter(F.abs(F.col("target_prevalence") - F.lit(float(prevalence))) < tolerance)
    return board


def main_results(board: DataFrame, drop_strategy: str | None = "adasyn") -> DataFrame:
    """Comparison of all runs at the chosen threshold, in table order."""
    require_columns(board, ["model", "strategy", "target_prevalence", "pr_auc_test", "tp_test_thresh", "fp_test_thresh"])
    order = Window.orderBy(_position("model", MODEL_ORDER), "strategy", "target_prevalence")
    return filter_runs(board, drop_strategy=drop_strategy).select(
        F.row_number().over(order).alias("line"),
        "run_id", "model", "strategy", "target_prevalence", "pr_auc_test",
        F.col("precision_test_thresh").alias("precision_thresh"),
        F.col("recall_test_thresh").alias("recall_thresh"),
        F.col("f1_test_thresh").alias("f1_thresh"),
        S.fp_per_tp(F.col("fp_test_thresh"), F.col("tp_test_thresh")).alias("fp_per_tp"),
    )


def appendix_results(board: DataFrame, drop_strategy: str | None = "adasyn") -> DataFrame:
    """The same runs with the metrics at 0.5 and at the chosen threshold side by side."""
    order = Window.orderBy(_position("model", MODEL_ORDER), "strategy", "target_prevalence")
    both = ["precision", "recall", "f1", "weighted_accuracy", "tp", "fp"]
    return filter_runs(board, drop_strategy=drop_strategy).select(
        F.row_number().over(order).alias("line"),
        "model", "strategy", "target_prevalence", "pr_auc_test",
        *[F.col(f"{m}_test").alias(f"{m}_default") for m in both],
        *[F.col(f"{m}_test_thresh").alias(f"{m}_thresh") for m in both],
    )


def per_model_table(board: DataFrame, drop_strategy: str | None = "adasyn") -> DataFrame:
    """Per model: one row for the prevalence-invariant baseline, all rows of the other strategies, with F2."""
    kept = filter_runs(board, drop_strategy=drop_strategy)
    first = Window.partitionBy("model").orderBy("target_prevalence", "run_id")
    base = kept.filter("strategy = 'baseline'").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    rows = base.unionByName(kept.filter("strategy <> 'baseline'"))
    order = Window.partitionBy("model").orderBy(_position("strategy", STRATEGY_ORDER), "target_prevalence", "run_id")
    p, r = F.col("precision_test_thresh"), F.col("recall_test_thresh")
    return rows.select(
        "model",
        F.row_number().over(order).alias("line"),
        "strategy", "target_prevalence", "pr_auc_test", "roc_auc_test",
        p.alias("precision"), r.alias("recall"), F.col("f1_test_thresh").alias("f1"),
        F.when(p.isNotNull() & r.isNotNull(), S.fbeta(p, r, 2.0)).alias("f2"),
        F.col("weighted_accuracy_test_thresh").alias("weighted_accuracy"),
        F.col("tp_test_thresh").alias("tp"), F.col("fp_test_thresh").alias("fp"),
        S.fp_per_tp(F.col("fp_test_thresh"), F.col("tp_test_thresh")).alias("fp_per_tp"),
        "optimal_threshold",
    )


def metric_comparison(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two single-row metric records, metric by metric, with the difference."""
    names = ["pr_auc", "precision", "recall", "f1", "tp", "fp", "fp_per_tp"]
    long = lambda df, out: df.withColumn("fp_per_tp", S.fp_per_tp(F.col("fp"), F.col("tp"))).select(
        *[F.col(n).cast("double").alias(n) for n in names]
    ).unpivot([], names, "metric", out)
    both = long(left, "reference").join(long(right, "candidate"), "metric")
    return both.withColumn("delta", F.when(F.col("metric") == "pr_auc", F.lit(0.0)).otherwise(F.col("candidate") - F.col("reference")))


def mark_operating_points(points: DataFrame) -> DataFrame:
    """Flag the first point with the fewest false alarms, the best recall and the best F1.

    ``points`` carries ``position``, its place in the table.
    """
    def first_best(value, descending):
        v = F.col(value).desc() if descending else F.col(value)
        return F.row_number().over(Window.orderBy(v, "position")) == 1

    return points.withColumns(
        {"min_fp": first_best("fp", False), "max_recall": first_best("recall", True), "max_f1": first_best("f1", True)}
    )


def pareto_front(rows: DataFrame) -> DataFrame:
    """Add ``is_pareto``: no other row is at least as good on recall, precision and
    false alarms per hit and better on one.

    A missing ratio counts as infinite; a row without recall or precision is on the
    front and beats none. Every row is held against the two best rows of those with
    its recall or more, the one of highest precision and the one of fewest false
    alarms: it is on the front if it equals one and off if one beats it. Where the
    ratio follows from the precision these are the same row and decide for all.
    Rows they leave open are compared with those that may still be on the front.
    """
    cost = F.coalesce(F.nanvl(F.col("fp_per_tp").cast("double"), F.lit(float("inf"))), F.lit(float("inf")))
    p, c, r = F.col("precision").alias("p"), (-cost).alias("c"), F.col("recall").alias("r")
    known = rows.filter("recall IS NOT NULL AND precision IS NOT NULL")
    at = known.groupBy(F.col("recall").alias("_recall")).agg(F.max(F.struct(p, c, r)).alias("sharp"), F.max(F.struct(c, p, r)).alias("calm"))
    best = materialize(running_best(at, "_recall", ["sharp", "calm"]).select("_recall", "top_sharp", "top_calm"), "best-rows")

    def beats(q, own=(F.col("precision"), -cost, F.col("recall"))):
        reached = [q[n] >= x for n, x in zip("pcr", own, strict=True)]
        higher = [q[n] > x for n, x in zip("pcr", own, strict=True)]
        return F.coalesce(reached[0] & reached[1] & reached[2] & (higher[0] | higher[1] | higher[2]), F.lit(False))

    def equals(q):
        return F.coalesce((q["p"] == F.col("precision")) & (q["c"] == -cost) & (q["r"] == F.col("recall")), F.lit(False))

    sharp, calm = F.col("top_sharp"), F.col("top_calm")
    off = F.when(equals(sharp) | equals(calm) | sharp.isNull(), False).when(beats(sharp) | beats(calm), True)
    judged = materialize(lookup(rows, best, "recall", "_recall").withColumn("_off", off).drop("top_sharp", "top_calm"), "judged-rows")
    goals = F.struct(p, c, r)
    left = judged.filter("_off IS NULL").select(goals.alias("_g")).distinct()
    if left.isEmpty():
        return judged.withColumn("is_pareto", ~F.col("_off")).drop("_off")
    rivals = judged.filter("_off IS NULL OR (NOT _off AND recall IS NOT NULL AND precision IS NOT NULL)").select(goals.alias("_q")).distinct()
    g = F.col("_g")
    beaten = materialize(left.join(rivals, beats(F.col("_q"), (g["p"], g["c"], g["r"])), "left_semi"), "beaten-rows")
    found = judged.withColumn("_mine", goals).join(beaten.withColumn("_beaten", F.lit(True)), F.col("_mine") == F.col("_g"), "left")
    return found.withColumn("is_pareto", ~F.coalesce("_off", "_beaten", F.lit(False))).drop("_off", "_mine", "_g", "_beaten")


def baseline_invariance(board: DataFrame) -> DataFrame:
    """Per model: whether the baseline runs agree on the ranking metric at all prevalences."""
    return (
        board.filter("strategy = 'baseline'")
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("n_runs"), F.count_distinct("pr_auc_test").alias("n_values"))
        .withColumn("identical", F.col("n_values") == 1)
    )


def _compared(df: DataFrame, group: str, label) -> DataFrame:
    return df.select(
        F.lit(group).alias("grp"),
        label.alias("configuration"),
        "position", "target_prevalence",
        F.col("pr_auc_test").alias("pr_auc"),
        F.col("optimal_threshold").alias("threshold"),
        F.col("precision_test_thresh").alias("precision"),
        F.col("recall_test_thresh").alias("recall"),
        F.col("f1_test_thresh").alias("f1"),
        F.col("tp_test_thresh").alias("tp"),
        F.col("fp_test_thresh").alias("fp"),
        S.fp_per_tp(F.col("fp_test_thresh"), F.col("tp_test_thresh")).alias("fp_per_tp"),
    )


def anchor_runs(board: DataFrame, model: str = "xgboost") -> DataFrame:
    """The six reference rows of one model, in fixed order.

    Baseline with the best ranking quality (lowest prevalence on ties),
    undersampling at 0.5 %, class weighting at 1 %, ADASYN and SMOTE with the best
    ranking quality, SMOTE with the best F1.
    """
    m = filter_runs(board, model=model)
    best = lambda goal: [F.col(goal).desc_nulls_last(), F.col("run_no")]
    picks = [
        (1, "best_pr_auc", m.filter("strategy = 'baseline'"), [F.col("pr_auc_test").desc_nulls_last(), F.col("target_prevalence")]),
        (2, "f1_opt", m.filter("strategy = 'random_undersampling' AND round(target_prevalence, 6) = 0.005"), [F.col("run_no")]),
        (3, "f1_opt", m.filter("strategy = 'class_weighting' AND round(target_prevalence, 6) = 0.01"), [F.col("run_no")]),
        (4, "best_pr_auc", m.filter("strategy = 'adasyn'"), best("pr_auc_test")),
        (5, "best_pr_auc", m.filter("strategy = 'smote'"), best("pr_auc_test")),
        (6, "best_f1", m.filter("strategy = 'smote'"), best("f1_test_thresh")),
    ]
    out = None
    for position, why, rows, order in picks:
        one = rows.orderBy(*order).limit(1).withColumns({"position": F.lit(position), "_why": F.lit(why)})
        out = one if out is None else out.unionByName(one)
    label = F.concat_ws(" ", "model", "strategy", F.concat(F.lit("@"), S.prevalence_tag(F.col("target_prevalence"))), F.col("_why"))
    return _compared(out, "grid", label)


def three_pool_rows(pool_board: DataFrame, wanted: tuple[float, ...] = (0.001, 0.005, 0.010)) -> DataFrame:
    """Rows of the three-pool runs in order of prevalence; fails if one is missing."""
    have = {round(r[0], 6) for r in pool_board.select("target_prevalence").distinct().collect()}
    missing = [p for p in wanted if round(p, 6) not in have]
    if missing:
        raise ValueError(f"no run at prevalence {missing}")
    rows = pool_board.filter(F.round("target_prevalence", 6).isin(*[round(p, 6) for p in wanted]))
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy("target_prevalence")) + 6)
    return _compared(rows, "three_pool", F.concat(F.lit("three_pool @"), S.prevalence_tag(F.col("target_prevalence"))))


def anchor_comparison(board: DataFrame, pool_board: DataFrame, model: str = "xgboost") -> DataFrame:
    """Six anchors and three three-pool rows with their Pareto flag."""
    rows = anchor_runs(board, model).unionByName(three_pool_rows(pool_board))
    # the same run may stand in two anchor rows, so the place in the table is the key
    return pareto_front(rows)


def prevalence_table(pool_board: DataFrame) -> DataFrame:
    """Three-pool runs by prevalence, F2 from precision and recall where no F2 is recorded."""
    p, r = F.col("precision_test_thresh"), F.col("recall_test_thresh")
    return pool_board.select(
        "target_prevalence", "pr_auc_test", "roc_auc_test",
        p.alias("precision"), r.alias("recall"), F.col("f1_test_thresh").alias("f1"),
        F.coalesce(F.col("f2_test_thresh"), S.fbeta(p, r, 2.0)).alias("f2"),
        F.col("weighted_accuracy_test_thresh").alias("weighted_accuracy"),
        F.col("tp_test_thresh").alias("tp"), F.col("fp_test_thresh").alias("fp"),
        S.fp_per_tp(F.col("fp_test_thresh"), F.col("tp_test_thresh")).alias("fp_per_tp"),
        "optimal_threshold",
    )


# fixed values: grid rows the three-pool runs are set against
FIXED_ANCHORS = (
    ("baseline", 0.001),
    ("random_undersampling", 0.005),
    ("random_undersampling", 0.01),
    ("class_weighting", 0.01),
    ("smote", 0.001),
)


def fixed_anchor_table(board: DataFrame, pool_board: DataFrame, model: str = "xgboost") -> DataFrame:
    """Fixed grid rows followed by the three-pool rows, with F2."""
    out = None
    for i, (strategy, p) in enumerate(FIXED_ANCHORS):
        row = filter_runs(board, model, strategy, p).orderBy("run_id").limit(1).withColumns(
            {"line": F.lit(i + 1), "grp": F.lit("grid")}
        )
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    pools = pool_board.withColumns(
        {"line": F.row_number().over(Window.orderBy("target_prevalence")) + len(FIXED_ANCHORS), "grp": F.lit("three_pool")}
    )
    both = out.unionByName(pools, allowMissingColumns=True)
    return both.select("line", "grp", "strategy", *[c for c in prevalence_table(both).columns if c == "target_prevalence"],
                       F.col("pr_auc_test").alias("pr_auc"),
                       S.fbeta(F.col("precision_test_thresh"), F.col("recall_test_thresh"), 2.0).alias("f2"),
                       F.col("f1_test_thresh").alias("f1"),
                       S.fp_per_tp(F.col("fp_test_thresh"), F.col("tp_test_thresh")).alias("fp_per_tp"))


def cap_analysis(counts: DataFrame) -> DataFrame:
    """How much of its planned hard share each three-pool run could use."""
    h, t, g = F.col("n_hard_actual"), F.col("n_temporal_actual"), F.col("n_global_actual")
    total = h + t + g
    return counts.withColumns(
        {
            "cap_utilization": F.when(F.col("n_hard_planned") > 0, h / F.col("n_hard_planned")),
            "effective_hard_share": F.when(total > 0, h / total),
        }
    )


def success_criteria(board: DataFrame, pool_board: DataFrame, model: str = "xgboost") -> DataFrame:
    """Per three-pool run: ranking not below the baseline at 0.1 %, F1 within 5 % of the
    best anchor, false alarms per hit not above undersampling at 1 %."""
    base = filter_runs(board, model, "baseline", 0.001).agg(F.max_by("pr_auc_test", "run_id").alias("base_pr_auc"))
    f1 = anchor_runs(board, model).agg(F.max("f1").alias("anchor_f1"))
    rus = filter_runs(board, model, "random_undersampling", 0.01).agg(
        F.max_by(S.fp_per_tp(F.col("fp_test_thresh"), F.col("tp_test_thresh")), "run_id").alias("rus_cost")
    )
    # each side is one row; of a cell that was run again the run with the last stamp counts
    facts = base.join(F.broadcast(f1)).join(F.broadcast(rus))
    cost = S.fp_per_tp(F.col("fp_test_thresh"), F.col("tp_test_thresh"))
    return pool_board.join(F.broadcast(facts)).select(
        "target_prevalence",
        (F.col("pr_auc_test") >= F.col("base_pr_auc")).alias("keeps_ranking"),
        (F.col("f1_test_thresh") >= 0.95 * F.col("anchor_f1")).alias("keeps_f1"),
        F.coalesce(cost <= F.col("rus_cost"), F.lit(False)).alias("keeps_cost"),
    ).withColumn("any_met", F.col("keeps_ranking") | F.col("keeps_f1") | F.col("keeps_cost"))


# ---- importances ----------------------------------------------------------


def mean_importance(long: DataFrame, model: str) -> DataFrame:
    return long.filter(F.col("model") == model).groupBy("feature").agg(
        F.avg("importance").alias("importance"), F.count_distinct("run_id").alias("n_runs")
    )


def importance_by_strategy(long: DataFrame, model: str = "xgboost") -> DataFrame:
    return long.filter(F.col("model") == model).groupBy("strategy", "feature").agg(
        F.avg("importance").alias("importance"), F.count_distinct("run_id").alias("n_runs")
    )


def top_features(means: DataFrame, n: int = 15, within: list[str] | None = None) -> DataFrame:
    """Most important features with their rank, optionally per group."""
    order = Window.partitionBy(*(within or [])).orderBy(F.col("importance").desc(), "feature")
    return means.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
