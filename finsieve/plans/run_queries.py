"""Queries on the experiment grid, the leaderboard and the comparison tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from finsieve.functions import scalars as S
from finsieve.operators import experiments as E
from finsieve.operators import runs as R
from finsieve.operators.ranking import curve_rates
from finsieve.operators.thresholds import curve_of_groups, score_groups
from finsieve.plans import tables as T
from finsieve.plans.ranking_queries import _OPERATING, _RECORD, operating
from finsieve.plans.registry import query
from finsieve.session import scratch_path
from finsieve.sources import run_records as RR


def _rounded(df, names=None, digits=6):
    names = [c for c, t in df.dtypes if t == "double" and c != "target_prevalence"] if names is None else names
    return df.withColumns({c: F.round(c, digits) for c in names})


def _board_columns(tags=("val", "test", "val_thresh", "test_thresh")):
    out = []
    for tag in tags:
        names = R.THRESHOLD_METRICS if tag.endswith("thresh") else R.DEFAULT_METRICS
        out += [f"{m}_{tag}" for m in names]
    return out


def _sql_columns(columns):
    whole = ("tp_", "fp_", "tn_", "fn_")
    return ", ".join(c if c.startswith(whole) else f"round({c}, 6) AS {c}" for c in columns)


_LEADERBOARD = f"""SELECT run_id, model, strategy, target_prevalence, {_sql_columns(_board_columns())}, round(optimal_threshold, 6) AS optimal_threshold,
       CAST(row_number() OVER (ORDER BY pr_auc_test DESC, recall_test_thresh DESC, run_id) AS INTEGER) AS rank FROM run_board"""


@query("leaderboard", _LEADERBOARD, ("run_board",))
def leaderboard(spark, sf_dir):
    board = R.ranked(T.run_board(spark, sf_dir))
    return _rounded(board.select("run_id", "model", "strategy", "target_prevalence", *_board_columns(), "optimal_threshold", "rank"))


_TOP = ["pr_auc_test", "recall_test_thresh", "precision_test_thresh", "f1_test_thresh", "f2_test_thresh", "tp_test_thresh", "fp_test_thresh", "fn_test_thresh"]


@query(
    "leaderboard_top",
    f"SELECT rank, model, strategy, target_prevalence, optimal_threshold, {', '.join(_TOP)} FROM ({_LEADERBOARD}) WHERE rank <= 10",
    ("run_board",),
)
def leaderboard_top(spark, sf_dir):
    top = R.top_runs(T.run_board(spark, sf_dir), 10)
    return _rounded(top.select("rank", "model", "strategy", "target_prevalence", "optimal_threshold", *_TOP))


def _records(r):
    """Configuration, metric records and threshold of a board row, as a run folder holds them."""
    config = {c: r[c] for c in ("run_id", "model", "strategy", "target_prevalence")}
    records = {tag: {m: r[f"{m}_{tag}"] for m in (R.THRESHOLD_METRICS if tag.endswith("thresh") else R.DEFAULT_METRICS)} for tag in RR.METRIC_TAGS}
    return config, records, {"criterion": "f1", "optimal_threshold": r["optimal_threshold"]}


@query("scan_run_records", _LEADERBOARD, ("run_board",))
def scan_run_records(spark, sf_dir):
    root = scratch_path(spark, "runs")
    # one record per run: written folder by folder, as a run writes its own
    for r in T.run_board(spark, sf_dir).collect():
        RR.save_run(spark, root, *_records(r))
    board = R.ranked(RR.scan_run_records(spark, root))
    whole = {c: F.col(c).cast("bigint") for c in _board_columns() if c[:3] in ("tp_", "fp_", "tn_", "fn_")}
    board = board.withColumns(whole)
    return _rounded(board.select("run_id", "model", "strategy", "target_prevalence", *_board_columns(), "optimal_threshold", "rank"))


@query(
    "filter_runs",
    """SELECT run_id, model, strategy, target_prevalence FROM run_board WHERE model = 'xgboost' AND strategy <> 'adasyn' AND abs(target_prevalence - 0.005) < 1e-9""",
    ("run_board",),
)
def filter_runs(spark, sf_dir):
    kept = R.filter_runs(T.run_board(spark, sf_dir), model="xgboost", drop_strategy="adasyn", prevalence=0.005)
    return kept.select("run_id", "model", "strategy", "target_prevalence")


# a cell's rows: one part of the transactions per grid cell, told by format and currency
_CELL_SQL = """(SELECT DISTINCT CAST((CAST(substr(payment_currency, 4) AS BIGINT) * 6 + CAST(substr(to_bank, 2) AS BIGINT)) % 30 AS BIGINT) AS run_no
FROM txn WHERE label = 1 AND payment_format = 'RF' AND CAST(substr(to_bank, 2) AS BIGINT) < 4)"""


def _run_root(spark, sf_dir):
    """A folder with a published run of every grid cell for which the transactions hold one, and a half-written one of each other cell."""
    number = lambda c, start: F.substring(c, start, 10).cast("int")
    t = T.txn(spark, sf_dir).filter("label = 1 AND payment_format = 'RF'").filter(number("to_bank", 2) < 4)
    cell = (number("payment_currency", 4) * 6 + number("to_bank", 2)) % 30
    stamps = {r["run_no"]: r["stamp"] for r in t.groupBy(cell.alias("run_no")).agg(F.date_format(F.max("timestamp"), "yyyyMMdd_HHmmss").alias("stamp")).collect()}
    root = scratch_path(spark, "grid-runs")
    for r in T.run_board(spark, sf_dir).collect():
        config, records, threshold = _records(r)
        config["run_id"] = f"{r['run_id']}__{stamps.get(r['run_no'], '20200101_000000')}"
        if r["run_no"] in stamps:
            RR.save_run(spark, root, config, records, threshold)
        else:
            # a run that was lost before its marker
            RR.write_text(spark, f"{root}/{config['run_id']}/{RR.CONFIG_FILE}", json.dumps(config))
            RR.save_metrics(spark, records["test"], f"{root}/{config['run_id']}", "test")
    return root


@query(
    "experiment_grid",
    """SELECT r.run_no, r.model, r.strategy, r.target_prevalence, r.tag, concat(r.model, '__', r.strategy, '__', r.tag) AS run_id, count(*) AS n_scored
FROM run_scores s JOIN runs r ON s.run_no = r.run_no GROUP BY ALL""",
    ("run_scores", "runs"),
)
def experiment_grid(spark, sf_dir):
    grid = R.experiment_grid(spark).withColumn("run_no", F.col("run_no").cast("bigint"))
    scored = T.run_scores(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_scored"))
    return grid.join(scored, "run_id").select("run_no", "model", "strategy", "target_prevalence", "tag", "run_id", "n_scored")


@query(
    "grid_pending",
    f"SELECT run_no, model, strategy, tag FROM runs WHERE run_no NOT IN {_CELL_SQL}",
    ("runs", "txn"),
)
def grid_pending(spark, sf_dir):
    done = RR.completed_runs(spark, _run_root(spark, sf_dir))
    return R.pending_cells(R.experiment_grid(spark), done).select(F.col("run_no").cast("bigint").alias("run_no"), "model", "strategy", "tag")


@query(
    "grid_status",
    f"""SELECT CASE WHEN run_no IN {_CELL_SQL} THEN 'passed' ELSE 'pending' END AS status, count(*) AS n_runs FROM runs GROUP BY 1""",
    ("runs", "txn"),
)
def grid_status(spark, sf_dir):
    done = R.completed_cells(RR.completed_runs(spark, _run_root(spark, sf_dir))).withColumn("status", F.lit("passed"))
    grid = R.experiment_grid(spark).join(done, ["model", "strategy", "tag"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    return R.status_summary(grid)


@query(
    "baseline_invariance",
    """SELECT model, count(*) AS n_runs, count(DISTINCT pr_auc_test) AS n_values, count(DISTINCT pr_auc_test) = 1 AS identical
FROM (SELECT model, pr_auc_test FROM run_board WHERE strategy = 'baseline') GROUP BY model""",
    ("run_board",),
)
def baseline_invariance(spark, sf_dir):
    return R.baseline_invariance(T.run_board(spark, sf_dir))


_FPPT = "CASE WHEN tp_test_thresh > 0 THEN CAST(fp_test_thresh AS DOUBLE) / tp_test_thresh END"
_F2 = """CASE WHEN 4 * precision_test_thresh + recall_test_thresh > 0 THEN 5 * precision_test_thresh * recall_test_thresh / (4 * precision_test_thresh + recall_test_thresh) ELSE 0 END"""


@query(
    "main_results",
    f"""SELECT CAST(row_number() OVER (ORDER BY CASE model WHEN 'xgboost' THEN 0 WHEN 'random_forest' THEN 1 ELSE 2 END, strategy, target_prevalence) AS INTEGER) AS line,
       run_id, model, strategy, target_prevalence, round(pr_auc_test, 6) AS pr_auc_test, round(precision_test_thresh, 6) AS precision_thresh,
       round(recall_test_thresh, 6) AS recall_thresh, round(f1_test_thresh, 6) AS f1_thresh, round({_FPPT}, 6) AS fp_per_tp FROM run_board WHERE strategy <> 'adasyn'""",
    ("run_board",),
)
def main_results(spark, sf_dir):
    return _rounded(R.main_results(T.run_board(spark, sf_dir)))


_BOTH = ["precision", "recall", "f1", "weighted_accuracy", "tp", "fp"]


@query(
    "appendix_results",
    """SELECT CAST(row_number() OVER (ORDER BY CASE model WHEN 'xgboost' THEN 0 WHEN 'random_forest' THEN 1 ELSE 2 END, strategy, target_prevalence) AS INTEGER) AS line,
       model, strategy, target_prevalence, round(pr_auc_test, 6) AS pr_auc_test, """
    + ", ".join((f"{m}_test{s}" if m in ("tp", "fp") else f"round({m}_test{s}, 6)") + f" AS {m}_{n}" for s, n in (("", "default"), ("_thresh", "thresh")) for m in _BOTH)
    + " FROM run_board WHERE strategy <> 'adasyn'",
    ("run_board",),
)
def appendix_results(spark, sf_dir):
    return _rounded(R.appendix_results(T.run_board(spark, sf_dir)))


@query(
    "main_table_rows",
    f"""SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY CASE strategy WHEN 'baseline' THEN 0 WHEN 'random_undersampling' THEN 1 WHEN 'smote' THEN 2
         WHEN 'class_weighting' THEN 3 ELSE 4 END, target_prevalence) AS INTEGER) AS line, strategy, target_prevalence, round(pr_auc_test, 6) AS pr_auc_test,
       round(roc_auc_test, 6) AS roc_auc_test, round(precision_test_thresh, 6) AS precision, round(recall_test_thresh, 6) AS recall, round(f1_test_thresh, 6) AS f1,
       round({_F2}, 6) AS f2, round(weighted_accuracy_test_thresh, 6) AS weighted_accuracy, tp_test_thresh AS tp, fp_test_thresh AS fp,
       round({_FPPT}, 6) AS fp_per_tp, round(optimal_threshold, 6) AS optimal_threshold
FROM run_board b WHERE strategy <> 'adasyn' AND (strategy <> 'baseline' OR target_prevalence = (SELECT min(target_prevalence) FROM run_board))""",
    ("run_board",),
)
def main_table_rows(spark, sf_dir):
    return _rounded(R.per_model_table(T.run_board(spark, sf_dir)))


_NAMES = ["pr_auc", "precision", "recall", "f1", "tp", "fp"]


def _long_sql(source):
    return f"SELECT unnest({_NAMES + ['fp_per_tp']}) AS metric, unnest([{', '.join(f'CAST({n} AS DOUBLE)' for n in _NAMES)}, CASE WHEN tp > 0 THEN CAST(fp AS DOUBLE) / tp END]) AS v FROM ({source})"


@query(
    "metric_comparison",
    f"""SELECT a.metric, round(a.v, 6) AS reference, round(b.v, 6) AS candidate, round(CASE WHEN a.metric = 'pr_auc' THEN 0 ELSE b.v - a.v END, 6) AS delta
FROM ({_long_sql(f"SELECT * FROM ({_RECORD}) WHERE split = 'test'")}) a
JOIN ({_long_sql(f"SELECT * FROM ({_OPERATING}) WHERE strategy = 'precision_constrained'")}) b ON a.metric = b.metric""",
    ("curve",),
)
def metric_comparison(spark, sf_dir):
    from finsieve.operators.ranking import metric_record

    rates = ["pr_auc", "precision", "recall", "f1"]
    base = _rounded(metric_record(T.txn(spark, sf_dir).filter("split = 'test'"), [], 0.5), rates)
    cand = _rounded(operating(spark, sf_dir).filter("strategy = 'precision_constrained'"), rates)
    return _rounded(R.metric_comparison(base, cand), ["reference", "candidate", "delta"])


_PARETO_ROWS = f"SELECT run_id, precision_test_thresh AS precision, recall_test_thresh AS recall, COALESCE({_FPPT}, 'inf'::DOUBLE) AS cost FROM run_board"


@query(
    "pareto_front",
    f"""WITH x AS ({_PARETO_ROWS}) SELECT a.run_id, NOT EXISTS (SELECT 1 FROM x b WHERE b.run_id <> a.run_id AND b.recall >= a.recall AND b.precision >= a.precision AND b.cost <= a.cost
   AND (b.recall > a.recall OR b.precision > a.precision OR b.cost < a.cost)) AS is_pareto FROM x a""".replace("WITH x AS", ", x AS", 1),
    ("run_board",),
)
def pareto_front(spark, sf_dir):
    board = T.run_board(spark, sf_dir).select(
        "run_id",
        F.col("precision_test_thresh").alias("precision"),
        F.col("recall_test_thresh").alias("recall"),
        S.fp_per_tp(F.col("fp_test_thresh"), F.col("tp_test_thresh")).alias("fp_per_tp"),
    )
    return R.pareto_front(board).select("run_id", "is_pareto")


@query(
    "pareto_front_points",
    """, x AS (SELECT run_no, s, CAST(cp AS DOUBLE) / cn AS precision, CASE WHEN p_all > 0 THEN CAST(cp AS DOUBLE) / p_all ELSE 1 END AS recall,
    CASE WHEN cp > 0 THEN CAST(cn - cp AS DOUBLE) / cp ELSE 'inf'::DOUBLE END AS cost FROM run_curve WHERE split = 'test'),
goals AS (SELECT DISTINCT precision, recall, cost FROM x),
beaten AS (SELECT DISTINCT a.precision, a.recall, a.cost FROM goals a JOIN goals b ON b.recall >= a.recall AND b.precision >= a.precision AND b.cost <= a.cost
   AND (b.recall > a.recall OR b.precision > a.precision OR b.cost < a.cost))
SELECT r.model, r.strategy, r.tag, x.s AS milli, (x.precision, x.recall, x.cost) NOT IN (SELECT (precision, recall, cost) FROM beaten) AS is_pareto
FROM x JOIN runs r ON x.run_no = r.run_no""",
    ("run_curve", "runs"),
)
def pareto_front_points(spark, sf_dir):
    """Every threshold of every run as an operating point on the test rows."""
    scored = T.run_scores(spark, sf_dir).filter("split = 'test'")
    curve = curve_of_groups(score_groups(scored, ["run_id"]), ["run_id"]).withColumns(curve_rates())
    points = curve.withColumn("fp_per_tp", S.fp_per_tp(F.col("cum_n") - F.col("cum_p"), F.col("cum_p")))
    part = [S.run_id_part(F.col("run_id"), i).alias(n) for i, n in enumerate(("model", "strategy", "tag"))]
    return R.pareto_front(points).select(*part, F.round(F.col("score") * 1000).cast("bigint").alias("milli"), "is_pareto")


@query(
    "threshold_runs",
    f"SELECT strategy, selection, threshold, tp, fp, tn, fn, precision, recall, f1, f2, round(pr_auc, 6) AS pr_auc FROM ({_OPERATING})",
    ("curve",),
)
def threshold_runs(spark, sf_dir):
    """Runs that the threshold strategies publish from one baseline run's stored scores, read back."""
    root, out, name = scratch_path(spark, "baseline-run"), scratch_path(spark, "threshold-runs"), "boosted_trees__baseline__p001__1"
    held_out = T.txn(spark, sf_dir).filter("split IN ('val', 'test')").select("row_idx", "split", "label", "score")
    held_out.write.parquet(f"{root}/{name}/{E.SCORES}")
    RR.save_run(spark, root, {"run_id": name, "model": "boosted_trees", "strategy": "baseline", "target_prevalence": 0.001}, {}, None)
    E.optimise_thresholds(spark, root, out)
    board = RR.scan_run_records(spark, out)
    rates = ["precision", "recall", "f1", "f2"]
    return board.select(
        "strategy", F.col("threshold_criterion").alias("selection"), F.round("optimal_threshold", 6).alias("threshold"),
        *[F.col(f"{c}_test_thresh").cast("bigint").alias(c) for c in ("tp", "fp", "tn", "fn")],
        *[F.round(f"{c}_test_thresh", 6).alias(c) for c in rates], F.round("pr_auc_test", 6).alias("pr_auc"),
    )


def _anchor(position, why, where, order):
    return f"""SELECT * FROM (SELECT {position} AS position, concat(model, ' ', strategy, ' @', tag, ' {why}') AS configuration, 'grid' AS grp, target_prevalence,
  pr_auc_test AS pr_auc, optimal_threshold AS threshold, precision_test_thresh AS precision, recall_test_thresh AS recall, f1_test_thresh AS f1,
  tp_test_thresh AS tp, fp_test_thresh AS fp, {_FPPT} AS fp_per_tp FROM run_board WHERE model = 'xgboost' AND {where} ORDER BY {order} LIMIT 1)"""


_ANCHORS = " UNION ALL ".join(
    [
        _anchor(1, "best_pr_auc", "strategy = 'baseline'", "pr_auc_test DESC, target_prevalence"),
        _anchor(2, "f1_opt", "strategy = 'random_undersampling' AND tag = 'p005'", "run_no"),
        _anchor(3, "f1_opt", "strategy = 'class_weighting' AND tag = 'p010'", "run_no"),
        _anchor(4, "best_pr_auc", "strategy = 'adasyn'", "pr_auc_test DESC, run_no"),
        _anchor(5, "best_pr_auc", "strategy = 'smote'", "pr_auc_test DESC, run_no"),
        _anchor(6, "best_f1", "strategy = 'smote'", "f1_test_thresh DESC, run_no"),
    ]
)
_POOLS = f"""SELECT CAST(row_number() OVER (ORDER BY target_prevalence) + 6 AS INTEGER) AS position, concat('three_pool @', tag) AS configuration, 'three_pool' AS grp, target_prevalence,
  pr_auc_test AS pr_auc, optimal_threshold AS threshold, precision_test_thresh AS precision, recall_test_thresh AS recall, f1_test_thresh AS f1,
  tp_test_thresh AS tp, fp_test_thresh AS fp, {_FPPT} AS fp_per_tp FROM pool_board"""
_COMPARED = f"SELECT * FROM ({_ANCHORS} UNION ALL {_POOLS})"
_SHOWN = "position, configuration, grp, target_prevalence, round(pr_auc, 6) AS pr_auc, round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, tp, fp, round(fp_per_tp, 6) AS fp_per_tp"


@query("anchor_runs", f"SELECT {_SHOWN} FROM ({_ANCHORS})", ("run_board",))
def anchor_runs(spark, sf_dir):
    return _rounded(R.anchor_runs(T.run_board(spark, sf_dir)))


@query(
    "anchor_comparison",
    f""", x AS ({_COMPARED}) SELECT {_SHOWN}, NOT EXISTS (SELECT 1 FROM x b WHERE b.position <> a.position AND b.recall >= a.recall AND b.precision >= a.precision
   AND COALESCE(b.fp_per_tp, 'inf'::DOUBLE) <= COALESCE(a.fp_per_tp, 'inf'::DOUBLE)
   AND (b.recall > a.recall OR b.precision > a.precision OR COALESCE(b.fp_per_tp, 'inf'::DOUBLE) < COALESCE(a.fp_per_tp, 'inf'::DOUBLE))) AS is_pareto FROM x a""",
    ("run_board", "pool_board"),
)
def anchor_comparison(spark, sf_dir):
    return _rounded(R.anchor_comparison(T.run_board(spark, sf_dir), T.pool_board(spark, sf_dir)))


@query(
    "prevalence_table",
    f"""SELECT target_prevalence, round(pr_auc_test, 6) AS pr_auc_test, round(roc_auc_test, 6) AS roc_auc_test, round(precision_test_thresh, 6) AS precision,
       round(recall_test_thresh, 6) AS recall, round(f1_test_thresh, 6) AS f1, round(f2_test_thresh, 6) AS f2, round(weighted_accuracy_test_thresh, 6) AS weighted_accuracy,
       tp_test_thresh AS tp, fp_test_thresh AS fp, round({_FPPT}, 6) AS fp_per_tp, round(optimal_threshold, 6) AS optimal_threshold FROM pool_board""",
    ("pool_board",),
)
def prevalence_table(spark, sf_dir):
    return _rounded(R.prevalence_table(T.pool_board(spark, sf_dir)))


_FIXED = " UNION ALL ".join(
    f"SELECT {i + 1} AS line, 'grid' AS grp, * FROM run_board WHERE model = 'xgboost' AND strategy = '{s}' AND abs(target_prevalence - {p}) < 1e-9"
    for i, (s, p) in enumerate(R.FIXED_ANCHORS)
)


@query(
    "fixed_anchor_table",
    f"""SELECT line, grp, strategy, target_prevalence, round(pr_auc_test, 6) AS pr_auc, round({_F2}, 6) AS f2, round(f1_test_thresh, 6) AS f1, round({_FPPT}, 6) AS fp_per_tp
FROM ({_FIXED} UNION ALL SELECT CAST(row_number() OVER (ORDER BY target_prevalence) + {len(R.FIXED_ANCHORS)} AS INTEGER), 'three_pool', * FROM pool_board)""",
    ("run_board", "pool_board"),
)
def fixed_anchor_table(spark, sf_dir):
    return _rounded(R.fixed_anchor_table(T.run_board(spark, sf_dir), T.pool_board(spark, sf_dir)))


@query(
    "success_criteria",
    f"""SELECT *, keeps_ranking OR keeps_f1 OR keeps_cost AS any_met FROM (
  SELECT target_prevalence, pr_auc_test >= (SELECT pr_auc_test FROM run_board WHERE run_id = 'xgboost__baseline__p001') AS keeps_ranking,
         f1_test_thresh >= 0.95::DOUBLE * (SELECT max(f1) FROM ({_ANCHORS})) AS keeps_f1,
         COALESCE({_FPPT} <= (SELECT {_FPPT} FROM run_board WHERE run_id = 'xgboost__random_undersampling__p010'), false) AS keeps_cost FROM pool_board)""",
    ("run_board", "pool_board"),
)
def success_criteria(spark, sf_dir):
    return R.success_criteria(T.run_board(spark, sf_dir), T.pool_board(spark, sf_dir))


_MEAN = "SELECT feature, round(avg(importance), 6) AS importance, count(DISTINCT run_id) AS n_runs FROM importances WHERE model = '{m}' GROUP BY feature"
_BY = "SELECT strategy, feature, round(avg(importance), 6) AS importance, count(DISTINCT run_id) AS n_runs FROM importances WHERE model = 'xgboost' GROUP BY strategy, feature"


def _mean(spark, sf_dir, model):
    return _rounded(R.mean_importance(T.importances(spark, sf_dir), model), ["importance"])


@query(
    "importance_mean",
    " UNION ALL ".join(f"SELECT '{m}' AS model, * FROM ({_MEAN.format(m=m)})" for m in R.GRID_MODELS),
    ("importances",),
)
def importance_mean(spark, sf_dir):
    parts = [_mean(spark, sf_dir, m).withColumn("model", F.lit(m)) for m in R.GRID_MODELS]
    return parts[0].unionByName(parts[1])


@query("importance_by_strategy", _BY, ("importances",))
def importance_by_strategy(spark, sf_dir):
    return _rounded(R.importance_by_strategy(T.importances(spark, sf_dir)), ["importance"])


@query(
    "importance_top",
    f"SELECT * FROM (SELECT feature, importance, n_runs, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM ({_MEAN.format(m='xgboost')})) WHERE rank <= 15",
    ("importances",),
)
def importance_top(spark, sf_dir):
    return R.top_features(_mean(spark, sf_dir, "xgboost"), 15)


@query(
    "importance_top_per_strategy",
    f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY strategy ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM ({_BY})) WHERE rank <= 5",
    ("importances",),
)
def importance_top_per_strategy(spark, sf_dir):
    return R.top_features(_rounded(R.importance_by_strategy(T.importances(spark, sf_dir)), ["importance"]), 5, ["strategy"])
