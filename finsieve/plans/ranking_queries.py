"""Queries on ranking metrics and threshold selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from finsieve.functions import scalars as S
from finsieve.operators import ranking as R
from finsieve.operators import thresholds as TH
from finsieve.plans import tables as T
from finsieve.plans.oracle_views import AVERAGE_PRECISION
from finsieve.plans.registry import query

_RATES = ["pr_auc", "roc_auc", "precision", "recall", "f1", "f2", "weighted_accuracy", "threshold"]


def _rounded(df, columns=_RATES, digits=6):
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns if c in df.columns})


_CONFUSION = """SELECT split, CAST(COALESCE(sum(p) FILTER (WHERE s >= 900), 0) AS BIGINT) AS tp, CAST(COALESCE(sum(n - p) FILTER (WHERE s >= 900), 0) AS BIGINT) AS fp,
       CAST(COALESCE(sum(n - p) FILTER (WHERE s < 900), 0) AS BIGINT) AS tn, CAST(COALESCE(sum(p) FILTER (WHERE s < 900), 0) AS BIGINT) AS fn FROM curve GROUP BY split"""
_P = "CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END"
_R = "CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END"
_F = "CASE WHEN (1 + {b2}) * tp + {b2} * fn + fp > 0 THEN CAST((1 + {b2}) * tp AS DOUBLE) / ((1 + {b2}) * tp + {b2} * fn + fp) ELSE 0 END"
_WA = f"CASE WHEN tp + fn > 0 THEN ({_R} + CAST(tn AS DOUBLE) / (tn + fp)) / 2 ELSE CAST(tn AS DOUBLE) / (tn + fp) END"
_CUT = 0.9


@query("predict_at_threshold", "SELECT row_idx, CASE WHEN score_milli >= 900 THEN 1 ELSE 0 END AS predicted FROM txn")
def predict_at_threshold(spark, sf_dir):
    # scores are single precision, so the threshold is compared as one
    at = F.lit(_CUT).cast("float")
    return T.txn(spark, sf_dir).select("row_idx", S.predicted(F.col("score"), at).alias("predicted"))


def _confused(spark, sf_dir):
    return R.confusion(T.txn(spark, sf_dir), ["split"], F.lit(_CUT).cast("float"))


@query("confusion", _CONFUSION, ("curve",))
def confusion(spark, sf_dir):
    return _confused(spark, sf_dir)


@query(
    "threshold_metrics",
    f"SELECT split, round({_P}, 6) AS precision, round({_R}, 6) AS recall, round({_F.format(b2=1)}, 6) AS f1, round({_F.format(b2=4)}, 6) AS f2 FROM ({_CONFUSION})",
    ("curve",),
)
def threshold_metrics(spark, sf_dir):
    m = R.threshold_metrics()
    m.pop("weighted_accuracy")
    return _rounded(_confused(spark, sf_dir).select("split", *[e.alias(c) for c, e in m.items()]))


@query("weighted_accuracy", f"SELECT split, round({_WA}, 6) AS weighted_accuracy FROM ({_CONFUSION})", ("curve",))
def weighted_accuracy(spark, sf_dir):
    return _rounded(_confused(spark, sf_dir).select("split", R.threshold_metrics()["weighted_accuracy"].alias("weighted_accuracy")))


@query(
    "fbeta",
    f"""SELECT split, round(CASE WHEN 4 * p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END, 6) AS f2,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT split, {_P} AS p, {_R} AS r FROM ({_CONFUSION}))""",
    ("curve",),
)
def fbeta(spark, sf_dir):
    c = _confused(spark, sf_dir)
    p, r = S.share(F.col("tp"), F.col("tp") + F.col("fp")), S.share(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("split", F.round(S.fbeta(p, r, 2.0), 6).alias("f2"), F.round(S.fbeta(p, r, 1.0), 6).alias("f1"))


@query(
    "fp_per_tp",
    """SELECT payment_format, CASE WHEN tp > 0 THEN round(CAST(fp AS DOUBLE) / tp, 6) END AS fp_per_tp FROM (
  SELECT payment_format, count(*) FILTER (WHERE score_milli >= 900 AND label = 1) AS tp, count(*) FILTER (WHERE score_milli >= 900 AND label = 0) AS fp
  FROM txn GROUP BY payment_format)""",
)
def fp_per_tp(spark, sf_dir):
    c = R.confusion(T.txn(spark, sf_dir), ["payment_format"], F.lit(_CUT).cast("float"))
    return c.select("payment_format", F.round(S.fp_per_tp(F.col("fp"), F.col("tp")), 6).alias("fp_per_tp"))


_AP = f"round({AVERAGE_PRECISION}, 6)"
_AUC = "round(CAST(sum((n - p) * (2 * cp - p)) AS DOUBLE) / 2 / (CAST(max(p_all) AS DOUBLE) * (max(n_all) - max(p_all))), 6)"


@query("average_precision", f"SELECT split, {_AP} AS pr_auc FROM curve GROUP BY split", ("curve",))
def average_precision(spark, sf_dir):
    return _rounded(R.ranking_quality(T.txn(spark, sf_dir), ["split"]).select("split", "pr_auc"))


@query("roc_auc", f"SELECT split, {_AUC} AS roc_auc FROM curve GROUP BY split", ("curve",))
def roc_auc(spark, sf_dir):
    return _rounded(R.ranking_quality(T.txn(spark, sf_dir), ["split"]).select("split", "roc_auc"))


_RECORD = f"""SELECT c.split, q.pr_auc, q.roc_auc, round({_P}, 6) AS precision, round({_R}, 6) AS recall, round({_F.format(b2=1)}, 6) AS f1,
       round({_F.format(b2=4)}, 6) AS f2, round({_WA}, 6) AS weighted_accuracy, tp, fp, tn, fn, CAST(0.5 AS DOUBLE) AS threshold
FROM ({_CONFUSION.replace('900', '500')}) c JOIN (SELECT split, {_AP} AS pr_auc, {_AUC} AS roc_auc FROM curve GROUP BY split) q ON c.split = q.split"""


@query("metric_record", _RECORD, ("curve",))
def metric_record(spark, sf_dir):
    return _rounded(R.metric_record(T.txn(spark, sf_dir), ["split"], 0.5))


@query(
    "score_stats",
    """SELECT split, count(*) AS n, round(min(score_milli) / 1000.0, 6)::DOUBLE AS min_score, round(max(score_milli) / 1000.0, 6)::DOUBLE AS max_score,
       round(avg(score_milli) / 1000, 6) AS mean_score FROM txn GROUP BY split""",
)
def score_stats(spark, sf_dir):
    scored = T.txn(spark, sf_dir).select("split", (F.col("score_milli") / 1000).alias("score"))
    return _rounded(R.score_stats(scored, ["split"]), ["min_score", "max_score", "mean_score"])


@query(
    "pr_curve",
    """SELECT split, s AS score_milli, cn AS n_predicted, cp AS n_hits, round(CAST(cp AS DOUBLE) / cn, 6) AS precision,
       round(CASE WHEN p_all > 0 THEN CAST(cp AS DOUBLE) / p_all ELSE 1 END, 6) AS recall FROM curve""",
    ("curve",),
)
def pr_curve(spark, sf_dir):
    c = R.pr_curve(T.txn(spark, sf_dir), ["split"])
    milli = F.round(F.col("score").cast("double") * 1000).cast("bigint")
    return _rounded(
        c.select("split", milli.alias("score_milli"), F.col("cum_n").alias("n_predicted"), F.col("cum_p").alias("n_hits"), "precision", "recall")
    )


_TAU = "round(CAST(CAST(s / CAST(1000 AS DOUBLE) AS FLOAT) AS DOUBLE), 6)"
_BEST = """SELECT '{name}' AS criterion, split, {tau} AS threshold FROM (
  SELECT split, s, row_number() OVER (PARTITION BY split ORDER BY {goal} DESC, s) AS rn FROM curve) WHERE rn = 1"""
_GOALS = {
    "f1": "CAST(2 * cp AS DOUBLE) / (cn + p_all)",
    "recall": "CASE WHEN cp > 0 THEN CAST(cp AS DOUBLE) / p_all ELSE -1 END",
    "precision": "CASE WHEN cp > 0 THEN CAST(cp AS DOUBLE) / cn ELSE -1 END",
}


@query("best_threshold", " UNION ALL ".join(_BEST.format(name=n, goal=g, tau=_TAU) for n, g in _GOALS.items()), ("curve",))
def best_threshold(spark, sf_dir):
    out = None
    for c in TH.CRITERIA:
        one = TH.best_threshold(T.txn(spark, sf_dir), ["split"], c).select(F.lit(c).alias("criterion"), "split", "threshold")
        out = one if out is None else out.unionByName(one)
    return _rounded(out)


def _val(spark, sf_dir):
    return T.txn(spark, sf_dir).filter("split = 'val'")


_SPARSE = ", ".join(f"{j}::DOUBLE / 16" for j in range(17))


@query(
    "threshold_grid",
    f"""SELECT 1000 AS n_dense, {_TAU} AS threshold FROM curve WHERE split = 'val' UNION ALL
SELECT 17, round(q, 6) FROM (SELECT DISTINCT unnest(quantile_cont(CAST(score AS DOUBLE), [{_SPARSE}])) AS q FROM txn WHERE split = 'val')""",
    ("curve", "txn"),
)
def threshold_grid(spark, sf_dir):
    dense = TH.threshold_grid(_val(spark, sf_dir), 1000).withColumn("n_dense", F.lit(1000))
    sparse = TH.threshold_grid(_val(spark, sf_dir), 17).withColumn("n_dense", F.lit(17))
    return _rounded(dense.unionByName(sparse))


# all distinct scores as candidates; the counts of each, then one pick per strategy
_POINTS = f"""SELECT s, CAST(CAST(s / CAST(1000 AS DOUBLE) AS FLOAT) AS DOUBLE) AS threshold, tp, fp, tn, fn, {_P} AS precision, {_R} AS recall,
       {_F.format(b2=1)} AS f1, {_F.format(b2=4)} AS f2, tp - 0.05::DOUBLE * fp AS utility
FROM (SELECT s, cp AS tp, cn - cp AS fp, n_all - p_all - cn + cp AS tn, p_all - cp AS fn FROM curve WHERE split = '{{split}}')"""
_PICK = """SELECT '{name}' AS strategy, {sel} AS selection, threshold, s, tp, fp, tn, fn, precision, recall, f1, f2, utility
FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM ({points})) WHERE rn = 1"""


def _pick(name, split="val", floor="0.10"):
    points = _POINTS.format(split=split)
    if name != "precision_constrained":
        return _PICK.format(name=name, sel=f"'{TH.CHOSEN_BY_GOAL.format(strategy=name)}'", order=f"{name[:2]} DESC, s", points=points)
    tier = f"CASE WHEN precision >= {floor} THEN 1 WHEN recall > 0 THEN 2 ELSE 3 END"
    by = TH.CHOSEN_BY_TIER
    sel = f"CASE {tier} WHEN 1 THEN '{by[1]}' WHEN 2 THEN '{by[2]}' ELSE '{by[3]}' END"
    goal = f"CASE WHEN precision >= {floor} THEN f1 WHEN recall > 0 THEN precision ELSE 0 END"
    return _PICK.format(name=name, sel=sel, order=f"{tier}, {goal} DESC, utility DESC, s", points=points)


def _flat(inner):
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in ("threshold", "precision", "recall", "f1", "f2", "utility"))
    return f"SELECT strategy, selection, tp, fp, tn, fn, {rounded} FROM ({inner})"


@query("threshold_f1_f2", _flat(f"{_pick('f1_max')} UNION ALL {_pick('f2_max')}"), ("curve",))
def threshold_f1_f2(spark, sf_dir):
    val = _val(spark, sf_dir)
    points = TH.curve_points(R.score_groups(val, []))
    both = TH.select_threshold(points, "f1_max").unionByName(TH.select_threshold(points, "f2_max"))
    return _rounded(both, [*_RATES, "utility"])


@query("threshold_precision_constrained", _flat(_pick("precision_constrained")), ("curve",))
def threshold_precision_constrained(spark, sf_dir):
    val = _val(spark, sf_dir)
    points = TH.curve_points(R.score_groups(val, []))
    return _rounded(TH.select_threshold(points, "precision_constrained"), [*_RATES, "utility"])


_NO_POSITIVE = f"""SELECT 'precision_constrained' AS strategy, '{TH.CHOSEN_BY_TIER[3]}' AS selection, CAST(0 AS BIGINT) AS tp, fp, tn, CAST(0 AS BIGINT) AS fn,
  CAST(0.5 AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS precision, CAST(0 AS DOUBLE) AS recall, CAST(0 AS DOUBLE) AS f1, CAST(0 AS DOUBLE) AS f2, round(-CAST(0.05 AS DOUBLE) * fp, 6) AS utility
FROM (SELECT count(*) FILTER (WHERE score_milli >= 500) AS fp, count(*) FILTER (WHERE score_milli < 500) AS tn FROM txn WHERE split = 'val' AND label = 0)"""


@query("threshold_fallbacks", f"{_flat(_pick('precision_constrained', floor='2'))} UNION ALL BY NAME {_NO_POSITIVE}", ("curve", "txn"))
def threshold_fallbacks(spark, sf_dir):
    """A precision that no threshold reaches, and validation rows without a positive."""
    val = _val(spark, sf_dir)
    unreached = TH.select_threshold(TH.curve_points(R.score_groups(val, [])), "precision_constrained", min_precision=2.0)
    nothing = TH.select_threshold(TH.curve_points(R.score_groups(val.filter("label = 0"), [])), "precision_constrained")
    return _rounded(unreached.unionByName(nothing), [*_RATES, "utility"])


_CHOSEN = " UNION ALL ".join(f"SELECT strategy, selection, s AS tau FROM ({_pick(n)})" for n in TH.STRATEGIES)
_REF = f"SELECT 'reference', 'f1', s FROM (SELECT s, row_number() OVER (ORDER BY {_GOALS['f1']} DESC, s) AS rn FROM curve WHERE split = 'val') WHERE rn = 1"
_MEASURED = f"""SELECT strategy, selection, tau, tp, fp, tn, fn, {_P} AS precision, {_R} AS recall, {_F.format(b2=1)} AS f1, {_F.format(b2=4)} AS f2, pr_auc FROM (
  SELECT x.strategy, x.selection, x.tau, CAST(COALESCE(sum(p) FILTER (WHERE s >= x.tau), 0) AS BIGINT) AS tp,
         CAST(COALESCE(sum(n - p) FILTER (WHERE s >= x.tau), 0) AS BIGINT) AS fp, CAST(COALESCE(sum(n - p) FILTER (WHERE s < x.tau), 0) AS BIGINT) AS tn,
         CAST(COALESCE(sum(p) FILTER (WHERE s < x.tau), 0) AS BIGINT) AS fn, {_AP} AS pr_auc
  FROM curve CROSS JOIN ({_CHOSEN} UNION ALL {_REF}) x WHERE split = 'test' GROUP BY 1, 2, 3)"""
_OPERATING = f"""SELECT m.strategy, m.selection, round(CAST(CAST(m.tau / CAST(1000 AS DOUBLE) AS FLOAT) AS DOUBLE), 6) AS threshold, m.tp, m.fp, m.tn, m.fn,
       round(m.precision, 6) AS precision, round(m.recall, 6) AS recall, round(m.f1, 6) AS f1, round(m.f2, 6) AS f2, m.pr_auc,
       round(m.precision - r.precision, 6) AS delta_precision, round(m.recall - r.recall, 6) AS delta_recall, round(m.f1 - r.f1, 6) AS delta_f1,
       round(m.f2 - r.f2, 6) AS delta_f2, m.fp - r.fp AS delta_fp, abs(m.pr_auc - r.pr_auc) <= 1e-9 AS pr_auc_same
FROM (SELECT * FROM ({_MEASURED}) WHERE strategy <> 'reference') m, (SELECT * FROM ({_MEASURED}) WHERE strategy = 'reference') r"""
_OPERATING_COLUMNS = ["strategy", "selection", "threshold", "tp", "fp", "tn", "fn", "precision", "recall", "f1", "f2", "pr_auc"]
_DELTAS = ["delta_precision", "delta_recall", "delta_f1", "delta_f2"]


def operating(spark, sf_dir):
    """Operating points of the score column, chosen on validation rows."""
    t = T.txn(spark, sf_dir)
    return TH.operating_points(t.filter("split = 'val'"), t.filter("split = 'test'"))


@query("operating_points", _OPERATING, ("curve",))
def operating_points(spark, sf_dir):
    out = operating(spark, sf_dir).select(*_OPERATING_COLUMNS, *_DELTAS, "delta_fp", "pr_auc_same")
    return _rounded(out, [*_RATES, *_DELTAS])


@query(
    "threshold_deltas",
    f"SELECT strategy, delta_precision, delta_recall, delta_f1, delta_f2, delta_fp FROM ({_OPERATING})",
    ("curve",),
)
def threshold_deltas(spark, sf_dir):
    return _rounded(operating(spark, sf_dir).select("strategy", *_DELTAS, "delta_fp"), _DELTAS)


@query(
    "operating_point_marks",
    f"""SELECT strategy, fp, recall, f1, row_number() OVER (ORDER BY fp, pos) = 1 AS min_fp, row_number() OVER (ORDER BY recall DESC, pos) = 1 AS max_recall,
       row_number() OVER (ORDER BY f1 DESC, pos) = 1 AS max_f1
FROM (SELECT *, CASE strategy WHEN 'f1_max' THEN 1 WHEN 'f2_max' THEN 2 ELSE 3 END AS pos FROM ({_OPERATING}))""",
    ("curve",),
)
def operating_point_marks(spark, sf_dir):
    from finsieve.operators.runs import mark_operating_points

    place = F.when(F.col("strategy") == "f1_max", 1).when(F.col("strategy") == "f2_max", 2).otherwise(3)
    points = _rounded(operating(spark, sf_dir).withColumn("position", place))
    return mark_operating_points(points).select("strategy", "fp", "recall", "f1", "min_fp", "max_recall", "max_f1")


_RUN_RATES = ["pr_auc", "roc_auc", "precision", "recall", "f1", "f2", "weighted_accuracy"]


@query(
    "reevaluate_runs",
    "SELECT r.run_id, m.split, " + ", ".join(f"round(m.{c}, 6) AS {c}" for c in _RUN_RATES)
    + """, m.tp, m.fp, m.tn, m.fn, round(CAST(CAST(m.tau / CAST(1000 AS DOUBLE) AS FLOAT) AS DOUBLE), 6) AS threshold
FROM run_at_tau m JOIN (SELECT run_no, concat(model, '__', strategy, '__', tag) AS run_id FROM runs) r ON m.run_no = r.run_no""",
    ("run_at_tau", "runs"),
)
def reevaluate_runs(spark, sf_dir):
    return _rounded(TH.reevaluate(T.run_scores(spark, sf_dir)).drop("criterion"))
