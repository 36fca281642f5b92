"""Queries on class balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from finsieve.operators import sampling as SM
from finsieve.plans import tables as T
from finsieve.plans.registry import query
from finsieve.session import materialize

# targets above the natural prevalence of the data, and one below
_TARGETS = (0.01, 0.02, 0.05, 0.001)
_SEED = 42


def _draw(source: str, n: str, seed: int = _SEED, key: str = "row_idx") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('{seed}|', CAST({key} AS VARCHAR))), {key}) AS rn FROM ({source})) WHERE rn <= {n}"""


@query(
    "strategy_baseline",
    "SELECT row_idx, label, CAST(1 AS DOUBLE) AS weight, 0 AS is_synthetic FROM train",
    ("train",),
)
def strategy_baseline(spark, sf_dir):
    return SM.baseline(T.train(spark, sf_dir), 0.01).rows.select("row_idx", "label", "weight", "is_synthetic")


_KEPT = "(SELECT CAST(trunc(n_pos / ({p}::DOUBLE / (1 - {p}::DOUBLE))) AS BIGINT) FROM classes)"


@query(
    "strategy_undersample",
    "SELECT CAST(0.02 AS DOUBLE) AS target, row_idx, label FROM train WHERE label = 1 UNION ALL SELECT 0.02, row_idx, label FROM ("
    + _draw("SELECT row_idx, label FROM train WHERE label = 0", _KEPT.format(p=0.02))
    + ") UNION ALL SELECT 0.001, row_idx, label FROM train",
    ("train", "classes"),
)
def strategy_undersample(spark, sf_dir):
    out = None
    for p in (0.02, 0.001):
        one = SM.random_undersampling(T.train(spark, sf_dir), p, _SEED).rows.select(F.lit(p).alias("target"), "row_idx", "label")
        out = one if out is None else out.unionByName(one)
    return out


def _targets_sql(body: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (SELECT CAST({p} AS DOUBLE) AS target, {body.format(p=f'{p}::DOUBLE')} FROM classes)" for p in _TARGETS)


_NATURAL = "n_pos / CAST(n_pos + n_neg AS DOUBLE)"


@query(
    "smote_budget",
    _targets_sql(f"CASE WHEN {{p}} <= {_NATURAL} THEN 0 ELSE CAST(trunc(n_neg * ({{p}} / (1 - {{p}})) - n_pos) AS BIGINT) END AS n_synthetic"),
    ("classes",),
)
def smote_budget(spark, sf_dir):
    n_pos, n_neg = SM.count_classes(T.train(spark, sf_dir))
    natural = n_pos / (n_pos + n_neg)
    rows = [(p, 0 if p <= natural else SM.oversample_budget(n_pos, n_neg, p)) for p in _TARGETS]
    return spark.createDataFrame(rows, "target double, n_synthetic bigint")


@query(
    "strategy_class_weight",
    "SELECT row_idx, label, CASE WHEN label = 1 THEN (1 - 0.02::DOUBLE) / 0.02::DOUBLE ELSE CAST(1 AS DOUBLE) END AS weight FROM train",
    ("train",),
)
def strategy_class_weight(spark, sf_dir):
    return SM.class_weighting(T.train(spark, sf_dir), 0.02).rows.select("row_idx", "label", "weight")


@query(
    "strategy_true_cost",
    "SELECT row_idx, label, CASE WHEN label = 1 THEN (SELECT CAST(n_neg AS DOUBLE) / n_pos FROM classes) ELSE CAST(1 AS DOUBLE) END AS weight FROM train",
    ("train", "classes"),
)
def strategy_true_cost(spark, sf_dir):
    return SM.true_cost_weighting(T.train(spark, sf_dir), 0.02).rows.select("row_idx", "label", "weight")


@query(
    "negative_target",
    _targets_sql("CAST(round_even(n_pos * (1 - {p}) / {p}, 0) AS BIGINT) AS n_negative"),
    ("classes",),
)
def negative_target(spark, sf_dir):
    n_pos, _ = SM.count_classes(T.train(spark, sf_dir))
    return spark.createDataFrame([(p, SM.negative_target(n_pos, p)) for p in _TARGETS], "target double, n_negative bigint")


_MULT = 5


def _plan_sql(p: str) -> str:
    """Pool sizes by the stated rules, for a table with ``n_pos`` and ``n_neg``."""
    return f"""SELECT CAST({p} AS DOUBLE) AS target, want AS n_neg_target, planned AS n_hard_planned, {_MULT} * n_pos AS n_hard_cap,
       hard AS n_hard, temporal + (planned - hard) // 2 AS n_temporal, want - planned - temporal + (planned - hard) - (planned - hard) // 2 AS n_global
FROM (SELECT *, least(planned, {_MULT} * n_pos, n_neg) AS hard FROM (
  SELECT *, CAST(round_even(0.5::DOUBLE * want, 0) AS BIGINT) AS planned, CAST(round_even(0.25::DOUBLE * want, 0) AS BIGINT) AS temporal FROM (
    SELECT *, CAST(round_even(n_pos * (1 - {p}::DOUBLE) / {p}::DOUBLE, 0) AS BIGINT) AS want FROM classes)))"""


@query("pool_budgets", " UNION ALL ".join(_plan_sql(str(p)) for p in _TARGETS), ("classes",))
def pool_budgets(spark, sf_dir):
    n_pos, n_neg = SM.count_classes(T.train(spark, sf_dir))
    rows = [{"target": p, **SM.pool_budgets(n_pos, n_neg, p, hard_cap_multiplier=_MULT)} for p in _TARGETS]
    ddl = "target double, n_neg_target bigint, n_hard_planned bigint, n_hard_cap bigint, n_hard bigint, n_temporal bigint, n_global bigint"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in ddl.split(", ")) for r in rows], ddl)


_P = 0.05
_N_HARD = f"(SELECT n_hard FROM ({_plan_sql(str(_P))}))"
_HARD = f"SELECT row_idx FROM (SELECT row_idx, row_number() OVER (ORDER BY score_milli DESC, row_idx) AS rn FROM train WHERE label = 0) WHERE rn <= {_N_HARD}"
_LEFT = f"SELECT row_idx FROM train WHERE label = 0 AND row_idx NOT IN ({_HARD})"
_BLOCKS = 20
_N_TEMPORAL = f"(SELECT n_temporal FROM ({_plan_sql(str(_P))}))"
_TEMPORAL = f"""SELECT row_idx FROM (
  SELECT row_idx, block, row_number() OVER (PARTITION BY block ORDER BY md5(concat('{_SEED}|', CAST(row_idx AS VARCHAR))), row_idx) AS rn FROM (
    SELECT row_idx, CAST(ceil((pos + 1) * CAST({_BLOCKS} AS DOUBLE) / n_left) AS BIGINT) - 1 AS block FROM (
      SELECT row_idx, row_number() OVER (ORDER BY row_idx) - 1 AS pos, count(*) OVER () AS n_left FROM ({_LEFT}))))
WHERE rn <= {_N_TEMPORAL} // {_BLOCKS} + CASE WHEN block < {_N_TEMPORAL} % {_BLOCKS} THEN 1 ELSE 0 END"""
_REST = f"SELECT row_idx FROM ({_LEFT}) WHERE row_idx NOT IN ({_TEMPORAL})"
_GLOBAL = "SELECT row_idx FROM (" + _draw(_REST, f"(SELECT n_global FROM ({_plan_sql(str(_P))}))", _SEED + 2) + ")"


def _scored_train(spark, sf_dir):
    return T.train(spark, sf_dir).select("row_idx", "label", "score")


def _hard_and_left(spark, sf_dir):
    scored = _scored_train(spark, sf_dir)
    n_pos, n_neg = SM.count_classes(scored)
    plan = SM.pool_budgets(n_pos, n_neg, _P, hard_cap_multiplier=_MULT)
    negatives = scored.filter("label = 0").select("row_idx", "score")
    hard = materialize(SM.hard_negatives(negatives, plan["n_hard"]).select("row_idx"), "pool-hard")
    return plan, hard, SM.without_rows(negatives.select("row_idx"), hard), n_neg - plan["n_hard"]


@query("hard_negatives", _HARD, ("train", "classes"))
def hard_negatives(spark, sf_dir):
    return _hard_and_left(spark, sf_dir)[1]


@query("remaining_negatives", _LEFT, ("train", "classes"))
def remaining_negatives(spark, sf_dir):
    return _hard_and_left(spark, sf_dir)[2]


@query("temporal_negatives", _TEMPORAL, ("train", "classes"))
def temporal_negatives(spark, sf_dir):
    plan, _, left, n_left = _hard_and_left(spark, sf_dir)
    return SM.temporal_negatives(left, plan["n_temporal"], n_left, _BLOCKS, _SEED)


@query("global_negatives", _draw("SELECT row_idx FROM train WHERE label = 0", "(SELECT count(*) // 10 FROM train WHERE label = 0)").replace("SELECT *", "SELECT row_idx", 1), ("train",))
def global_negatives(spark, sf_dir):
    negatives = T.train(spark, sf_dir).filter("label = 0").select("row_idx")
    return SM.global_negatives(negatives, negatives.count() // 10, _SEED)


@query(
    "three_pool_selection",
    f"""SELECT row_idx, 'positive' AS pool FROM train WHERE label = 1 UNION ALL SELECT row_idx, 'hard' FROM ({_HARD})
UNION ALL SELECT row_idx, 'temporal' FROM ({_TEMPORAL}) UNION ALL SELECT row_idx, 'global' FROM ({_GLOBAL})""",
    ("train", "classes"),
)
def three_pool_selection(spark, sf_dir):
    rows, _ = SM.three_pool_selection(_scored_train(spark, sf_dir), _P, hard_cap_multiplier=_MULT, seed=_SEED)
    return rows


@query(
    "pool_overlap",
    "SELECT row_idx, CAST(2 AS BIGINT) AS n_pools FROM train WHERE label = 1 AND payment_currency = 'CUR1'",
    ("train",),
)
def pool_overlap(spark, sf_dir):
    # a selection spoilt on purpose: some positives are listed in a second pool
    rows, _ = SM.three_pool_selection(_scored_train(spark, sf_dir), _P, hard_cap_multiplier=_MULT, seed=_SEED)
    again = T.train(spark, sf_dir).filter("label = 1 AND payment_currency = 'CUR1'").select("row_idx", F.lit("hard").alias("pool"))
    return SM.pool_overlap(rows.unionByName(again))


@query(
    "cap_analysis",
    " UNION ALL ".join(
        f"""SELECT target, n_hard_planned, n_hard AS n_hard_actual, n_temporal AS n_temporal_actual, n_global AS n_global_actual,
       round(CAST(n_hard AS DOUBLE) / n_hard_planned, 6) AS cap_utilization,
       round(CAST(n_hard AS DOUBLE) / (n_hard + n_temporal + n_global), 6) AS effective_hard_share FROM ({_plan_sql(str(p))})"""
        for p in _TARGETS[:3]
    ),
    ("classes",),
)
def cap_analysis(spark, sf_dir):
    from finsieve.operators.runs import cap_analysis as analyse

    n_pos, n_neg = SM.count_classes(T.train(spark, sf_dir))
    rows = []
    for p in _TARGETS[:3]:
        b = SM.pool_budgets(n_pos, n_neg, p, hard_cap_multiplier=_MULT)
        rows.append((p, b["n_hard_planned"], b["n_hard"], b["n_temporal"], b["n_global"]))
    counts = spark.createDataFrame(
        rows, "target double, n_hard_planned bigint, n_hard_actual bigint, n_temporal_actual bigint, n_global_actual bigint"
    )
    return analyse(counts).withColumns({c: F.round(c, 6) for c in ("cap_utilization", "effective_hard_share")})


@query(
    "align_scores",
    "SELECT row_idx, label, score_milli FROM train",
    ("train",),
)
def align_scores(spark, sf_dir):
    t = T.train(spark, sf_dir)
    joined = SM.align_scores(t.select("row_idx", "label"), t.select("row_idx", "score"))
    return joined.select("row_idx", "label", F.round(F.col("score").cast("double") * 1000).cast("bigint").alias("score_milli"))


@query(
    "aligned_subsample",
    "SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, row_idx AS orig_row_idx, label, score_milli FROM ("
    + _draw("SELECT row_idx, label, score_milli FROM train", "(SELECT count(*) // 4 FROM train)")
    + ")",
    ("train",),
)
def aligned_subsample(spark, sf_dir):
    t = T.train(spark, sf_dir)
    sub = SM.aligned_subsample(t, t.select("row_idx", "score"), t.count() // 4, _SEED)
    return sub.select("row_idx", "orig_row_idx", "label", F.round(F.col("score").cast("double") * 1000).cast("bigint").alias("score_milli"))
