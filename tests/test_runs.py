import random

import pytest
from pyspark.sql import functions as F

from finsieve.operators import models as M
from finsieve.operators import runs as R


def _board(spark, rows):
    names = "run_no int, run_id string, model string, strategy string, target_prevalence double, pr_auc_test double, recall_test double, recall_test_thresh double, precision_test_thresh double, f1_test_thresh double, f2_test_thresh double, tp_test_thresh bigint, fp_test_thresh bigint, roc_auc_test double, weighted_accuracy_test_thresh double, optimal_threshold double"
    full = [(i, f"{m}__{s}__{p}", m, s, p, auc, rec, rt, pr, f1, None, tp, fp, 0.9, 0.6, 0.4) for i, (m, s, p, auc, rec, rt, pr, f1, tp, fp) in enumerate(rows)]
    return spark.createDataFrame(full, names)


ROWS = [
    ("xgboost", "baseline", 0.01, 0.5, 0.1, 0.4, 0.3, 0.34, 40, 93),
    ("xgboost", "baseline", 0.001, 0.5, 0.1, 0.4, 0.3, 0.34, 40, 93),
    ("xgboost", "random_undersampling", 0.005, 0.45, 0.9, 0.5, 0.2, 0.29, 50, 200),
    ("xgboost", "random_undersampling", 0.01, 0.44, 0.9, 0.5, 0.19, 0.28, 50, 210),
    ("xgboost", "class_weighting", 0.01, 0.43, 0.8, 0.45, 0.25, 0.32, 45, 135),
    ("xgboost", "adasyn", 0.01, 0.40, 0.8, 0.3, 0.3, 0.3, 30, 70),
    ("xgboost", "adasyn", 0.005, 0.41, 0.8, 0.3, 0.3, 0.3, 30, 70),
    ("xgboost", "smote", 0.01, 0.30, 0.8, 0.2, 0.5, 0.29, 20, 20),
    ("xgboost", "smote", 0.001, 0.31, 0.8, 0.0, 0.0, 0.0, 0, 20),
    ("random_forest", "baseline", 0.01, 0.2, 0.8, 0.2, 0.2, 0.2, 20, 80),
]


def test_leaderboard_order(spark):
    board = _board(spark, ROWS)
    first = [r["run_id"] for r in R.top_runs(board, 3).orderBy("rank").collect()]
    assert first == ["xgboost__baseline__0.001", "xgboost__baseline__0.01", "xgboost__random_undersampling__0.005"]
    # recall at 0.5 decides when no run has a chosen threshold
    plain = board.withColumn("recall_test_thresh", F.lit(None).cast("double")).withColumn("pr_auc_test", F.lit(0.1))
    assert R.top_runs(plain, 1).first()["recall_test"] == 0.9


def test_anchors(spark):
    got = R.anchor_runs(_board(spark, ROWS)).orderBy("position").collect()
    assert [r["configuration"] for r in got] == [
        "xgboost baseline @p001 best_pr_auc",
        "xgboost random_undersampling @p005 f1_opt",
        "xgboost class_weighting @p010 f1_opt",
        "xgboost adasyn @p005 best_pr_auc",
        "xgboost smote @p001 best_pr_auc",
        "xgboost smote @p010 best_f1",
    ]
    assert got[4]["fp_per_tp"] is None


def test_missing_three_pool_run_fails(spark):
    with pytest.raises(ValueError):
        R.three_pool_rows(_board(spark, ROWS).filter("target_prevalence > 0.002"))


def test_pareto_front(spark):
    rows = [("a", 0.5, 0.5, 1.0), ("b", 0.5, 0.5, 1.0), ("c", 0.4, 0.5, 1.0), ("d", 0.9, 0.1, 9.0), ("e", 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "configuration string, recall double, precision double, fp_per_tp double")
    flags = {r["configuration"]: r["is_pareto"] for r in R.pareto_front(df).collect()}
    assert flags == {"a": True, "b": True, "c": False, "d": True, "e": False}


@pytest.mark.parametrize("free_cost", [False, True])
def test_pareto_front_equals_brute_force(spark, free_cost):
    draw = random.Random(7)
    goals = []
    for _ in range(400):
        p, r = draw.randint(0, 40) / 40, draw.randint(0, 20) / 20
        cost = draw.choice([None, 0.0, 1.0, 2.5, 7.0, 30.0]) if free_cost else (1 - p) / p if p else None
        goals.append((r, p, cost))
    # every third row has one recall, some rows repeat, some lack a number
    goals = [(0.5, p, c) if i % 3 == 0 else (r, p, c) for i, (r, p, c) in enumerate(goals)] + goals[:20]
    goals += [(None, 0.9, 1.0), (0.9, None, 1.0), (None, None, None)]
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(goals)], "row int, recall double, precision double, fp_per_tp double")
    flags = {x["row"]: x["is_pareto"] for x in R.pareto_front(df).collect()}
    assert len(flags) == len(goals)

    def beaten(a):
        own = (a[0], a[1], -(a[2] if a[2] is not None else float("inf")))
        for b in goals:
            if None not in (*a[:2], *b[:2]):
                other = (b[0], b[1], -(b[2] if b[2] is not None else float("inf")))
                if other != own and all(y >= x for x, y in zip(own, other, strict=True)):
                    return True
        return False

    assert flags == {i: not beaten(g) for i, g in enumerate(goals)}


def test_pareto_front_of_nothing(spark):
    df = spark.createDataFrame([], "configuration string, recall double, precision double, fp_per_tp double")
    assert R.pareto_front(df).count() == 0 and R.pareto_front(df).columns == [*df.columns, "is_pareto"]


def test_marks_go_to_the_first(spark):
    df = spark.createDataFrame([(1, 5, 0.5, 0.3), (2, 5, 0.6, 0.3), (3, 9, 0.6, 0.2)], "position int, fp int, recall double, f1 double")
    got = [(r["min_fp"], r["max_recall"], r["max_f1"]) for r in R.mark_operating_points(df).orderBy("position").collect()]
    assert got == [(True, False, True), (False, True, False), (False, False, False)]


def test_grid_and_resume(spark):
    grid = R.experiment_grid(spark)
    assert grid.count() == 30
    first = grid.orderBy("run_no").first()
    assert (first["strategy"], first["model"], first["run_id"]) == ("baseline", "random_forest", "random_forest__baseline__p010")
    done = spark.createDataFrame([("random_forest__baseline__p010__20260404_132609",), ("xgboost__smote__p001__1",)], "run_id string")
    left = {r["run_id"] for r in R.pending_cells(grid, done).collect()}
    assert len(left) == 28 and "xgboost__smote__p001" not in left


def test_invariance_and_tables(spark):
    board = _board(spark, ROWS)
    assert {r["model"]: r["identical"] for r in R.baseline_invariance(board).collect()} == {"xgboost": True, "random_forest": True}
    table = R.per_model_table(board).filter("model = 'xgboost'").orderBy("line").collect()
    assert [r["strategy"] for r in table] == ["baseline", "random_undersampling", "random_undersampling", "smote", "smote", "class_weighting"]
    assert table[0]["target_prevalence"] == 0.001
    assert R.main_results(board).filter("strategy = 'adasyn'").count() == 0
    with pytest.raises(ValueError):
        R.main_results(board.drop("tp_test_thresh"))


def test_smoke_runs_are_left_out(spark):
    board = _board(spark, ROWS).withColumn("is_smoke", F.col("run_no") == 0)
    assert R.filter_runs(board, strategy="baseline").count() == 2


def test_models(spark, tmp_path):
    df = spark.range(600).select(
        F.col("id").alias("row_idx"), F.lit("train").alias("split"), (F.col("id") % 5 == 0).cast("int").alias("label"),
        F.when(F.col("id") % 3 > 0, (F.col("id") % 5).cast("double")).alias("a"), (F.col("id") % 7).cast("double").alias("b"),
    )
    for name, small in (("random_forest", {"numTrees": 5, "maxDepth": 4}), ("xgboost", {"maxIter": 3, "maxDepth": 3})):
        model = M.fit(df.withColumn("weight", F.lit(1.0)), name, features=["a", "b"], **small)
        scored = M.score(model, df, features=["a", "b"])
        s = scored.agg(F.min("score").alias("a"), F.max("score").alias("b"), F.count("score").alias("n")).first()
        assert 0 <= s["a"] < s["b"] <= 1 and s["n"] == 600
        long = M.importances(model, {"run_id": "r", "model": name}, ["a", "b"]).collect()
        assert [r["feature"] for r in long] == ["a", "b"] and sum(r["importance"] for r in long) == pytest.approx(1)
        assert M.importances(model, {}, ["a"]) is None
    assert M.get_model("random_forest", n_rows=1_000_000).getSubsamplingRate() == 0.2
    assert M.get_model("boosted_trees").getMaxIter() == 200
    with pytest.raises(ValueError):
        M.get_model("svm")


def test_baseline_scores_are_kept(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("row_idx"), (F.col("id") % 4 == 0).cast("int").alias("label"), (F.col("id") % 4).cast("double").alias("a"))
    model = M.fit(df, "random_forest", features=["a"], numTrees=2, maxDepth=2)
    path = str(tmp_path / "scores")
    first = M.score(model, df, ("row_idx",), ["a"])
    from finsieve.sources.stored import save_scores

    save_scores(first, path)
    again = M.score_train(model, df, path)
    assert again.count() == 200 and again.columns == ["row_idx", "score"]
