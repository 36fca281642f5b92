import random

import pytest
from pyspark.sql import functions as F

from finsieve.operators import sampling as S
from finsieve.operators.splitting import check_ratios, split_bounds

N_POS, N_NEG = 63_811, 123_182_778


def _scored(spark, n, n_pos, seed=7):
    rng = random.Random(seed)
    pos = set(rng.sample(range(n), n_pos))
    rows = [(i, int(i in pos), rng.betavariate(5, 2) if i in pos else rng.betavariate(2, 20)) for i in range(n)]
    return spark.createDataFrame(rows, "row_idx bigint, label int, score double").withColumn("score", F.col("score").cast("float"))


def test_negative_target():
    assert S.negative_target(1000, 0.01) == 99_000
    assert S.negative_target(500, 0.005) == 99_500
    assert S.negative_target(100, 0.001) == 99_900
    with pytest.raises(ValueError):
        S.negative_target(0, 0.01)
    with pytest.raises(ValueError):
        S.negative_target(10, 1.0)


def test_published_sizes():
    assert split_bounds(176_066_557) == (123_246_589, 123_246_589 + 26_409_984)
    for p, rows in ((0.01, 6_381_099), (0.005, 12_762_200), (0.001, 63_811_000)):
        assert N_POS + S.undersample_target(N_POS, p) == rows
    for p, n in ((0.01, 1_180_459), (0.005, 555_197), (0.001, 59_495)):
        assert S.oversample_budget(N_POS, N_NEG, p) == n
    for p, w in ((0.01, 99), (0.005, 199), (0.001, 999)):
        assert S.target_weights(p)[1] == pytest.approx(w)


def test_published_pools():
    for p, planned, hard, temporal, rest in (
        (0.001, 31_873_594, 1_276_220, 31_235_484, 31_235_485),
        (0.005, 6_349_194, 1_276_220, 5_711_084, 5_711_085),
        (0.01, 3_158_644, 1_276_220, 2_520_534, 2_520_535),
    ):
        b = S.pool_budgets(N_POS, N_NEG, p)
        assert (b["n_hard_planned"], b["n_hard"], b["n_temporal"], b["n_global"]) == (planned, hard, temporal, rest)


def test_oversampling_budget_is_of_the_full_table():
    assert [S.oversample_budget(N_POS, N_NEG, p) for p in (0.001, 0.005, 0.01)] == [59_495, 555_197, 1_180_459]


def test_ratio_checks():
    for bad in ((0, 0.1), (0.5, 0), (0.9, 0.1), (1.2, 0.1)):
        with pytest.raises(ValueError):
            check_ratios(*bad)


def test_hard_negatives_top_k(spark):
    df = spark.range(100).select((F.col("id") + 100).alias("row_idx"), F.col("id").cast("float").alias("score"))
    assert {r["row_idx"] for r in S.hard_negatives(df, 10).collect()} == set(range(190, 200))
    assert S.hard_negatives(df, 0).count() == 0
    assert S.hard_negatives(df, 1000).count() == 100


@pytest.mark.parametrize("n", [1, 50, 333, 334, 400, 999])
def test_hard_negatives_with_a_heavy_tie(spark, n):
    # a third of the rows has one score
    df = spark.range(1000).select(
        F.col("id").alias("row_idx"), F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.col("id") % 97) / 97).cast("float").alias("score")
    )
    rows = sorted(((-r["score"], r["row_idx"]) for r in df.collect()))
    assert {r["row_idx"] for r in S.hard_negatives(df, n).collect()} == {i for _, i in rows[:n]}


def test_temporal_blocks(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_idx")
    got = [r["row_idx"] for r in S.temporal_negatives(df, 100, 1000, 10).collect()]
    assert len(set(got)) == 100
    assert all(sum(1 for i in got if i // 100 == b) == 10 for b in range(10))


@pytest.mark.parametrize("n,size,blocks", [(104, 105, 20), (105, 105, 20), (7, 105, 20), (50, 13, 4), (13, 13, 20)])
def test_temporal_top_up(spark, n, size, blocks):
    df = spark.range(size).select((F.col("id") * 3).alias("row_idx"))
    got = [r["row_idx"] for r in S.temporal_negatives(df, n, size, blocks).collect()]
    assert len(got) == len(set(got)) == min(n, size)


def test_global_draw(spark):
    df = spark.range(10_000).withColumnRenamed("id", "row_idx")
    a = sorted(r["row_idx"] for r in S.global_negatives(df, 500).collect())
    b = sorted(r["row_idx"] for r in S.global_negatives(df.repartition(3), 500).collect())
    assert len(set(a)) == 500 and a == b
    assert 4000 < sum(a) / 500 < 6000


def test_selection_is_disjoint_and_reaches_the_target(spark):
    rows, counts = S.three_pool_selection(_scored(spark, 50_000, 100), 0.01, blocks=10)
    rows = rows.cache()
    assert S.pool_overlap(rows).count() == 0
    by = {r["pool"]: r["count"] for r in rows.groupBy("pool").count().collect()}
    assert by["positive"] == 100
    assert by["hard"] == counts["n_hard_actual"] and by["temporal"] == counts["n_temporal_actual"]
    total = sum(by.values())
    assert abs(100 / total - 0.01) < 0.005 and total == 100 + counts["n_total_neg_actual"]
    rows.unpersist()


def test_cap_moves_quota(spark):
    rows, c = S.three_pool_selection(_scored(spark, 200_000, 100, 11), 0.001, hard_cap_multiplier=5)
    assert c["n_hard_actual"] <= 500 < c["n_hard_planned"]
    plain = round(0.25 * c["n_neg_target"])
    assert c["n_temporal_actual"] + c["n_global_actual"] >= c["n_neg_target"] - c["n_hard_planned"]
    assert c["n_temporal_actual"] >= plain
    assert rows.count() == 100 + c["n_total_neg_actual"]


def test_selection_degenerate_and_invalid(spark):
    rows, c = S.three_pool_selection(_scored(spark, 500, 50), 0.001)
    assert c["n_hard"] == 450 and rows.filter("pool = 'hard'").count() == 450
    with pytest.raises(ValueError):
        S.three_pool_selection(spark.createDataFrame([(0, 1, None), (1, 0, 0.5)], "row_idx bigint, label int, score double"), 0.1)
    with pytest.raises(ValueError):
        S.three_pool_selection(spark.createDataFrame([(0, 0, 0.1)], "row_idx bigint, label int, score double"), 0.1)


def test_strategies_keep_or_draw(spark):
    df = _scored(spark, 5000, 50)
    assert S.random_undersampling(df, 0.001).rows.count() == 5000
    made = S.random_undersampling(df, 0.1)
    # 50 / (0.1 / 0.9) is a hair below 450 and truncates
    assert made.n_negative == 449 == made.rows.filter("label = 0").count()
    assert made.achieved_prevalence == pytest.approx(0.1, abs=1e-3)
    w = S.true_cost_weighting(df, 0.1)
    assert w.class_weight == {0: 1.0, 1: 99.0}
    assert {r["weight"] for r in w.rows.filter("label = 1").select("weight").distinct().collect()} == {99.0}
    with pytest.raises(ValueError):
        S.observed_weights(0, 10)


def test_align_and_subsample(spark):
    df = _scored(spark, 2000, 40)
    scores = df.select("row_idx", "score")
    assert S.align_scores(df.select("row_idx", "label"), scores).count() == 2000
    with pytest.raises(ValueError):
        S.align_scores(df, scores.filter("row_idx < 10"))
    with pytest.raises(ValueError):
        S.align_scores(df.select("row_idx"), scores.withColumn("row_idx", F.col("row_idx") + 1))
    sub = S.aligned_subsample(df, scores, 500).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in sub] == list(range(500))
    assert [r["orig_row_idx"] for r in sub] == sorted(r["orig_row_idx"] for r in sub)
    with pytest.raises(RuntimeError):
        S.aligned_subsample(df.withColumn("label", F.lit(0)), scores, 10)


def test_manifest_and_shuffle(spark):
    rows, c = S.three_pool_selection(_scored(spark, 5000, 20), 0.05)
    m = S.sampling_manifest(rows, 0.05, (0.5, 0.25, 0.25), 42, c, baseline_run_id="r").first()
    assert m["n_pos"] == 20 and m["baseline_run_id"] == "r"
    assert S.shuffled(rows, 43).count() == rows.count()


def test_hard_negatives_keep_double_precision(spark):
    rows = [(i, 0.5 + (i % 50) * 1e-12) for i in range(200)]
    frame = spark.createDataFrame(rows, "row_idx long, score double")
    best = sorted(rows, key=lambda r: (-r[1], r[0]))
    for n in (1, 6, 37, 200):
        assert {tuple(r) for r in S.hard_negatives(frame, n).collect()} == set(best[:n])


def test_pools_are_one_scan(spark):
    rows = [(i, int(i % 50 == 0), float((i * 7919) % 97) / 97) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_idx bigint, label int, score double")
    picked, counts = S.three_pool_selection(df, 0.1, seed=3)
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    got = {r["pool"]: r["count"] for r in picked.groupBy("pool").count().collect()}
    assert got == {"positive": 60, "hard": counts["n_hard_actual"], "temporal": counts["n_temporal_actual"], "global": counts["n_global_actual"]}
