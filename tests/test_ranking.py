import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from finsieve.operators import ranking as R
from finsieve.operators import thresholds as T


def _scored(seed, n=400, digits=2):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        y = int(rng.random() < 0.15)
        out.append((round(min(1.0, max(0.0, rng.gauss(0.35 + 0.2 * y, 0.2))), digits), y))
    return out


def _brute(rows, t):
    tp = sum(1 for s, y in rows if s >= t and y)
    fp = sum(1 for s, y in rows if s >= t and not y)
    return tp, fp, sum(1 for s, y in rows if s < t and not y), sum(1 for s, y in rows if s < t and y)


def _ap_auc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    ap, before = 0.0, 0.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp, fp, _, _ = _brute(rows, t)
        ap += (tp / len(pos) - before) * tp / (tp + fp)
        before = tp / len(pos)
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return ap, wins / len(pos) / len(neg)


def _df(spark, rows):
    return spark.createDataFrame(rows, "score double, label int")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_record(spark, seed):
    rows = _scored(seed)
    m = R.metric_record(_df(spark, rows), [], 0.5).first()
    ap, auc = _ap_auc(rows)
    tp, fp, tn, fn = _brute(rows, 0.5)
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (tp, fp, tn, fn)
    assert m["pr_auc"] == pytest.approx(ap, abs=1e-12)
    assert m["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert m["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
    assert m["threshold"] == 0.5


def test_record_without_positives(spark):
    m = R.metric_record(_df(spark, [(0.1, 0), (0.9, 0)]), [], 0.5).first()
    assert m["pr_auc"] == 0.0 and m["roc_auc"] is None and m["weighted_accuracy"] == 0.5


def test_published_counts(spark):
    row = spark.createDataFrame([(4710, 47091, 26343207, 14976)], "tp bigint, fp bigint, tn bigint, fn bigint")
    m = row.select(*[e.alias(c) for c, e in R.threshold_metrics().items()]).first()
    assert m["precision"] == pytest.approx(0.0909249, abs=1e-7)
    assert m["recall"] == pytest.approx(0.2392563, abs=1e-7)
    assert m["f1"] == pytest.approx(0.1317722, abs=1e-7)
    assert m["weighted_accuracy"] == pytest.approx(0.6187360, abs=1e-7)


@pytest.mark.parametrize("criterion", T.CRITERIA)
def test_best_threshold(spark, criterion):
    rows = _scored(4)
    n_pos = sum(y for _, y in rows)

    def value(t):
        tp, fp, _, _ = _brute(rows, t)
        p, r = tp / (tp + fp), tp / n_pos
        if criterion == "f1":
            return round(2 * p * r / (p + r), 12) if p + r else 0.0
        return (r if p > 0 else -1) if criterion == "recall" else (p if r > 0 else -1)

    grid = sorted({s for s, _ in rows})
    best = max(value(t) for t in grid)
    want = min(t for t in grid if value(t) == best)
    assert T.best_threshold(_df(spark, rows), [], criterion).first()["threshold"] == want


def test_unknown_names_fail(spark):
    df = _df(spark, [(0.1, 0)])
    with pytest.raises(ValueError):
        T.best_threshold(df, [], "accuracy")
    with pytest.raises(ValueError):
        T.select_threshold(df, "best")


@pytest.mark.parametrize("parts", [1, 4, 7, 19, 250])
@pytest.mark.parametrize("n", [1, 2, 5, 97])
def test_even_quantiles(spark, parts, n):
    rng = random.Random(n)
    values = [round(rng.random(), 1) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r["quantile"] for r in R.even_quantiles(df, "v", parts).orderBy("j").collect()]
    assert got == pytest.approx(list(np.quantile(values, np.linspace(0, 1, parts + 1))), abs=1e-12)


@pytest.mark.parametrize("n_dense", [1000, 12])
def test_grid_confusion(spark, n_dense):
    rows = _scored(6, digits=3)
    df = _df(spark, rows)
    for r in T.confusion_on_grid(df, T.threshold_grid(df, n_dense)).collect():
        assert (r["tp"], r["fp"], r["tn"], r["fn"]) == _brute(rows, r["threshold"])


def test_precision_constraint_and_fallbacks(spark):
    def pick(rows, **kw):
        df = _df(spark, rows)
        return T.select_threshold(T.curve_points(R.score_groups(df, [])), "precision_constrained", **kw).first()

    rows = _scored(7)
    assert pick(rows)["selection"].startswith("max_f1")
    hard = pick([(0.9, 0), (0.5, 1), (0.2, 0), (0.1, 0)], min_precision=0.9)
    assert (hard["threshold"], hard["selection"]) == (0.5, "fallback_max_precision_with_nonzero_recall")
    none = pick([(0.9, 0), (0.2, 0)], min_precision=0.9)
    assert (none["threshold"], none["selection"]) == (0.5, "fallback_threshold_0_5")
    missed = pick([(0.9, 0), (0.8, 0), (0.2, 0)], min_precision=0.9)
    assert (missed["threshold"], missed["tp"], missed["fp"], missed["tn"], missed["fn"]) == (0.5, 0, 2, 1, 0)
    low = pick([(0.3, 0), (0.2, 0)], min_precision=0.9)
    assert (low["threshold"], low["fp"], low["tn"]) == (0.5, 0, 2)


def test_no_scores_give_the_last_resort(spark):
    points = T.curve_points(R.score_groups(_df(spark, []), []))
    for strategy in T.STRATEGIES:
        got = T.select_threshold(points, strategy).first()
        assert (got["threshold"], got["tp"], got["fp"], got["selection"]) == (0.5, 0, 0, "fallback_threshold_0_5")


def test_chosen_from_all_scores_however_many(spark):
    rng = random.Random(11)
    rows = [(rng.random(), int(rng.random() < 0.02)) for _ in range(12_000)]
    rows += [(0.97 + rng.random() / 100, 1) for _ in range(40)]
    got = T.select_threshold(T.curve_points(R.score_groups(_df(spark, rows), [])), "f1_max").first()
    pos, hits, best = sum(y for _, y in rows), 0, 0.0
    for n, (_, y) in enumerate(sorted(rows, reverse=True), 1):
        hits += y
        best = max(best, 2 * hits / (n + pos))
    assert got["f1"] == pytest.approx(best, abs=1e-12)


def test_operating_points_share_one_ranking(spark):
    val, test = _df(spark, _scored(8)), _df(spark, _scored(9))
    points = T.operating_points(val, test).collect()
    assert {r["strategy"] for r in points} == set(T.STRATEGIES)
    assert all(r["pr_auc_same"] for r in points)
    f1 = next(r for r in points if r["strategy"] == "f1_max")
    assert f1["delta_f1"] == 0 and f1["delta_fp"] == 0


def test_reevaluate_uses_validation_only(spark):
    rows = [("r1", s, y, sc) for s, seed in (("val", 1), ("test", 2)) for sc, y in _scored(seed)]
    rows += [("r2", s, y, sc) for s, seed in (("val", 3), ("test", 4)) for sc, y in _scored(seed)]
    df = spark.createDataFrame(rows, "run_id string, split string, label int, score double")
    got = {(r["run_id"], r["split"]): r for r in T.reevaluate(df).collect()}
    for run, seed in (("r1", 1), ("r2", 3)):
        want = T.best_threshold(_df(spark, _scored(seed)), []).first()["threshold"]
        assert got[run, "val"]["threshold"] == got[run, "test"]["threshold"] == want
    m = got["r2", "test"]
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == _brute(_scored(4), m["threshold"])


def test_scores_keep_their_precision(spark):
    df = spark.range(10).select((F.col("id") / 10).cast("float").alias("score"), (F.col("id") > 6).cast("int").alias("label"))
    best = T.best_threshold(df, []).first()
    assert best["threshold"] == pytest.approx(0.7, abs=1e-6) and best["f1"] == 1.0


def test_metrics_have_the_same_bits_in_any_order(spark):
    rows = _scored(9, 3000, 4)
    df = spark.createDataFrame([(run, s, y) for run in "ab" for s, y in rows], "run string, score double, label int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for partitions in (1, 8, 211):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            for r in R.metric_record(df.repartition(partitions), ["run"], 0.5).collect():
                seen.add((r["pr_auc"].hex(), r["roc_auc"].hex()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(seen) == 1 and float.fromhex(next(iter(seen))[0]) == pytest.approx(_ap_auc(rows)[0], abs=1e-12)


def test_exact_sums_of_large_and_tiny_numbers(spark):
    values = [1e9 + 0.1, 2.0**-40, 0.0, 123456.789, 1e-12, 0.7] * 50
    df = spark.createDataFrame([(v,) for v in values], "v double").agg(*R.exact_sums(F.col("v"), "x")).select(R.exact_total("x").alias("t"))
    assert df.first()["t"] == pytest.approx(sum(values), rel=1e-15)
    assert spark.createDataFrame([], "v double").agg(*R.exact_sums(F.col("v"), "x")).select(R.exact_total("x").alias("t")).first()["t"] is None
