import hashlib
import random

import pytest
from pyspark.sql import functions as F

from finsieve.operators.ordering import (
    chunk_positions,
    draw_exact,
    prefix_sums,
    row_chunk,
    take_first,
    value_bucket,
    value_bucket,
    with_global_position,
)


def test_global_position_with_one_heavy_value(spark):
    # a third of all rows share the leading key
    rows = [(7 if i % 3 == 0 else i % 50, (i * 37) % 4001) for i in range(4001)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = with_global_position(df, ["a", "b"], partitions=7).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["row_idx"])] == sorted(rows)
    assert sorted(r["row_idx"] for r in got) == list(range(len(rows)))


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 999, 1000, 5000])
def test_take_first_is_exact(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "row_idx")
    got = sorted(r["row_idx"] for r in take_first(df, n, row_chunk("row_idx", 4), [F.col("row_idx")]).collect())
    assert got == list(range(min(n, 1000)))


def test_take_first_per_group(spark):
    df = spark.range(1000).select(F.col("id").alias("row_idx"), (F.col("id") % 3).cast("int").alias("g"))
    got = take_first(df, {0: 5, 1: 400, 2: 0}, row_chunk("row_idx", 3), [F.col("row_idx")], "g").collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append(r["row_idx"])
    assert sorted(by[0]) == [0, 3, 6, 9, 12]
    assert sorted(by[1]) == [i for i in range(1000) if i % 3 == 1]
    assert 2 not in by


def test_draw_follows_the_key_and_ignores_partitioning(spark):
    keys = sorted((hashlib.md5(f"9|{i}".encode()).hexdigest(), i) for i in range(3000))
    want = sorted(i for _, i in keys[:321])
    df = spark.range(3000).withColumnRenamed("id", "row_idx")
    for parts in (1, 6):
        assert sorted(r["row_idx"] for r in draw_exact(df.repartition(parts), 321, 9).collect()) == want


def test_value_bucket_keeps_order(spark):
    rng = random.Random(3)
    values = [0.0, 1.0, -1.0, 1e-30, -1e-30, 0.5, 123456.75] + [rng.uniform(-5, 5) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", value_bucket("v").alias("b")).collect()
    rows = sorted((r["v"], r["b"]) for r in rows)
    assert all(x[1] <= y[1] for x, y in zip(rows, rows[1:]))


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums(spark, descending):
    rng = random.Random(5)
    rows = [(k, round(rng.random() ** 4, 5), rng.randint(0, 9)) for k in "ab" for _ in range(400)]
    rows = list({(k, v): (k, v, n) for k, v, n in rows}.values())
    got = prefix_sums(spark.createDataFrame(rows, "k string, v double, n bigint"), ["k"], "v", ["n"], descending).collect()
    for key in "ab":
        total = 0
        mine = {r["v"]: r for r in got if r["k"] == key}
        everything = sum(n for k, _, n in rows if k == key)
        for _, v, n in sorted((r for r in rows if r[0] == key), key=lambda r: r[1], reverse=descending):
            total += n
            assert mine[v]["cum_n"] == total
            assert mine[v]["tot_n"] == everything


def test_chunk_positions(spark):
    df = spark.range(2000).filter("id % 7 in (1, 4)").withColumnRenamed("id", "row_idx")
    got = sorted((r["row_idx"], r["pos"]) for r in chunk_positions(df, bits=5).collect())
    assert [p for _, p in got] == list(range(len(got)))


def test_buckets_keep_the_order_of_all_numbers(spark):
    values = [float("-inf"), -1e300, -2.0, -1e-60, -5e-324, 0.0, 5e-324, 1e-310, 1e-60, 1e-10, 0.5, 1.0, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").withColumn("b", value_bucket("v"))
    buckets = [r["b"] for r in df.orderBy("i").collect()]
    assert buckets == sorted(buckets) and len(set(buckets)) == len(buckets)
    sums = prefix_sums(spark.createDataFrame([(v, 1) for v in values], "v double, n long"), [], "v", ["n"])
    assert [r["cum_n"] for r in sums.orderBy("v").collect()] == list(range(1, len(values) + 1))


def test_transactions_are_numbered_in_shares(spark, sf_dir, monkeypatch):
    """No task sorts more than a share of the line items, whatever number of partitions is set."""
    from finsieve.operators import ordering
    from finsieve.plans import tables as T

    n = T.read(spark, sf_dir, "lineitem").count()
    whole = T.numbered(spark, sf_dir)
    monkeypatch.setattr(ordering, "TASK_ROWS", -(-n // 9))
    made = T.numbered(spark, sf_dir)
    stored = made._jdf.queryExecution().logical().toString()
    assert "o_custkey" in stored and whole.exceptAll(made).count() == 0 == made.exceptAll(whole).count()
    plan = T.unnumbered(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 9), REPARTITION_BY_NUM") == 2
    # as many row numbers as rows, in the order of time
    assert made.agg(F.countDistinct("row_idx"), F.max("row_idx")).first() == (n, n - 1)
