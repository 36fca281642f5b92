"""Lookups with one key on half of the rows, and fits with weights."""

import pytest
from pyspark.sql import functions as F

from finsieve.operators import models as M
from finsieve.operators.joins import lookup
from finsieve.session import materialize


@pytest.mark.parametrize("broadcast_rows,hot_rows", [(1000, 10), (0, 100), (0, 10**6)])
def test_lookup_with_a_hot_key(spark, broadcast_rows, hot_rows):
    rows = [(i, "hot" if i % 2 else (None if i % 10 == 0 else f"k{i % 37}")) for i in range(2000)]
    df = materialize(spark.createDataFrame(rows, "id long, account string"), "rows")
    table = materialize(spark.createDataFrame([("hot", 7), *[(f"k{i}", i) for i in range(30)]], "acc string, kind int"), "kinds")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookup(df, table, "account", "acc", broadcast_rows=broadcast_rows, hot_rows=hot_rows)
        got = {r["id"]: r["kind"] for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
        # without adaptive execution, the hot half passes no shuffle
        dealt = found.filter("account = 'hot'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    kind = {"hot": 7} | {f"k{i}": i for i in range(30)}
    assert got == {i: kind.get(k) for i, k in rows} and found.columns == ["id", "account", "kind"]
    if broadcast_rows or hot_rows < 1000:
        assert "BroadcastHashJoin" in plan and dealt < 1000
    if broadcast_rows:
        assert "SortMergeJoin" not in plan


def test_weights_raise_the_scores_of_positives(spark):
    rows = [(i, int(i % 40 == 0), float(i % 7 + 3 * (i % 40 == 0)), float(i % 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_idx long, label int, a double, b double").withColumn("split", F.lit("val"))
    mean = {}
    for name, weight in (("plain", 1.0), ("weighted", 39.0)):
        train = df.withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0))
        fitted = M.fit(train, "random_forest", 1, features=["a", "b"], numTrees=5, maxDepth=3)
        mean[name] = M.score(fitted, df, features=["a", "b"]).agg(F.avg("score")).first()[0]
    assert mean["weighted"] > 3 * mean["plain"]


def test_a_fit_reads_few_partitions(spark, monkeypatch):
    """Small scans give many partitions; each would send sums for every open node of a fit."""
    class Seen:
        def fit(self, rows):
            return rows

    monkeypatch.setattr(M, "get_model", lambda *a, **k: Seen())
    df = spark.range(4000).repartition(60).select(F.lit(1).alias("label"), F.col("id").cast("double").alias("a"))
    seen = M.fit(df, "random_forest", features=["a"])
    assert seen.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and seen.count() == 4000
    monkeypatch.setattr(M, "FIT_ROWS", 200)
    assert M.fit(df, "random_forest", features=["a"]).rdd.getNumPartitions() == 20
