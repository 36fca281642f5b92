"""Connected components of links, without a driver-side or one-task step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a``, ``b``); nodes are linked iff labels are equal.

    Every node takes the smallest label among its neighbours, then the label of
    its label, until nothing changes; each round is a stored table.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.filter("a <> b").distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        offered = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("offer"))
        lower = labels.join(offered, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        lower = materialize(lower, "labels-lower")
        jump = lower.select(F.col("node").alias("at"), F.col("label").alias("further"))
        # a label is a node itself
        after = lower.join(jump, F.col("label") == F.col("at")).select("node", "old", F.least("label", "further").alias("label"))
        after = materialize(after, "labels")
        labels = after.select("node", "label")
        if after.filter("label <> old").isEmpty():
            return labels
