"""Connected components of links between nodes, in rounds of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.shared import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is the smallest node reachable.

    Every round gives each node the smallest label next to it, then the label of that label, so a
    chain of n nodes takes about log n rounds. Labels are combined before each shuffle, and a
    node with very many links is split by adaptive execution.
    """
    edges = written(
        links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct().toDF("a", "b"), "edges"
    )
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n")).select(
        "node", F.least("node", "n").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node2")).agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("node2")).select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        # Where a label itself got a smaller one, take that.
        lower = written(lower, "labels")
        onward = lower.select(F.col("node").alias("node2"), F.col("label").alias("next"))
        jumped = lower.join(onward, F.col("label") == F.col("node2"), "left").select(
            "node", "was", F.least("label", "next").alias("label")
        )
        jumped = written(jumped, "labels")
        done = jumped.where("label != was").isEmpty()
        labels = jumped.select("node", "label")
        if done:
            return labels
