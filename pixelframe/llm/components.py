"""Connected components of an undirected graph whose nodes are integers, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component: the smallest node that it reaches.

    Each round takes the least label among a node's neighbours and then the label of that label, so labels
    travel twice as far with every round. Counts and least values are aggregated before they are shuffled.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a is not null and b is not null and a <> b").distinct()
    edges = written(both, "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("least"))
        low = written(
            labels.join(near, labels.node == near.a, "left").select(
                "node", F.col("label").alias("old"), F.least("label", F.coalesce("least", "label")).alias("label")
            ),
            "labels",
        )
        head = low.select(F.col("node").alias("head"), F.col("label").alias("further"))
        jumped = low.join(head, low.label == head["head"], "left").select(
            "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")
        )
        new = written(jumped, "labels")
        done = not new.filter("label < old").limit(1).count()
        dropped(labels, low)
        labels = new.select("node", "label")
        if done:
            dropped(edges)
            return labels.select("node", F.col("label").alias("component"))
