"""Connected components by minimum labels with pointer jumping, on Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import durable


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` for every node of ``links``; the label is the smallest node reachable.

    Each round takes the smallest label among the neighbours, then the label of
    that label (pointer jumping), so rounds grow with the logarithm of the longest
    chain. Labels only fall, and the loop ends when no label falls any more.
    Neighbour minima are partial aggregates, so a hub is not gathered anywhere.
    """
    both = durable(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(
        links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    labels = durable(both.groupBy(F.col("u").alias("node"))
                     .agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        seen = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("m"))
        low = labels.join(seen, labels.node == seen.u).select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("low"))
        up = labels.select(F.col("node").alias("of"), F.col("label").alias("of_label"))
        step = durable(low.join(up, F.col("low") == F.col("of"), "left").select(
            "node", "old", F.least("low", F.coalesce("of_label", "low")).alias("label")))
        moved = step.where("label < old").limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            return labels
