"""Connected components of links between nodes, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (the smallest node of its component), for every node in ``links`` (a, b).

    Each round takes the least label among neighbours, then the label of that
    label; the minimum is taken within tasks before rows are shuffled, and Spark
    splits the join of a node with very many links.
    """
    pairs = links.select("a", "b").where("a <> b")
    both = pairs.union(pairs.select("b", "a")).distinct()
    # every node is its own neighbour, so that one aggregate sees its label and those around it
    near = scratch.staged(both.union(both.select("a", F.col("a").alias("b")).distinct()), "links")
    labels = near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    while True:
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("label")))
        lowered = near.join(labels, near.b == labels.node).groupBy("a").agg(own.alias("label"), F.min("label").alias("next"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        moved = scratch.staged(lowered.join(jump, lowered.next == jump.via).select(F.col("a").alias("node"), "label", F.least("next", "further").alias("next")), "labels")
        if moved.where("next <> label").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", F.col("next").alias("label"))
