"""Connected components of many graphs at once, each of an image or another key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.session import durable


def components(edges: DataFrame, key: str) -> DataFrame:
    """key, node, root: of each node with an edge (key, a, b) the least node of its component.

    Labels spread along edges and jump to their label's label, so that rounds grow with the logarithm of the
    longest way and not with the way. Loops alone make no component.
    """
    both = durable(edges.select(key, "a", "b").unionByName(edges.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = both.groupBy(key, "a").agg(F.min("b").alias("m")).select(key, F.col("a").alias("node"), F.least("a", "m").alias("root"))
    while True:
        labels = durable(labels)
        near = both.join(labels.select(key, F.col("node").alias("b"), "root"), [key, "b"]).groupBy(key, "a").agg(F.min("root").alias("m"))
        spread = labels.join(near.withColumnRenamed("a", "node"), [key, "node"]).select(key, "node", F.col("root").alias("old"), F.least("root", "m").alias("new"))
        # what a label's own node is told now holds for all that carry the label
        told = spread.groupBy(key, "old").agg(F.min("new").alias("low"))
        hooked = spread.join(told, [key, "old"]).select(key, "node", "old", F.least("new", "low").alias("new"))
        jump = hooked.select(key, F.col("node").alias("new"), F.col("new").alias("to"))
        moved = durable(hooked.join(jump, [key, "new"]).select(key, "node", F.least("new", "to").alias("root"), "old"))
        labels = moved.select(key, "node", "root")
        if moved.where("root != old").isEmpty():
            return labels
