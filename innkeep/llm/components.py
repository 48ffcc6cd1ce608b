"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.llm.common import materialize


def min_label_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected ``edges`` (u, v): the
    label is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours, then replaces
    labels by their own labels (pointer jumping), so long chains take a number
    of rounds that grows with the logarithm of their length.  Labels are a
    checkpointed table after each round; the driver sees one count.  Joins
    keep the table that can be hot on a key (edges, labels) against one with
    unique keys read back from a checkpoint, which Spark can split."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = materialize(both)
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("v"), "label"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("label").alias("_near")))
        step = materialize(labels.join(near, "node").select(
            "node", F.least("label", "_near").alias("label"), F.col("label").alias("_old")))
        jump = step.join(step.select(F.col("node").alias("label"), F.col("label").alias("_next")), "label")
        after = materialize(jump.select("node", F.col("_next").alias("label"), (F.col("_next") != F.col("_old")).alias("_moved")))
        labels = after.select("node", "label")
        if not after.filter("_moved").head(1):
            return labels
