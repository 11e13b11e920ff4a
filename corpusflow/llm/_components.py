"""Connected components of a graph given as links, by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, gathered, looked_up


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b), which are read twice: the smallest node that it reaches.

    Each round every node takes the smallest label among itself and its neighbours, then the label of that label, until nothing changes;
    labels only fall, so that comes. Labels and links stay distributed; each round is cut by checkpoint(). A node with very many neighbours
    and a label with very many nodes are split between tasks, and met by partial minima. Few links are one partition. Without links there are no rows.
    """
    n = links.count()
    both = gathered(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), n).distinct()
    both = gathered(checkpoint(both), n)
    labels = gathered(checkpoint(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component"))), n)
    while True:
        near = gathered(looked_up(both, labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near")), n)
        low = gathered(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "near").alias("low"), F.col("component").alias("was")), n)
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("next"))
        before = labels.select(F.col("component").alias("low"))  # a label of many nodes had many before
        moved = gathered(checkpoint(looked_up(low, jump, "low", before).select("node", F.least("low", "next").alias("component"), "was")), n)
        labels = moved.select("node", "component")
        if moved.where("component <> was").isEmpty():
            return labels
