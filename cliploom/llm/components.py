"""Connected components of links, by rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import stash


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of `links` (a, b); root is the least node of its component.

    Each round takes the least label among a node and its neighbours, then the label of that label; the driver
    sees only how many labels changed. Stars, as the operators here make, end after two or three rounds.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = stash(both, "links")
    labels = stash(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "near").alias("via"), F.col("root").alias("old"))
        jumps = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        moved = stash(lower.join(jumps, "via", "left").select("node", F.least("via", F.coalesce("far", "via")).alias("root"), "old"), "labels")
        labels = moved.select("node", "root")
        if moved.where("root != old").limit(1).count() == 0:
            return labels
