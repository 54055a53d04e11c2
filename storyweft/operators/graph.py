"""Components of links between the rows of one round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from storyweft.sources.shared import removed, saved


def components(links: DataFrame, work: str) -> DataFrame:
    """links(u, v) of whole numbers -> node, component: the smallest number that links reach from each node that has a link.

    Every node takes the smallest label of its neighbours and of itself, then the label of its label, until nothing
    changes; labels halve their distance to the smallest one, so long chains need few rounds.  Minima are partial
    aggregates, so a node with many links is no hot group; nothing but a count of changes comes to the driver.
    """
    spark = links.sparkSession
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
    both = saved(both.distinct(), f"{work}/links")
    labels = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label"))
    labels, k = saved(labels, f"{work}/labels0"), 0
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["node"] == near["u"]).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = least.join(jump, "next", "left").select("node", F.col("label").alias("old"), F.least("next", F.coalesce("far", "next")).alias("label"))
        moved = saved(moved, f"{work}/labels{k + 1}")
        changed = moved.where("old <> label").limit(1).count()
        removed(spark, f"{work}/labels{k}")
        labels, k = moved.select("node", "label"), k + 1
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
