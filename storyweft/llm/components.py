"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from storyweft.llm.common import dropped, saved


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs(u, v) with m, the smallest v of each u.  The minimum is a partial aggregate, so a node with many links is no hot group."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")


def connected(links: DataFrame, work: str) -> DataFrame:
    """links(u, v) -> node, component: the smallest node that is reachable, for every node with a link to another."""
    spark = links.sparkSession
    kept = saved(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{work}/links0")
    sign, step = None, 0
    while True:
        both = kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", F.col("u")).alias("v"))
        near = _with_least(large.where("u <> v").distinct())
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        step += 1
        last, kept = f"{work}/links{step - 1}", saved(small, f"{work}/links{step}")
        now = tuple(kept.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first())
        dropped(spark, last)
        if now == sign:
            break
        sign = now
    named = kept.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionByName(kept.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
