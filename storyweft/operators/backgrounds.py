"""A background image for each story of a page, different ones as long as there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from storyweft.functions.text import fnv1a

#: The categories, how their files are named, and how many files of which category each pool has, in order.
FILES = {"Crime": "Crime", "Economy": "Economy", "Geopolitics": "Geopolitics", "Politics": "politics", "Sports": "Sports", "Technology": "Technology", "General": "general"}
GENERAL_POOL = {"General": 5, "Crime": 3, "Economy": 2, "Geopolitics": 2, "Politics": 1, "Sports": 1, "Technology": 1}
POOLS = {c: {c: 5, "General": 5} if c != "General" else GENERAL_POOL for c in FILES}


def pool_of(category: str) -> list[str]:
    return [f"/event-bg/{c}/{FILES[c]}{k:02}.jpg" for c, n in POOLS[category].items() for k in range(1, n + 1)]


def category_of(raw: Column) -> Column:
    """A category in any case; General for all else."""
    out = F.lit("General")
    for c in FILES:
        out = F.when(F.lower(raw) == c.lower(), c).otherwise(out)
    return out


def _slot(mask: Column) -> Column:
    """Where a story goes, given a mask of its category's taken images: its base, else the next free one by steps, else its base."""
    free = lambda at: mask.bitwiseAND(F.pow(F.lit(2.0), at).cast("long")) == 0
    tries = F.transform(F.sequence(F.lit(0).cast("long"), F.col("size")), lambda i: (F.col("base") + F.col("step") * i) % F.col("size"))
    return F.coalesce(F.get(F.filter(tries, free), F.lit(0)), F.col("base"))


def assigned_backgrounds(stories: DataFrame, day: str, rounds: int = 64) -> DataFrame:
    """stories(story_id, category, place) -> story_id, category, place, background, in order of place; day is YYYY-MM-DD.

    A story takes the image at its hash, or, where an earlier story of the category has it, the first free one of its
    second hash's steps.  That is a fold over each category, but what it carries is a mask of at most fifteen images,
    which changes at most fifteen times: a round finds, by a partial minimum, each category's next story that takes a new
    image, so a category of any size is no group, and the changes are a table of at most fifteen rows a category.
    Ties of place go to the smaller story_id.
    """
    spark = stories.sparkSession
    key = F.concat_ws(":", F.lit(day), "category", F.col("story_id").cast("string"))
    pools = F.create_map(*[x for c in FILES for x in (F.lit(c), F.array(*map(F.lit, pool_of(c))))])
    rows = stories.select("story_id", category_of(F.col("category")).alias("category"), "place").withColumn("pool", F.element_at(pools, F.col("category"))).withColumn("size", F.size("pool").cast("long"))
    rows = rows.withColumn("base", fnv1a(key) % F.col("size")).withColumn("step", 1 + fnv1a(F.concat(F.lit("step:"), key)) % (F.col("size") - 1))
    rows = rows.withColumn("at", F.struct(F.col("place").cast("long").alias("place"), F.col("story_id").cast("long").alias("story_id")))
    schema = "category string, since struct<place: long, story_id: long>, mask long"
    changes = [(c, None, 0) for c in FILES]  # from the story after `since` on, the mask
    open_ = {c: (None, 0) for c in FILES}
    for _ in range(rounds):
        now = F.broadcast(spark.createDataFrame([(c, *x) for c, x in open_.items()], schema))
        left = rows.join(now, "category").where(F.col("since").isNull() | (F.col("at") > F.col("since"))).withColumn("slot", _slot(F.col("mask")))
        taking = left.where(F.col("mask").bitwiseAND(F.pow(F.lit(2.0), F.col("slot")).cast("long")) == 0)
        found = taking.groupBy("category").agg(F.min(F.struct("at", "slot", "mask")).alias("f")).collect()  # a row a category
        if not found:
            break
        open_ = {r["category"]: (tuple(r["f"]["at"]), r["f"]["mask"] | 1 << r["f"]["slot"]) for r in found}
        changes += [(c, *x) for c, x in open_.items()]
    # a story sees the last change before it
    lists = F.broadcast(spark.createDataFrame([(c, [x[1:] for x in changes if x[0] == c]) for c in FILES], "category string, changes array<struct<since: struct<place: long, story_id: long>, mask: long>>"))
    before = F.filter("changes", lambda x: x["since"].isNull() | (F.col("at") > x["since"]))
    seen = rows.join(lists, "category").withColumn("mask", F.element_at(before, -1)["mask"])
    return seen.select("story_id", "category", "place", F.element_at("pool", (_slot(F.col("mask")) + 1).cast("int")).alias("background"))
