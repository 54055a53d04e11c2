"""Lists and cached output for readers: sources, articles, stories, latest model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy("source_id")


def list_articles(articles: DataFrame, limit: int = 20) -> DataFrame:
    """The newest ids first."""
    return articles.orderBy(F.col("article_id").desc()).limit(max(1, limit))


def list_stories(stories: DataFrame, links: DataFrame, limit: int | None = None) -> DataFrame:
    """Stories with the number of their articles, also those without any."""
    per = links.groupBy("story_id").agg(F.count("*").alias("articles_count"))
    out = stories.join(per, "story_id", "left").withColumn("articles_count", F.coalesce("articles_count", F.lit(0))).orderBy(F.col("story_id").desc())
    return out.limit(limit) if limit else out


def latest_output(stories: DataFrame, cache: DataFrame) -> DataFrame:
    """Each story's latest cached output; MISSING where there is none.  cache(story_id, status, output_json, error, updated_at)."""
    last = cache.groupBy("story_id").agg(F.max_by(F.struct("status", "output_json", "error", "updated_at"), F.struct("updated_at", "status")).alias("c"))
    return stories.select("story_id").join(last, "story_id", "left").select("story_id", F.coalesce("c.status", F.lit("MISSING")).alias("status"), "c.output_json", "c.error", "c.updated_at")


def open_stories(stories: DataFrame, since: Column) -> DataFrame:
    """stories(story_id, end_time, created_at) without an end or with one that is not before `since`, newest first."""
    return stories.where(F.col("end_time").isNull() | (F.col("end_time") >= since)).orderBy(F.coalesce("end_time", "created_at").desc(), F.col("story_id").desc())
