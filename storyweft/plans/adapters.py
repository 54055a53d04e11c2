"""Logical news tables over the star-schema tables: articles, stories, sources and their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The instant that queries over the fixed tables are evaluated at.
AS_OF = "2024-01-31 00:00:00"


def as_of(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def hours_between(later: Column, earlier: Column) -> Column:
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(3.6e9)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coverage_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, story_id, source_id, published_at, article_type, from the click stream."""
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("article_id"),
        F.col("user_id").alias("story_id"),
        (F.get_json_object("props", "$.k").cast("int") % 7).alias("source_id"),
        F.col("ts").alias("published_at"),
        F.when(kind == "click", "FACT").when(kind == "view", "INTERPRETATION").when(kind == "purchase", "COMMENTARY").when(kind == "signup", "OPINION").alias("article_type"),
    )


ARTICLES_SQL = """a AS (SELECT event_id AS article_id, user_id AS story_id, CAST(json_extract_string(props, '$.k') AS INT) % 7 AS source_id, ts AS published_at,
  CASE event_type WHEN 'click' THEN 'FACT' WHEN 'view' THEN 'INTERPRETATION' WHEN 'purchase' THEN 'COMMENTARY' WHEN 'signup' THEN 'OPINION' END AS article_type FROM events)"""


def coverage_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """story_id, title: the documents that stories are named after."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("story_id"), F.substring("text", 1, 120).alias("title"))


def coverage_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("source"))


def titled_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, summary, source, language, published_at, from the documents; one every hour back from AS_OF, over 30 days."""
    at = as_of() - F.make_dt_interval(F.lit(0), (F.col("doc_id") % 720).cast("int"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 120).alias("title"), F.substring("text", 121, 2000).alias("summary"), "source", F.col("lang").alias("language"), at.alias("published_at"))


TITLED_SQL = """d AS (SELECT doc_id AS id, substr(text, 1, 120) AS title, substr(text, 121, 2000) AS summary, source, lang AS language,
  TIMESTAMP '2024-01-31 00:00:00' - to_hours(CAST(doc_id % 720 AS INT)) AS published_at FROM documents)"""


def embedded_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """titled_articles with embedding and story_id (the label of the vector of the same id)."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("story_id"))
    return titled_articles(spark, sf_dir).join(e, "id")


EMBEDDED_SQL = TITLED_SQL + ", v AS (SELECT d.*, e.embedding, e.label AS story_id FROM d JOIN embeddings e ON e.vec_id = d.id)"
