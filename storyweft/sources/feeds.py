"""Feed entries from RSS and Atom files, by Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from storyweft.operators.store import first_of, insert_ignore

#: An RSS item or an Atom entry; an Atom link is an attribute, and there may be several.
ITEM = "title STRING, link ARRAY<STRUCT<_VALUE: STRING, _href: STRING, _rel: STRING>>, description STRING, summary STRING, content STRING, pubDate STRING, published STRING, updated STRING, _corrupt_record STRING"
#: RFC 2822 with a zone name or offset, then ISO.
FORMATS = ("EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss")


def published(text: Column) -> Column:
    """The first format that parses, in UTC without zone; else null."""
    bare = F.regexp_replace(text, "^[A-Za-z]{3}, ", "")  # Spark's parser does not read day names
    formats = [f.removeprefix("EEE, ") for f in FORMATS]
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def read_feed(spark: SparkSession, path: str, row_tag: str = "item", limit: int = 50) -> DataFrame:
    """The first `limit` entries of every feed file: feed, position, title, url, summary, published_at, broken.

    row_tag is item for RSS and entry for Atom.  A feed is one document, so files are read whole (multiLine) and the
    order of its entries is theirs.  Of an Atom entry's links the alternate one counts, else the first.
    """
    rows = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").option("multiLine", True).schema(ITEM).load(path)
    rows = rows.select(F.input_file_name().alias("feed"), F.monotonically_increasing_id().alias("at"), "*")
    page = F.filter("link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    first = F.coalesce(F.get(page, F.lit(0)), F.get("link", F.lit(0)))
    url = F.trim(F.coalesce(first["_href"], first["_VALUE"]))
    summary = F.trim(F.coalesce("description", "summary", "content", F.lit("")))
    at = F.coalesce(*[published(F.col(c)) for c in ("pubDate", "published", "updated")])
    broken = F.col("_corrupt_record").isNotNull() | (F.col("title").isNull() & F.col("link").isNull())
    out = rows.select("feed", "at", F.trim("title").alias("title"), url.alias("url"), summary.alias("summary"), at.alias("published_at"), broken.alias("broken"))
    return out.withColumn("position", F.row_number().over(W.partitionBy("feed").orderBy("at"))).where(F.col("position") <= limit).drop("at")


def new_entries(entries: DataFrame, known: DataFrame) -> DataFrame:
    """entries(url, position, ...) without repeats in the batch (on the whole url) and without known urls (cut to 1000)."""
    once = first_of(entries, "url", F.col("position"))
    cut = once.withColumn("url", F.substring("url", 1, 1000)).withColumn("title", F.substring("title", 1, 500)).withColumn("summary", F.substring("summary", 1, 2000))
    return insert_ignore(first_of(cut, "url", F.col("position")), known, "url")


def feed_health(entries: DataFrame, fetches: DataFrame | None = None) -> DataFrame:
    """Per feed, entries and broken ones; a broken feed does not stop the others.

    fetches(feed, http_status, error) are the attempts to fetch: their feeds come too, with status FAILED where there was
    an error or a code of 400 or more, EMPTY where there is no entry, and OK otherwise.
    """
    per = entries.groupBy("feed").agg(F.count("*").alias("entries"), F.count_if("broken").alias("broken_entries"))
    if fetches is None:
        return per
    out = fetches.join(per, "feed", "left").fillna(0, ["entries", "broken_entries"])
    failed = F.col("error").isNotNull() | (F.coalesce("http_status", F.lit(0)) >= 400)
    return out.withColumn("status", F.when(failed, "FAILED").when(F.col("entries") == 0, "EMPTY").otherwise("OK"))
