"""X17 as a stream: every micro-batch of new articles is assigned to stories, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from storyweft.operators.clustering import cluster
from storyweft.operators.coverage import touch_window
from storyweft.operators.store import insert_ignore
from storyweft.sources.shared import noted_dirs, removed, saved, shared_dir
from storyweft.sources.tablestore import Change, Snapshot, TableStore
from storyweft.streaming.ingest import run_available

ARTICLES = "id long, title string, published_at timestamp_ntz, embedding array<double>"
LINKS = "article_id long, story_id long"
STORIES = "story_id long, title string, status string, start_time timestamp_ntz, end_time timestamp_ntz"


def table_or_none(at: Snapshot, name: str, schema: str) -> DataFrame:
    return at.read(name) if name in at else at.store.spark.createDataFrame([], schema)


def assign_batch(store: TableStore, batch: DataFrame, number: int, stream: str = "articles", **options) -> Snapshot:
    """Adds the articles of batch that are not known yet (the first of an id), with their stories, to the store's tables.

    Articles, links and stories change together, in the version that also notes the number of the batch: a batch that was
    stopped before is done again from the same state, and one that was done is left alone.  Articles without a vector or
    a time are new stories.  Articles and links are appended; the table of stories is written anew.
    """

    def plan(at: Snapshot) -> Change:
        work = shared_dir(store.spark)
        articles, links, stories = table_or_none(at, "articles", ARTICLES), table_or_none(at, "links", LINKS), table_or_none(at, "stories", STORIES)
        names = [c.split()[0] for c in ARTICLES.split(", ")]
        new = batch.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("published_at", "title", "embedding")).alias("r")).select("id", "r.title", "r.published_at", "r.embedding")
        new = saved(insert_ignore(new, articles, "id").select(*names), f"{work}/new")
        done = saved(cluster(new, articles.select(*names).unionByName(new), links, stories, **options), f"{work}/done")
        begun = done.where("action = 'new'").join(new.withColumnRenamed("id", "article_id"), "article_id")
        begun = begun.select("story_id", "title", F.lit("active").alias("status"), F.col("published_at").alias("start_time"), F.col("published_at").alias("end_time"))
        all_ = stories.unionByName(begun)
        seen = done.join(new.select(F.col("id").alias("article_id"), "published_at"), "article_id").select("story_id", "published_at")
        all_ = all_.drop("start_time", "end_time").join(touch_window(all_, seen), "story_id")
        return {"articles": ("append", new), "links": ("append", done.select("article_id", "story_id")), "stories": ("replace", all_.select(*[c.split()[0] for c in STORIES.split(", ")]))}

    with noted_dirs() as made:
        done = store.change(plan, (stream, number))
    for path in made:
        removed(store.spark, path)
    return done


def assign_stream(rows: DataFrame, store: TableStore, checkpoint: str, stream: str = "articles", **options) -> None:
    """Assigns what a stream of articles (ARTICLES) has, batch after batch; the checkpoint and the store make a rerun go on from there."""
    run_available(rows, checkpoint, lambda batch, number: assign_batch(store, batch, number, stream, **options))
