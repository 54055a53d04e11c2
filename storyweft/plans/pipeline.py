"""The batch steps as plain composition of operators over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from storyweft.functions.vectors import embed
from storyweft.operators.clustering import cluster
from storyweft.operators.merging import merge_candidates, merge_judge
from storyweft.operators.store import upsert
from storyweft.sources.tablestore import Change, Snapshot, TableStore


def run_pipeline(state: dict[str, DataFrame], steps: list[tuple[str, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]], save: Callable[[str, DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Runs steps in order; each gives the tables it changes, which save (if given) writes and rereads.  An error stops the run."""
    for _, step in steps:
        for name, df in step(state).items():
            state = state | {name: save(name, df) if save else df}
    return state


@dataclass
class Step:
    """A step of run_steps(): plan gives the changes of tables for a state of the store; an incremental one only what lacks."""

    name: str
    plan: Callable[[Snapshot], Change]


def run_steps(store: TableStore, run: int, steps: list[Step], dry_run: bool = False, only: set[str] | None = None) -> list[tuple[str, str, dict[str, int]]]:
    """The steps in order -> (name, DONE, SKIPPED or DRY_RUN, rows by table) of each.

    A step's change and the note that it is done are one version of the store, so a run that was stopped goes on with
    the same number after the last finished step, and a finished one does nothing.  An error stops the run.  A dry run
    counts the rows that each step would write, without writing; steps that read what earlier ones would have written
    then see the tables as they are.  only names the steps to run.
    """
    out = []
    for step in steps:
        if only is not None and step.name not in only:
            continue
        rows: dict[str, int] = {}
        at = store.snapshot()
        if at.log["batches"].get(f"step:{step.name}", -1) >= run:
            out.append((step.name, "SKIPPED", rows))
            continue
        if dry_run:
            out.append((step.name, "DRY_RUN", {name: df.count() for name, (_, df) in step.plan(at).items()}))
            continue
        done = store.change(step.plan, (f"step:{step.name}", run))
        for name in done.log["tables"]:
            if name not in at or done.log["tables"][name] != at.log["tables"][name]:
                rows[name] = done.read(name).count() - (at.read(name).count() if name in at else 0)
        out.append((step.name, "DONE", rows))
    return out


def missing_embeddings(articles: DataFrame, embedded: DataFrame, text: Column, limit: int | None = None) -> DataFrame:
    """articles(id, published_at, ...) with hash, that of text, whose embedding(id, hash) is missing or is of another text; the newest `limit`."""
    due = articles.withColumn("hash", F.xxhash64(text)).where(F.coalesce(F.trim(text), F.lit("")) != "").join(embedded.select("id", "hash"), ["id", "hash"], "left_anti")
    return due if limit is None else due.orderBy(F.col("published_at").desc_nulls_last(), F.col("id").desc()).limit(limit)


def embedding_step(articles: Callable[[Snapshot], DataFrame], text: Callable[[DataFrame], Column], tokens: Callable[[Column], Column], limit: int | None = None, table: str = "embeddings", **options) -> Step:
    """The vectors of new and changed articles, in table (id, hash, embedding)."""

    def plan(at: Snapshot) -> Change:
        rows = articles(at)
        old = at.read(table) if table in at else at.store.spark.createDataFrame([], "id long, hash long, embedding array<float>")
        due = missing_embeddings(rows, old, text(rows), limit)
        made = embed(due, tokens(text(rows)), **options).join(due.select("id", "hash"), "id").select("id", "hash", "embedding")
        return {table: ("replace", upsert(old, made, ["id"]))} if table in at else {table: ("append", made)}

    return Step("embeddings", plan)


def rounds_for(left: int, per_round: int = 100, most: int = 30) -> int:
    """How many rounds to try at most for the articles that are left."""
    return min(most, -(-left // per_round) + 2)


def cluster_until_converged(articles: DataFrame, links: DataFrame, stories: DataFrame, newest: Callable[[DataFrame], DataFrame], save: Callable[[str, DataFrame], DataFrame], most_rounds: int | None = None, stagnant: int = 3, remaining: Callable[[DataFrame], int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rounds of cluster() until nothing is left, or `stagnant` rounds bring no change; links and stories afterwards.

    newest(links) gives a round's articles, remaining(links) how many are left in all (else those of a round count);
    there are at most most_rounds, else rounds_for() what is left at the start.
    """
    still, before, k = 0, None, 0
    while most_rounds is None or k < most_rounds:
        queries = newest(links)
        left = remaining(links) if remaining else queries.count()
        most_rounds = rounds_for(left) if most_rounds is None else most_rounds
        still = still + 1 if left == before else 0
        if not left or still >= stagnant:
            break
        before = left
        done = save(f"round{k}", cluster(queries, articles, links, stories))
        fresh = done.where("action = 'new'").join(queries.select(F.col("id").alias("article_id"), "title", "published_at"), "article_id")
        new = fresh.select("story_id", "title", F.lit("active").alias("status"), F.col("published_at").alias("end_time"))
        stories = save(f"stories{k}", stories.select(*new.columns).unionByName(new))
        links = save(f"links{k}", links.select("article_id", "story_id").unionByName(done.select("article_id", "story_id")))
        k += 1
    return links, stories


def run_merge_pipeline(stories: DataFrame, cache: DataFrame | None = None, **options) -> DataFrame:
    """Signatures are in stories; candidates, which are found at once, then their judgement."""
    return merge_judge(merge_candidates(stories, **options), cache)
