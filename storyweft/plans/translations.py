"""Translated titles of stories, kept by story and language, and made again where their source title changed."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from storyweft.operators.store import upsert
from storyweft.plans.models import model_answers
from storyweft.sources.shared import removed, saved, shared_dir
from storyweft.sources.tablestore import Change, Snapshot, TableStore

CACHE = "story_id long, lang string, prompt_version string, source_title string, translated_title string, status string, error string, updated_at timestamp_ntz"


def offline_translations(requests: list[dict]) -> list[str]:
    """Stands in for a translator: the title between brackets."""
    return [json.dumps({"title": f"[{r['titles'][0]}]"}, ensure_ascii=False) for r in requests]


def source_title(stories: DataFrame) -> Column:
    """The generated title where there is one, else the story's own; trimmed, and empty where both are missing."""
    own = F.trim(F.coalesce("title", F.lit("")))
    if "generated_title" not in stories.columns:
        return own
    made = F.trim(F.coalesce("generated_title", F.lit("")))
    return F.when(made != "", made).otherwise(own)


def translation_state(stories: DataFrame, cache: DataFrame, now: Column, lang: str = "zh", prompt_version: str = "v1", retry_seconds: float = 90) -> DataFrame:
    """stories(story_id, title, and generated_title where there is one), cache (CACHE) -> story_id, source_title, status, title, cache_hit, action.

    action: EMPTY without a source title; USE a translation of this title; WAIT for one that is under way for less than
    retry_seconds; RETRY where the last try for this title failed, hangs or is blank; CHANGED where the cache holds
    another title's translation (or another prompt's); CLAIM where it holds nothing.  Until there is a translation the
    source title is shown.
    """
    of = cache.where(F.col("lang") == lang).select("story_id", F.trim(F.coalesce("source_title", F.lit(""))).alias("of_title"), "translated_title", F.col("status").alias("was"), "updated_at", F.col("prompt_version").alias("of_prompt"))
    both = stories.select("story_id", source_title(stories).alias("source_title")).join(of, "story_id", "left")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 1e6
    same = (F.col("of_title") == F.col("source_title")) & (F.col("of_prompt") == prompt_version)
    action = (
        F.when(F.col("source_title") == "", "EMPTY")
        .when(F.col("was").isNull(), "CLAIM")
        .when(~F.coalesce(same, F.lit(False)), "CHANGED")
        .when((F.col("was") == "SUCCESS") & (F.trim(F.coalesce("translated_title", F.lit(""))) != ""), "USE")
        .when((F.col("was") == "PENDING") & (age < retry_seconds), "WAIT")
        .otherwise("RETRY")
    )
    both = both.withColumn("action", action)
    status = F.when(F.col("action") == "EMPTY", "EMPTY_SOURCE_TITLE").when(F.col("action") == "USE", "SUCCESS").otherwise("PENDING")
    title = F.when(F.col("action") == "USE", F.col("translated_title")).when(F.col("action") != "EMPTY", F.col("source_title"))
    return both.select("story_id", "source_title", status.alias("status"), title.alias("title"), F.col("action").isin("USE", "WAIT").alias("cache_hit"), "action")


def translated(store: TableStore, stories: DataFrame, now, lang: str = "zh", prompt_version: str = "v1", call: Callable[[list[dict]], list[str]] = offline_translations, table: str = "translations", **options) -> DataFrame:
    """Translates what translation_state() finds due: claims it, asks `call`, and keeps the answers; gives the state afterwards.

    The claim is a change of the table that starts anew where another worker came first, so a title is asked for once.
    A row that another worker took over meanwhile (its time is another) keeps what that one writes.
    """
    at_now = F.lit(now).cast("timestamp_ntz")
    keys, names = ["story_id", "lang"], [c.split()[0] for c in CACHE.split(", ")]
    cached = lambda at: at.read(table) if table in at else store.spark.createDataFrame([], CACHE)

    def row(df: DataFrame, **columns) -> DataFrame:
        base = {"lang": F.lit(lang), "prompt_version": F.lit(prompt_version), "translated_title": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "updated_at": at_now}
        return df.select(*[(base | columns).get(n, F.col(n)).alias(n) for n in names])

    mine: list[DataFrame] = []

    def claims(at: Snapshot) -> Change:
        due = translation_state(stories, cached(at), at_now, lang, prompt_version).where(F.col("action").isin("CLAIM", "CHANGED", "RETRY"))
        mine[:] = []
        if due.isEmpty():
            return {}
        mine.append(due)
        return {table: ("replace", upsert(cached(at), row(due, status=F.lit("PENDING")), keys))}

    before = store.snapshot()
    done = store.change(claims)
    if mine and done.version > before.version:
        asked = cached(done).where((F.col("status") == "PENDING") & (F.col("updated_at") == at_now) & (F.col("lang") == lang)).join(mine[0].select("story_id"), "story_id", "left_semi")
        answers = model_answers(asked.select("story_id", F.array("source_title").alias("titles")), call, **options)
        text = F.trim(F.get_json_object("output_json", "$.title"))
        fine = (F.col("status") == "SUCCESS") & (F.coalesce(text, F.lit("")) != "")
        answers = answers.withColumn("translated_title", F.when(fine, text)).withColumn("error", F.when(fine, None).otherwise(F.coalesce("error", F.lit("no title")))).withColumn("status", F.when(fine, "SUCCESS").otherwise("ERROR"))
        answers = answers.join(asked.select("story_id", "source_title"), "story_id")
        made = row(answers, translated_title=F.col("translated_title"), error=F.col("error"))
        made = saved(made, answered := shared_dir(store.spark))  # so that nothing is asked for again when another writer comes first

        def ends(at: Snapshot) -> Change:
            held = cached(at).where((F.col("status") == "PENDING") & (F.col("updated_at") == at_now)).select(*keys, "source_title")
            return {table: ("replace", upsert(cached(at), made.join(held, [*keys, "source_title"], "left_semi").select(*names), keys))}

        store.change(ends)
        removed(store.spark, answered)
    return translation_state(stories, cached(store.snapshot()), at_now, lang, prompt_version)
