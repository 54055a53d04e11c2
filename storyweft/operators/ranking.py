"""Story ranking: X20 time-decayed coverage, X30 quality score, X31 baseline, X21 rerank."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from storyweft.functions.lexicons import ASSERTIVE, NEGATION
from storyweft.functions.text import tokens_simple
from storyweft.plans.adapters import hours_between


def recent(articles: DataFrame, now: Column, hours: float) -> DataFrame:
    """Published at most `hours` before now; later ones stay, nulls go."""
    return articles.where(F.col("published_at").isNotNull() & (hours_between(now, F.col("published_at")) <= hours))


def source_share(articles: DataFrame) -> DataFrame:
    """story_id, source_id, source_articles, share of the story's articles."""
    per = articles.groupBy("story_id", "source_id").agg(F.count("*").alias("source_articles"))
    total = F.sum("source_articles").over(W.partitionBy("story_id"))
    return per.withColumn("share", F.col("source_articles") / F.when(total != 0, total))


def story_lifetime(articles: DataFrame) -> DataFrame:
    """Counts over all articles of a story."""
    return articles.groupBy("story_id").agg(F.count("*").alias("articles_count"), F.countDistinct("source_id").alias("sources_count"), F.max("published_at").alias("last_seen_at"))


def top_stories(articles: DataFrame, stories: DataFrame, now: Column, limit: int = 30, window_hours: float = 168, decay_hours: float = 48, diversity: float = 0.25, penalty: float = 0.70, floor: float = 0.20) -> DataFrame:
    """Stories by time-decayed coverage, with a bonus for many sources and a penalty for one that dominates.

    articles(story_id, source_id, published_at), stories(story_id, title).  Two partial aggregations, by source and by
    story; lifetime counts only for stories that have recent articles (left semi join).
    """
    age = hours_between(now, F.col("published_at"))
    per_source = recent(articles, now, window_hours).groupBy("story_id", "source_id").agg(F.count("*").alias("n"), F.sum(F.exp(-age / decay_hours)).alias("w"), F.max(age).alias("age"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("story_id"))
    stats = per_source.withColumn("share", share).groupBy("story_id").agg(F.sum("n").alias("recent_articles"), F.count("*").alias("recent_sources"), F.sum("w").alias("weight"), F.max("age").alias("age_hours"), F.max("share").alias("max_share"))
    life = story_lifetime(articles.join(stats.select("story_id"), "story_id", "left_semi"))
    score = F.col("weight") * (1 + diversity * F.log(1 + F.col("recent_sources"))) * F.greatest(F.lit(floor), 1 - penalty * F.coalesce("max_share", F.lit(1.0)))
    out = stats.withColumn("score", score).join(life, "story_id").join(stories, "story_id")
    return out.orderBy(F.col("score").desc(), F.col("last_seen_at").desc_nulls_last(), F.col("story_id").desc()).limit(limit)


def clamped(value: int, least: int, most: int) -> int:
    return max(least, min(int(value), most))


def top_list(articles: DataFrame, stories: DataFrame, now: Column, limit: int, **options) -> DataFrame:
    """What a reader of the top list gets: limit, held within 1 to 20, stories after the rerank of six times as many, within 20 to 60."""
    limit = clamped(limit, 1, 20)
    few = top_stories(articles, stories, now, clamped(6 * limit, 20, 60), **options)
    return rerank(few, limit)


def top_stories_v0(articles: DataFrame, now: Column, hours: float = 72, k: int = 5, weights: tuple[float, float, float] = (0.45, 0.35, 0.20)) -> DataFrame:
    """Stories last seen within `hours`, by log counts and freshness."""
    life = story_lifetime(articles)
    age = hours_between(now, F.col("last_seen_at"))
    score = weights[0] * F.log(1 + F.col("articles_count")) + weights[1] * F.log(1 + F.col("sources_count")) + weights[2] * F.exp(-age / 24)
    return life.where(age <= hours).withColumn("age_hours", age).withColumn("score", score).orderBy(F.col("score").desc(), F.col("story_id").desc()).limit(k)


def baseline_topk(articles: DataFrame, now: Column, hours: float = 72, sample: int = 200, least_articles: int = 3, least_sources: int = 2, k: int = 5) -> DataFrame:
    """Of the `sample` stories seen last, those with enough articles and sources, by plain counts."""
    newest = story_lifetime(articles).where(hours_between(now, F.col("last_seen_at")) <= hours).orderBy(F.col("last_seen_at").desc(), F.col("story_id").desc()).limit(sample)
    good = newest.where((F.col("articles_count") >= least_articles) & (F.col("sources_count") >= least_sources))
    return good.orderBy(F.col("sources_count").desc(), F.col("articles_count").desc(), F.col("last_seen_at").desc(), F.col("story_id").desc()).limit(k)


def rerank(items: DataFrame, limit: int, reserved: int = 2, fresh_hours: float = 24.0, block: float = 0.38, relaxed: float = 0.55, fresh_bonus: float = 0.30, alike_cost: float = 0.45) -> DataFrame:
    """Greedy rerank of the few candidates that top_stories() keeps: story_id, title, score, age_hours -> + position.

    Fresh stories first, then the best trade of score, freshness and similarity, then with a relaxed similarity.  It is
    one group by nature, and bounded: items are what a limit left.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "story_id"], ascending=[False, False]).reset_index(drop=True)
        if len(pdf) <= limit:
            return pdf.assign(position=range(1, len(pdf) + 1))[["story_id", "title", "score", "age_hours", "position"]]
        sets = [set(t) for t in pdf["tokens"]]
        clash = lambda a, b: len(a & b) >= 2 and bool((a & no and b & yes) or (b & no and a & yes))
        no, yes = set(NEGATION), set(ASSERTIVE)
        alike = [[len(a & b) / len(a | b) if a and b else 0.0 for b in sets] for a in sets]
        free = lambda i, most: all(alike[i][j] < most and not clash(sets[i], sets[j]) for j in chosen)
        value = lambda i: pdf["score"][i] + fresh_bonus * max(0.0, 1 - pdf["age_hours"][i] / fresh_hours) - alike_cost * max((alike[i][j] for j in chosen), default=0.0)
        chosen: list[int] = []
        for i in range(len(pdf)):
            if len(chosen) < min(reserved, limit) and pdf["age_hours"][i] <= fresh_hours and free(i, block):
                chosen.append(i)
        for most, force in ((block, False), (relaxed, True)):
            while len(chosen) < limit:
                rest = [i for i in range(len(pdf)) if i not in chosen]
                ok = [i for i in rest if free(i, most)] or (rest if force else [])
                if not ok:
                    break
                chosen.append(max(ok, key=lambda i: (value(i), -i)))
        return pdf.iloc[chosen].assign(position=range(1, len(chosen) + 1))[["story_id", "title", "score", "age_hours", "position"]]

    few = items.select("story_id", "title", "score", "age_hours", tokens_simple(F.col("title")).alias("tokens"), F.lit(1).alias("g"))
    return few.groupBy("g").applyInPandas(order, "story_id long, title string, score double, age_hours double, position int")
