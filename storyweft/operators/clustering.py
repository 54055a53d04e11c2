"""Clustering articles into stories: X13, X14 candidates, X15 decisions, X16 best story, X17 assignment, X38 rounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from storyweft.functions.fuzzy import token_set, token_set_ratio
from storyweft.functions.text import jaccard, tokens_norm
from storyweft.functions.vectors import nearest, nearest_stories
from storyweft.operators.graph import components
from storyweft.plans.adapters import hours_between
from storyweft.sources.shared import removed, saved, shared_dir

#: From this similarity on a query merges whatever else there is.
LOW = 0.62


def candidate_stories(queries: DataFrame, articles: DataFrame, links: DataFrame, days: float | None = 7, m: int = 2000, n: int = 20) -> DataFrame:
    """X14 (X13 with days=None): each query article's n stories by their most similar of its m nearest articles.

    A cap on articles per story keeps a story's most similar ones, so it cannot change the maximum; none is applied.
    """
    per = nearest_stories(queries, articles, links, m, days).select("query_id", "story_id", F.col("sim").alias("best_sim"), F.col("article_id").alias("via_article_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("best_sim").desc(), F.col("story_id")))
    return per.withColumn("rank", rank).where(F.col("rank") <= n)


def retrieved(queries: DataFrame, articles: DataFrame, links: DataFrame, days: float | None = None, m: int = 200, n: int = 20, asked: DataFrame | None = None) -> DataFrame:
    """queries(query_id) -> query_id, stories in order of rank, unique_stories, error: one row for every query, also where there is nothing to find.

    error names a query that is no article, or has no vector; else it is null, and without neighbours the list is empty.
    asked, if given, holds the queries' articles in place of articles.
    """
    known = articles if asked is None else asked
    asked = queries.select("query_id").distinct().join(known.select(F.col("id").alias("query_id"), F.col("embedding").isNotNull().alias("has")), "query_id", "left")
    found = candidate_stories(known.join(asked.where("has").select(F.col("query_id").alias("id")), "id", "left_semi"), articles, links, days, m, 1 << 30)
    per = found.groupBy("query_id").agg(F.count("*").alias("unique_stories"), F.sort_array(F.collect_list(F.when(F.col("rank") <= n, F.struct("rank", "story_id")))).alias("s"))
    error = F.when(F.col("has").isNull(), "query_article_not_found").when(~F.col("has"), "query_embedding_is_null")
    stories = F.coalesce(F.transform("s", lambda x: x["story_id"]), F.array().cast("array<bigint>"))
    return asked.join(per, "query_id", "left").select("query_id", stories.alias("stories"), F.coalesce("unique_stories", F.lit(0)).alias("unique_stories"), error.alias("error"))


def decide_action(vec: Column, fuzz: Column, jac: Column, at: Column, end: Column) -> Column:
    """Merge with the best story or start a new one."""
    near = F.abs(hours_between(at, end)) <= 6
    return (
        F.when(vec.isNull(), "new")
        .when((vec < 0.74) & (jac <= 0.01) & (fuzz < 45), "new")
        .when(vec >= 0.62, "merge")
        .when((vec >= 0.54) & (fuzz >= 45), "merge")
        .when(fuzz >= 85, "merge")
        .when((fuzz >= 60) & ((jac >= 0.20) | F.coalesce(near, F.lit(False))), "merge")
        .otherwise("new")
    )


def pick_best(candidates: DataFrame, queries: DataFrame, stories: DataFrame, fuzzy: bool = True) -> DataFrame:
    """The best open story of each query, by similarity, then fuzzy ratio, then id; without a candidate, nulls.

    stories(story_id, title, status, end_time); fuzzy=False leaves the ratio at 0 and everything native.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("title").alias("query_title"), "published_at")
    open_ = stories.where(~F.col("status").eqNullSafe("closed"))
    both = candidates.join(q, "query_id").join(open_.select("story_id", F.col("title").alias("story_title"), "end_time"), "story_id")
    ratio = token_set_ratio(F.col("query_title"), F.col("story_title")) if fuzzy else F.lit(0.0)
    both = both.withColumn("fuzz", ratio).withColumn("jac", jaccard(tokens_norm(F.col("query_title")), tokens_norm(F.col("story_title"))))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("best_sim").desc(), F.col("fuzz").desc(), F.col("story_id")))
    one = both.withColumn("rn", best).where(F.col("rn") == 1)
    return q.join(one.select("query_id", "story_id", "best_sim", "fuzz", "jac", "end_time"), "query_id", "left")


def cluster_dry_run(queries: DataFrame, articles: DataFrame, links: DataFrame, stories: DataFrame, fuzzy: bool = True, **options) -> DataFrame:
    """X17 without writing: the decision for every query against the stories as they are."""
    best = pick_best(candidate_stories(queries, articles, links, **options), queries, stories, fuzzy)
    action = decide_action(F.col("best_sim"), F.col("fuzz"), F.col("jac"), F.col("published_at"), F.col("end_time"))
    return best.withColumn("action", action).select("query_id", "action", F.when(F.col("action") == "merge", F.col("story_id")).alias("story_id"), "best_sim", "fuzz", "jac")


def cluster(queries: DataFrame, articles: DataFrame, links: DataFrame, stories: DataFrame, days: float = 7, m: int = 2000, n: int = 20) -> DataFrame:
    """X17 with writing: article_id, action, story_id for every query, newest first, each seeing the earlier decisions.

    Only what can change a decision binds two queries, so that most of a round is replayed side by side:
    * A query goes to the best open story among its n best.  Neighbours that are no earlier query of the round have the
      stories they had before, so the best of these, with similarity s, is known beforehand.  An earlier query counts
      only if it is at least as similar as s, as else its story cannot be the best one.
    * When a story ends counts only under LOW.  Where a query under LOW could go to a story, directly or through earlier
      queries, all queries that could go there (and so move its end) are bound together.
    The components of these ties are groups, and each is replayed in order.  New stories are named by the article that
    starts them, and numbered at the end in the order of the round.  The only window over all queries holds their ids
    and times, and a round is a bounded number of queries (see newest_unassigned).
    """
    work = shared_dir(queries.sparkSession)
    place = F.row_number().over(W.orderBy(F.col("published_at").desc_nulls_last(), F.col("id").desc()))
    asked = saved(queries.select("id", "published_at", tokens_norm(F.col("title")).alias("tokens"), place.alias("place")), f"{work}/asked")
    places = asked.select(F.col("id").alias("article_id"), F.col("place").alias("earlier"))
    near = nearest(queries, articles, m, days).join(asked.select(F.col("id").alias("query_id"), "place"), "query_id").join(places, "article_id", "left")
    near = saved(near.join(links.select("article_id", "story_id"), "article_id", "left"), f"{work}/near")
    told = F.coalesce(F.col("earlier") < F.col("place"), F.lit(False))
    info = stories.select("story_id", tokens_norm(F.col("title")).alias("words"), ~F.col("status").eqNullSafe("closed"), F.col("end_time").alias("end")).toDF("story_id", "words", "open", "end")
    before = near.where(~told & F.col("story_id").isNotNull()).groupBy("place", "story_id").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(W.partitionBy("place").orderBy(F.col("sim").desc(), "story_id"))
    before = before.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank").join(info, "story_id", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    before = saved(before.withColumn("best", F.max(F.when(F.col("open"), F.col("sim"))).over(W.partitionBy("place"))), f"{work}/before")
    best = before.groupBy("place").agg(F.max("best").alias("best"))
    told = near.where(told).select("place", "earlier", "sim").distinct().join(best, "place", "left")
    told = saved(told.where(F.col("sim") >= F.coalesce("best", F.lit(-2.0))), f"{work}/told")
    ties = told.select(F.col("place").alias("u"), F.col("earlier").alias("v"))
    direct = components(ties, f"{work}/direct")
    homes = before.where(F.col("open") & (F.col("sim") == F.col("best"))).select("place", "story_id")
    low = told.where(F.col("sim") < LOW).select("place").unionByName(best.where(F.col("best") < LOW).select("place")).distinct()
    group = lambda rows, at: rows.join(direct, rows["place"] == direct["node"], "left").select(*at, F.coalesce("component", "place").alias("group"))
    moved = group(homes, ["place", "story_id"]).join(group(low, []).distinct(), "group", "left_semi").select("story_id").distinct()
    shared = homes.join(moved, "story_id", "left_semi").withColumn("first", F.min("place").over(W.partitionBy("story_id")))
    more = saved(shared.where("place <> first").select(F.col("place").alias("u"), F.col("first").alias("v")), f"{work}/more")
    groups = direct if more.isEmpty() else components(ties.unionByName(more), f"{work}/groups")
    own = before.groupBy("place").agg(F.collect_list(F.struct("story_id", "sim", "open", "words", "end")).alias("known"))
    heard = told.groupBy("place").agg(F.collect_list(F.struct("earlier", "sim")).alias("told"))
    rows = asked.join(own, "place", "left").join(heard, "place", "left").join(groups, asked["place"] == groups["node"], "left").withColumn("group", F.coalesce("component", "place"))

    def replay(q: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(replayed(q.sort_values("place"), n), columns=["article_id", "place", "action", "story_id", "starter"])

    done = rows.select("group", "id", "place", "published_at", "tokens", "known", "told").groupBy("group").applyInPandas(replay, "article_id long, place int, action string, story_id long, starter int")
    done = saved(done, f"{work}/done")
    top = stories.agg(F.coalesce(F.max("story_id"), F.lit(0)).alias("top"))
    fresh = done.where("action = 'new'").select(F.col("place").alias("starter"), F.row_number().over(W.orderBy("place")).alias("number"))
    out = done.join(fresh, "starter", "left").crossJoin(F.broadcast(top))
    out = out.select("article_id", "action", F.coalesce("story_id", F.col("top") + F.col("number")).cast("long").alias("story_id"))
    out = saved(out, f"{shared_dir(queries.sparkSession)}/round")
    removed(queries.sparkSession, work)
    return out


def replayed(queries: pd.DataFrame, n: int) -> list[tuple]:
    """Decisions of queries in order: (article, place, action, story or None, place of the query that started the story or None).

    known: stories by the neighbours' links of before; told: similarities to earlier queries of the round.
    """
    info: dict[tuple, list] = {}
    went: dict[int, tuple] = {}
    out = []
    for r in queries.itertuples():
        best: dict[tuple, float] = {}
        for e in r.known if r.known is not None else []:
            key = (0, int(e["story_id"]))  # stories of before come before new ones, as their numbers do
            best[key] = float(e["sim"])
            info.setdefault(key, [list(e["words"]) if e["words"] is not None else [], bool(e["open"]), e["end"]])
        for e in r.told if r.told is not None else []:
            key = went[int(e["earlier"])]
            best[key] = max(best.get(key, -2.0), float(e["sim"]))
        choice = None
        for key, sim in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:n]:
            words, is_open, end = info[key]
            if is_open and (choice is None or sim >= choice[0]):
                a, b = set(r.tokens), set(words)
                found = (sim, token_set(list(r.tokens), words), key, len(a & b) / len(a | b) if a | b else 1.0)
                if choice is None or found[1] > choice[1]:  # of the same similarity and ratio the earlier story stays
                    choice = found
        if choice and merges(choice[0], choice[1], choice[3], r.published_at, info[choice[2]][2]):
            key = choice[2]
            at, end = r.published_at, info[key][2]
            if not pd.isna(at) and (pd.isna(end) or at > end):
                info[key][2] = at
            out.append((r.id, r.place, "merge", key[1] if key[0] == 0 else None, key[1] if key[0] else None))
        else:
            key = (1, r.place)
            info[key] = [list(r.tokens), True, r.published_at]
            out.append((r.id, r.place, "new", None, r.place))
        went[r.place] = key
    return out


def merges(sim: float, fuzz: float, jac: float, at, end) -> bool:
    """decide_action() for one query and its best story."""
    near = not pd.isna(end) and not pd.isna(at) and abs((at - end).total_seconds()) <= 6 * 3600
    if sim < 0.74 and jac <= 0.01 and fuzz < 45:
        return False
    return sim >= LOW or (sim >= 0.54 and fuzz >= 45) or fuzz >= 85 or (fuzz >= 60 and (jac >= 0.20 or near))


def newest_unassigned(articles: DataFrame, links: DataFrame, now: Column, hours: float = 240, limit: int = 300) -> DataFrame:
    """Embedded articles without a story, newest first, at most a round's number."""
    free = articles.where(F.col("embedding").isNotNull() & (hours_between(now, F.col("published_at")) <= hours))
    free = free.join(links.select(F.col("article_id").alias("id")), "id", "left_anti")
    return free.orderBy(F.col("published_at").desc_nulls_last(), F.col("id").desc()).limit(limit)
