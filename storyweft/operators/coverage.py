"""Coverage of stories: X24 matrix, X25 gaps, X23 diversity order, X26 groups and ranges, X19 status, X18 windows, X22 detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from storyweft.functions.text import effective_type
from storyweft.plans.adapters import hours_between

TYPES = ("FACT", "INTERPRETATION", "COMMENTARY", "UNKNOWN")


def newest_first(by: str = "story_id"):
    return W.partitionBy(by).orderBy(F.col("published_at").desc_nulls_last(), F.col("article_id").desc())


def coverage_matrix(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Per story and source, counts by type and the ids of each type, newest first (types that fall together are added up)."""
    kind = effective_type(F.col("article_type"), "matrix")
    at = F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(-(1 << 62)))
    rows = articles.join(sources, "source_id").select("story_id", "source", kind.alias("kind"), F.struct((-at).alias("at"), (-F.col("article_id")).alias("id")).alias("a"))
    counts = [F.count(F.when(F.col("kind") == t, 1)).alias(f"n_{t.lower()}") for t in TYPES]
    ids = [F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == t, F.col("a")))), lambda x: -x.id).alias(f"ids_{t.lower()}") for t in TYPES]
    return rows.groupBy("story_id", "source").agg(*counts, *ids, F.count("*").alias("n_total"))


def coverage_totals(matrix: DataFrame) -> DataFrame:
    """The sums of a matrix by type, and how many sources each story has."""
    names = [f"n_{t.lower()}" for t in TYPES]
    return matrix.groupBy("story_id").agg(*[F.sum(n).alias(n) for n in names], F.sum("n_total").alias("n_total"), F.count("*").alias("n_sources"))


def gap_hints(articles: DataFrame, sources: DataFrame, least_articles: int = 4, least_sources: int = 3, dominant: float = 0.6) -> DataFrame:
    """Per story, whether types are missing or a source dominates; a tie for the dominant source goes to the first name."""
    kind = effective_type(F.col("article_type"), "gap")
    known = TYPES[:3]
    per_source = articles.join(sources, "source_id").groupBy("story_id", "source").agg(F.count("*").alias("n"), *[F.count(F.when(kind == t, 1)).alias(t) for t in known])
    best = F.row_number().over(W.partitionBy("story_id").orderBy(F.col("n").desc(), F.col("source")))
    per = per_source.withColumn("rn", best).groupBy("story_id").agg(F.sum("n").alias("total_articles"), F.count("*").alias("sources_count"), *[F.sum(t).alias(f"n_{t.lower()}") for t in known], F.max(F.when(F.col("rn") == 1, F.col("source"))).alias("dominant_source"), F.max("n").alias("dominant_articles"))
    missing = F.array_compact(F.array(*[F.when(F.col(f"n_{t.lower()}") == 0, t) for t in known]))
    ratio = F.col("dominant_articles") / F.col("total_articles")
    few = (F.col("total_articles") < least_articles) | (F.col("sources_count") < least_sources)
    codes = F.array_compact(F.array(F.when(F.size(missing) > 0, "MISSING_TYPES"), F.when(ratio > dominant, "DOMINANT_SOURCE")))
    out = per.withColumn("dominant_ratio", ratio).withColumn("missing_types", missing).withColumn("codes", F.when(few, F.array().cast("array<string>")).otherwise(codes))
    return out.withColumn("status", F.when(few, "INSUFFICIENT_DATA").when(F.size("codes") > 0, "GAP_FOUND").otherwise("NO_GAP")).withColumn("reason", F.when(few, "below_thresholds"))


def diversity_order(articles: DataFrame, level: int = 0, k: int | None = None, pool: int | None = None, share: float = 0.6) -> DataFrame:
    """articles(story_id, article_id, source_id, article_type, published_at) -> story_id, article_id, position, reason.

    All articles of a story are ordered; pool keeps its newest ones only, and k the first of the order.  Level 0 is by
    time.  Level 30 (60 is treated as 30) caps each source at ceil(share * k) and takes, step by step, a source that has
    none yet, else an article of the type that has the fewest among those that remain (ties by name), else the newest
    under the cap, else the newest.  An article without a source is under no cap and never a new source.

    The steps are plain sorts, so windows give them.  New sources come first, in order of time.  Then a type that has c
    articles gives its next ones at (c, type), (c + 1, type), ..., and the smallest is always taken.  As the cap is over
    half, only one source can reach it; from there on its articles are left out of these counts, and a type of which
    only such are left still asks for its turn: what would come after that turn comes by time, and the left ones last.
    """
    if level not in (0, 30, 60):
        raise ValueError("level must be 0, 30 or 60")
    if not 0.5 < share <= 1:
        raise ValueError("share must be over one half, and at most one")
    rows = articles.withColumn("i", F.row_number().over(newest_first()))
    rows = rows.where(F.col("i") <= pool) if pool is not None else rows
    if level == 0:
        rows = rows.where(F.col("i") <= k) if k is not None else rows
        return rows.select("story_id", "article_id", F.col("i").alias("position"), F.lit("TIME_ORDER").alias("reason"))
    story, kind, source = W.partitionBy("story_id"), W.partitionBy("story_id", "kind"), W.partitionBy("story_id", "source_id")
    up_to = lambda w, *order: w.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("story_id", "article_id", "source_id", effective_type(F.col("article_type"), "list").alias("kind"), "i")
    n = F.count("*").over(story)
    rows = rows.withColumn("cap", F.ceil(F.lit(share) * (n if k is None else F.least(n, F.lit(k)))))
    rows = rows.withColumn("of_source", F.when(F.col("source_id").isNotNull(), F.count("*").over(source)))
    rows = rows.withColumn("new", F.coalesce((F.row_number().over(source.orderBy("i")) == 1) & F.col("source_id").isNotNull(), F.lit(False)))
    # a type's articles that are no new source: (level, kind) is the turn at which each would come
    turn = F.count_if("new").over(kind) + F.count_if(~F.col("new")).over(up_to(kind, "i")) - 1
    rows = rows.withColumn("turn", F.when(~F.col("new"), F.struct(turn.alias("at"), "kind")))
    taken = F.when(~F.col("new"), F.count("turn").over(up_to(source, "turn")))
    full = F.when((taken == F.col("cap") - 1) & (F.col("of_source") > F.col("cap")), F.col("turn"))
    rows = rows.withColumn("full", F.max(full).over(story))
    after = F.coalesce(F.col("turn") > F.col("full"), F.lit(False))
    rows = rows.withColumn("over", after & F.coalesce(F.col("of_source") > F.col("cap"), F.lit(False))).withColumn("late", after & ~F.col("over"))
    turn = F.struct((F.col("turn.at") - F.count_if("over").over(up_to(kind, "i"))).alias("at"), "kind")
    rows = rows.withColumn("turn", F.when(F.col("late"), turn).otherwise(F.col("turn")))
    asks = F.struct((F.min(F.when(after, F.col("turn.at"))).over(kind) + F.count_if("late").over(kind)).alias("at"), "kind")
    rows = rows.withColumn("asks", F.when(F.count_if("over").over(kind) > 0, asks)).withColumn("asks", F.min("asks").over(story))
    by_time = F.col("late") & F.coalesce(F.col("turn") > F.col("asks"), F.lit(False))
    reason = F.when(F.col("new"), "NEW_SOURCE").when(F.col("over"), "CAP_RELAXED_FILL").when(by_time, "BASELINE_FILL").otherwise("TYPE_COVERAGE")
    part = F.when(F.col("new"), 0).when(F.col("over"), 3).when(by_time, 2).otherwise(1)
    order = story.orderBy("part", F.when(F.col("part") == 1, F.col("turn")), "i")
    out = rows.withColumn("reason", reason).withColumn("part", part).withColumn("position", F.row_number().over(order))
    out = out.where(F.col("position") <= k) if k is not None else out
    return out.select("story_id", "article_id", "position", "reason")


def diversity_histograms(ordered: DataFrame, articles: DataFrame) -> DataFrame:
    """story_id, and maps of how many of the picked articles each source and each type has."""
    rows = ordered.join(articles, ["story_id", "article_id"]).select("story_id", F.col("source_id").cast("string").alias("source"), effective_type(F.col("article_type"), "list").alias("kind"))
    count = lambda c: rows.where(F.col(c).isNotNull()).groupBy("story_id", c).agg(F.count("*").alias("n")).groupBy("story_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))
    return count("kind").join(count("source"), "story_id", "left")


def newest_per_story(articles: DataFrame, k: int) -> DataFrame:
    """Each story's k newest articles, with rn."""
    return articles.withColumn("rn", F.row_number().over(newest_first())).where(F.col("rn") <= k)


def source_groups(articles: DataFrame) -> DataFrame:
    """articles(id, source, published_at) by source: latest, count, order of groups, the first being featured."""
    per = articles.groupBy("source").agg(F.max("published_at").alias("latest"), F.count("*").alias("n"))
    place = F.row_number().over(W.orderBy(F.col("latest").desc_nulls_last(), F.col("n").desc(), F.col("source")))
    return per.withColumn("position", place).withColumn("featured", F.col("position") == 1)


def coverage_range(articles: DataFrame, stories: DataFrame) -> DataFrame:
    """From the first article (else the story's start) to the last of articles, end and last sight."""
    span = articles.groupBy("story_id").agg(F.min("published_at").alias("lo"), F.max("published_at").alias("hi"))
    out = stories.join(span, "story_id", "left")
    return out.select("story_id", F.coalesce("lo", "start_time").alias("range_start"), F.greatest("hi", "end_time", "last_seen_at").alias("range_end"))


def story_status(last_updated: Column, now: Column, active_hours: float = 96, closing_hours: float = 240) -> Column:
    """Active, closing or closed; never updated is closed."""
    if closing_hours <= active_hours:
        raise ValueError("closing_hours must be greater than active_hours")
    age = hours_between(now, last_updated)
    return F.when(age <= active_hours, "active").when(age <= closing_hours, "closing").otherwise("closed")


def touch_window(stories: DataFrame, links: DataFrame) -> DataFrame:
    """stories(story_id, start_time, end_time) widened by links(story_id, published_at)."""
    span = links.groupBy("story_id").agg(F.min("published_at").alias("lo"), F.max("published_at").alias("hi"))
    return stories.join(span, "story_id", "left").select("story_id", F.least("start_time", "lo").alias("start_time"), F.greatest("end_time", "hi").alias("end_time"))


def story_detail(story_id: int, articles: DataFrame, stories: DataFrame, sources: DataFrame, now: Column, diversity: int = 0, days: int = 30) -> dict[str, DataFrame]:
    """The parts of a story's page: summary, all articles (of the last days, in order, with source, country and type), coverage, totals, gaps and the histograms of what is shown.

    stories(story_id, title, and title_override where there is a rewritten one); sources(source_id, source, and country,
    which is Unknown where it is missing).
    """
    own = articles.where(F.col("story_id") == story_id)
    shown = own.where(hours_between(now, F.col("published_at")) <= 24 * days)
    span = own.groupBy("story_id").agg(F.min("published_at").alias("start_time"), F.max("published_at").alias("last_seen_at"), F.count("*").alias("articles_count"), F.countDistinct("source_id").alias("sources_count"))
    summary = stories.where(F.col("story_id") == story_id).join(span, "story_id", "left")
    if "title_override" in stories.columns:
        summary = summary.withColumn("title", F.coalesce("title_override", "title")).drop("title_override")
    summary = summary.withColumn("status", story_status(F.col("last_seen_at"), now)).withColumn("last_seen_text", F.date_format("last_seen_at", "yyyy-MM-dd'T'HH:mm:ss"))  # F11
    named = sources if "country" in sources.columns else sources.withColumn("country", F.lit(None).cast("string"))
    ordered = diversity_order(shown, diversity)
    listed = shown.join(ordered, ["story_id", "article_id"]).join(named, "source_id", "left").withColumn("country", F.coalesce("country", F.lit("Unknown")))
    listed = listed.withColumn("type", effective_type(F.col("article_type"), "list")).orderBy("position")
    coverage = coverage_matrix(own, sources)
    return {"summary": summary, "articles": listed, "coverage": coverage, "totals": coverage_totals(coverage), "gaps": gap_hints(own, sources), "histograms": diversity_histograms(ordered, shown)}


def lifetimes(articles: DataFrame) -> DataFrame:
    """articles(story_id, source_id, published_at) -> story_id, articles_count, sources_count, start_time, end_time of every story that has an id.

    One sort by story and source serves all of it, so no task holds its stories in a hash table.
    """
    in_order = W.partitionBy("story_id").orderBy("source_id")
    all_ = in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    new = F.col("source_id").isNotNull() & ~F.lag("source_id").over(in_order).eqNullSafe(F.col("source_id"))
    rows = articles.where("story_id IS NOT NULL").select("story_id", "source_id", "published_at", new.cast("long").alias("new"), F.row_number().over(in_order).alias("nth"))
    of = (F.count("*").over(all_).alias("articles_count"), F.sum("new").over(all_).alias("sources_count"), F.min("published_at").over(all_).alias("start_time"), F.max("published_at").over(all_).alias("end_time"))
    return rows.select("story_id", "nth", *of).where("nth = 1").drop("nth")
