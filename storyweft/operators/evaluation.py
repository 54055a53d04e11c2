"""Evaluation and diagnostics: X32 rank metrics, X33 audit, X34 recall, X35 day views, X36 funnel, supply and probe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from storyweft.functions.text import tokens_eval
from storyweft.functions.vectors import nearest
from storyweft.plans.adapters import hours_between
from storyweft.sources.shared import saved, shared_dir
from storyweft.sources.tablestore import Change, Snapshot, TableStore


def rank_metrics(a: DataFrame, b: DataFrame, longest: int = 2000) -> DataFrame:
    """a(id, rank), b(id, rank), both top lists -> overlap, mean rank difference, concordant, discordant, tau.

    Every pair of ids is compared, so lists of over `longest` rows are an error.
    """
    if max(x.limit(longest + 1).count() for x in (a, b)) > longest:
        raise ValueError(f"rank_metrics compares all pairs of two top lists; one has over {longest} rows")
    most = F.greatest(F.max("ra"), F.max("rb")) + 1
    both = a.select("id", F.col("rank").alias("ra")).join(b.select("id", F.col("rank").alias("rb")), "id", "full_outer")
    miss = both.agg(most.alias("missing"))
    both = both.crossJoin(F.broadcast(miss)).select("id", "ra", "rb", F.coalesce("ra", "missing").alias("x"), F.coalesce("rb", "missing").alias("y"))
    shared = both.agg((F.count(F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), 1)) / F.greatest(F.lit(1), F.count("ra"))).alias("overlap"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_rank_delta"))
    l, r = both.alias("l"), both.alias("r")
    sign = F.signum((F.col("l.x") - F.col("r.x")) * (F.col("l.y") - F.col("r.y")))
    pairs = l.join(r, F.col("l.id") < F.col("r.id")).agg(F.count(F.when(sign > 0, 1)).alias("concordant"), F.count(F.when(sign < 0, 1)).alias("discordant"))
    total = F.col("concordant") + F.col("discordant")
    return shared.crossJoin(pairs).withColumn("tau", F.coalesce((F.col("concordant") - F.col("discordant")) / F.when(total != 0, total), F.lit(0.0)))


def misattachment_audit(articles: DataFrame, top: DataFrame, suspect: float = 0.15) -> DataFrame:
    """articles(article_id, story_id, title), top(story_id, title): is an article's title closer to another top story?

    Titles that share no token have nothing in common, so an index of the top stories' tokens finds all others; a title
    without tokens stands as the empty token, as two of these are alike.  top may have any length, and is read once
    (saved) for every side of the joins.  Without another top story that shares a token, the best other is the smallest
    other id, with 0; without any other story it is null.
    """
    top = saved(top.select("story_id", _marked(tokens_eval(F.col("title"))).alias("tokens")), f"{shared_dir(top.sparkSession)}/top")
    index = top.select(F.col("story_id").alias("other"), F.size("tokens").alias("m"), F.explode("tokens").alias("token"))
    own = articles.join(top.select("story_id"), "story_id", "left_semi").select("article_id", "story_id", _marked(tokens_eval(F.col("title"))).alias("tokens"))
    met = own.select("article_id", "story_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(index, "token")
    met = met.groupBy("article_id", "story_id", "other").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("m").alias("m"))
    sim = F.col("k") / (F.col("n") + F.col("m") - F.col("k"))
    other = F.max(F.when(F.col("other") != F.col("story_id"), F.struct(sim.alias("sim"), (-F.col("other")).alias("o"))))
    best = met.groupBy("article_id", "story_id").agg(F.max(F.when(F.col("other") == F.col("story_id"), sim)).alias("self_sim"), other.alias("best"))
    two = top.orderBy("story_id").limit(2).agg(F.sort_array(F.collect_list("story_id")).alias("two"))
    out = own.select("article_id", "story_id").join(best, ["article_id", "story_id"], "left").crossJoin(F.broadcast(two))
    plain = F.get(F.filter("two", lambda x: x != F.col("story_id")), F.lit(0))
    out = out.select("article_id", "story_id", F.coalesce("self_sim", F.lit(0.0)).alias("self_sim"), F.coalesce("best.sim", F.lit(0.0)).alias("best_other_sim"), F.coalesce(-F.col("best.o"), plain).alias("best_other"))
    return out.withColumn("margin", F.col("self_sim") - F.col("best_other_sim")).withColumn("conflict", F.col("margin") <= 0).withColumn("suspect", F.col("best_other_sim") - F.col("self_sim") >= suspect)


def _marked(tokens: Column) -> Column:
    return F.when(F.size(tokens) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(tokens))


def audit_summary(audited: DataFrame) -> DataFrame:
    """Averages, the rate of conflicts and the number of suspects of misattachment_audit(), as one row."""
    rate = F.avg(F.col("conflict").cast("double"))
    return audited.agg(F.round(F.avg("self_sim"), 4).alias("avg_title_match"), F.round(F.avg("margin"), 4).alias("avg_margin"), F.round(rate, 4).alias("conflict_rate"), F.count_if("suspect").alias("suspects"), F.count("*").alias("articles"))


def known_queries(labels: DataFrame, articles: DataFrame) -> DataFrame:
    """Labels, whose queries all have to be among articles(id, title) with a title; else an error that names up to ten of the others."""
    there = articles.where(F.trim(F.coalesce("title", F.lit(""))) != "").select(F.col("id").alias("query_id"))
    missing = labels.select("query_id").distinct().join(there, "query_id", "left_anti").orderBy("query_id").limit(10).collect()
    if missing:
        raise ValueError(f"these queries are not among the recent articles: {[r['query_id'] for r in missing]}")
    return labels


def baseline_candidates(queries: DataFrame, articles: DataFrame, links: DataFrame, m: int = 50, per_story: int = 3) -> DataFrame:
    """query_id, story_id, rank, articles: the stories of each query's m nearest articles by title vector, in order of their first article.

    articles counts a story's articles among them, of which the first per_story are taken.  Neighbours without a story
    are passed over; a story of several links is there once a link.
    """
    near = nearest(queries, articles, m).withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("sim").desc(), F.col("article_id"))))
    near = near.join(links.select("article_id", "story_id"), "article_id")
    taken = F.row_number().over(W.partitionBy("query_id", "story_id").orderBy("place"))
    per = near.withColumn("nth", taken).where(F.col("nth") <= per_story).groupBy("query_id", "story_id").agg(F.min("place").alias("first"), F.count("*").alias("articles"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("first", "story_id"))
    return per.select("query_id", "story_id", rank.alias("rank"), "articles")


def retrieval_recall(labels: DataFrame, candidates: DataFrame, ks: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """labels(query_id, true_story_id), candidates(query_id, story_id, rank) -> k, hits, n, recall."""
    found = labels.join(candidates.withColumnRenamed("story_id", "true_story_id"), ["query_id", "true_story_id"], "left")
    return found.groupBy("query_id").agg(F.min("rank").alias("rank")).select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "rank").groupBy("k").agg(F.count(F.when(F.col("rank") <= F.col("k"), 1)).alias("hits"), F.count("*").alias("n")).withColumn("recall", F.col("hits") / F.col("n"))


def recall_percentiles(candidates: DataFrame) -> DataFrame:
    """Mean and 95th percentile (linear interpolation) of the number of candidates per query."""
    return candidates.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean_candidates"), F.percentile("n", 0.95).alias("p95_candidates"), F.count("*").alias("queries"))


def day_of(at: Column) -> Column:
    return F.date_trunc("day", at).cast("timestamp_ntz")


def json_daily(logs: DataFrame, *columns: tuple[str, str | float, str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """logs(created_at, ... and columns of JSON) by day (and by): the number of rows n, and columns (name, what, column, path).

    what is avg or max of a number, max_int of a whole one, true for the rows where it is, or a number that it has to reach.
    """

    def value(name: str, what: str | float, column: str, path: str) -> Column:
        x = F.get_json_object(column, f"$.{path}")
        if what == "true":
            return F.sum(F.when(F.coalesce(x.cast("boolean"), F.lit(False)), 1).otherwise(0)).alias(name)
        if what == "max_int":
            return F.max(x.cast("double").cast("int")).alias(name)
        if isinstance(what, str):
            return {"avg": F.avg, "max": F.max}[what](x.cast("double")).alias(name)
        return F.sum(F.when(x.cast("double") >= what, 1).otherwise(0)).alias(name)

    return logs.groupBy(day_of(F.col("created_at")).alias("day"), *by).agg(F.count("*").alias("n"), *[value(*c) for c in columns])


def gap_hints_daily(logs: DataFrame) -> DataFrame:
    """The log's checks of gaps by day."""
    of = json_daily(logs.where("eval_type = 'gap_hints_daily'"), ("events_with_gap", "true", "metrics", "gap_found"), ("avg_dominant_source_ratio", "avg", "metrics", "dominant_source_ratio"), ("avg_missing_type_count", "avg", "metrics", "missing_type_count"))
    return of.withColumnRenamed("n", "events_checked")


def top_events_params_daily(logs: DataFrame) -> DataFrame:
    """The log's parameters of the top list by day, the largest of each."""
    whole = [(c, "max_int", "params", c) for c in ("window_hours", "tau_hours")]
    of = json_daily(logs.where("eval_type = 'top_events_params'"), *whole, *[(f"w_{c}", "max", "params", f"weights.{c}") for c in ("hot", "div", "fresh")])
    return of.withColumnRenamed("n", "runs")


EVAL_LOG = "run_id string, eval_type string, algorithm_name string, algorithm_version string, baseline_name string, baseline_version string, sample_window_hours int, sample_event_ids string, algo_topk string, baseline_topk string, metrics string, params string, notes string, created_at timestamp_ntz"
_JSON = ("sample_event_ids", "algo_topk", "baseline_topk", "metrics", "params")


def eval_rows(rows: DataFrame, created_at: Column) -> DataFrame:
    """Evaluation runs in the shape of the log: lists, maps and structs as JSON (missing ones empty), missing columns null, one time for all."""
    kinds = dict(f.split() for f in EVAL_LOG.split(", "))

    def column(name: str) -> Column:
        if name == "created_at":
            return created_at.cast("timestamp_ntz")
        there = F.col(name) if name in rows.columns else F.lit(None)
        if name not in _JSON:
            return there.cast(kinds[name])
        nothing = F.lit("{}" if name in ("metrics", "params") else "[]")
        plain = name not in rows.columns or dict(rows.dtypes)[name] == "string"
        return F.coalesce(there.cast("string") if plain else F.to_json(there), nothing)

    return rows.select(*[column(n).alias(n) for n in kinds])


def log_eval(rows: DataFrame, store: TableStore, created_at: Column, table: str = "algorithm_eval_logs") -> None:
    """Adds the runs of rows, once: a run (run_id, eval_type) that the log has already is passed over, so a retry adds nothing twice."""
    made = eval_rows(rows, created_at)

    def plan(at: Snapshot) -> Change:
        new = made.join(at.read(table).select("run_id", "eval_type"), ["run_id", "eval_type"], "left_anti") if table in at else made
        return {table: ("append", new)}

    store.change(plan)


def missing_work(articles: DataFrame, links: DataFrame, now: Column, days: float = 7, hours: float = 240) -> DataFrame:
    """One row of what is left to do: recent articles without a vector, without a type, and with a vector but without a story."""
    age = hours_between(now, F.col("published_at"))
    linked = links.select(F.col("article_id").alias("id"), F.lit(True).alias("linked")).distinct()
    free = (age <= hours) & F.col("embedding").isNotNull() & F.col("linked").isNull()
    return articles.join(linked, "id", "left").agg(F.count_if((age <= 24 * days) & F.col("embedding").isNull()).alias("missing_embeddings"), F.count_if((age <= 24 * days) & F.col("article_type").isNull()).alias("missing_types"), F.count_if(free).alias("unassigned"))


def funnel(articles: DataFrame, links: DataFrame, stories: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """One row of counts from articles to stories with signatures; one pass over each table."""
    fresh = hours_between(now, F.col("published_at")) <= 24 * days
    a = articles.agg(F.count("*").alias("articles"), F.count_if(fresh).alias("recent_articles"), F.count("embedding").alias("embedded"), F.count("article_type").alias("typed"))
    return a.crossJoin(links.agg(F.countDistinct("article_id").alias("linked"))).crossJoin(stories.agg(F.count("*").alias("stories"), F.count_if(F.size("signature_v0") > 0).alias("with_signature")))


def supply_report(sources: DataFrame, articles: DataFrame, limit: int = 30) -> DataFrame:
    """Articles per source, sources without any included."""
    per = articles.groupBy("source_id").agg(F.count("*").alias("n"), F.max("published_at").alias("latest"))
    return sources.join(per, "source_id", "left").select("source_id", "name", F.coalesce("n", F.lit(0)).alias("n"), "latest").orderBy(F.col("n").desc(), "source_id").limit(limit)


def type_audit(articles: DataFrame, newest: int) -> DataFrame:
    """Counts by type over the newest articles."""
    return articles.orderBy(F.col("published_at").desc_nulls_last(), F.col("article_id").desc()).limit(newest).groupBy("article_type").agg(F.count("*").alias("n"))


def running_ranks(rows: DataFrame, *order: Column) -> DataFrame:
    """1-based positions of a short list."""
    return rows.withColumn("rank", F.row_number().over(W.orderBy(*order)))
