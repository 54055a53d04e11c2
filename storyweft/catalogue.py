"""The registered queries of the library, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from storyweft.functions import text as tx
from storyweft.functions.fuzzy import token_set_ratio
from storyweft.functions.lexicons import SIGNATURE_STOP_WORDS, TITLE_STOP_WORDS
from storyweft.functions.vectors import embed, nearest
from storyweft.operators import backgrounds as bg, clustering as cl, coverage as cov, evaluation as ev, listing as ls, merging as mg, ranking as rk, store as st
from storyweft.plans import adapters as ad, translations as tr
from storyweft.sources.shared import saved, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW_SQL = f"TIMESTAMP '{ad.AS_OF}'"
HOURS_SQL = "(epoch_us({0}) - epoch_us({1})) / 3.6e9"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def joined(c: str | Column) -> Column:
    return F.array_join(F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("string")), " ")


def words_sql(stop: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in stop)


TOP_SQL = f"""
WITH {ad.ARTICLES_SQL},
p AS (SELECT story_id, source_id, count(*) AS n, sum(exp(-({HOURS_SQL.format(NOW_SQL, 'published_at')}) / 48)) AS w, max({HOURS_SQL.format(NOW_SQL, 'published_at')}) AS age
      FROM a WHERE published_at IS NOT NULL AND {HOURS_SQL.format(NOW_SQL, 'published_at')} <= 168 GROUP BY ALL),
q AS (SELECT *, n / sum(n) OVER (PARTITION BY story_id) AS share FROM p),
s AS (SELECT story_id, CAST(sum(n) AS BIGINT) AS recent_articles, count(*) AS recent_sources, sum(w) AS weight, max(age) AS age_hours, max(share) AS max_share FROM q GROUP BY story_id),
l AS (SELECT story_id, count(*) AS articles_count, count(DISTINCT source_id) AS sources_count, max(published_at) AS last_seen_at FROM a GROUP BY story_id),
t AS (SELECT s.*, weight * (1 + 0.25 * ln(1 + recent_sources)) * greatest(0.20, 1 - 0.70 * coalesce(max_share, 1)) AS score, articles_count, sources_count, last_seen_at, substr(d.text, 1, 120) AS title
      FROM s JOIN l USING (story_id) JOIN documents d ON d.doc_id = s.story_id ORDER BY score DESC, last_seen_at DESC NULLS LAST, story_id DESC LIMIT 30)
"""


def _top(spark: SparkSession, d: str, limit: int = 30) -> DataFrame:
    return rk.top_stories(ad.coverage_articles(spark, d), ad.coverage_stories(spark, d), ad.as_of(), limit)


@query(TOP_SQL + "SELECT story_id, title, recent_articles, recent_sources, round(weight, 6) AS weight, round(age_hours, 6) AS age_hours, round(max_share, 6) AS max_share, round(score, 6) AS score, articles_count, sources_count, last_seen_at FROM t")
def top_stories(spark, d):
    return _top(spark, d).select("story_id", "title", "recent_articles", "recent_sources", r6("weight").alias("weight"), r6("age_hours").alias("age_hours"), r6("max_share").alias("max_share"), r6("score").alias("score"), "articles_count", "sources_count", "last_seen_at")


V0_SQL = f"""WITH {ad.ARTICLES_SQL},
l AS (SELECT story_id, count(*) AS articles_count, count(DISTINCT source_id) AS sources_count, max(published_at) AS last_seen_at FROM a GROUP BY story_id),
r AS (SELECT *, {HOURS_SQL.format(NOW_SQL, 'last_seen_at')} AS age_hours FROM l WHERE {HOURS_SQL.format(NOW_SQL, 'last_seen_at')} <= 72),
v AS (SELECT *, 0.45 * ln(1 + articles_count) + 0.35 * ln(1 + sources_count) + 0.20 * exp(-age_hours / 24) AS score FROM r ORDER BY score DESC, story_id DESC LIMIT 5),
n AS (SELECT * FROM r ORDER BY last_seen_at DESC, story_id DESC LIMIT 200),
b AS (SELECT * FROM n WHERE articles_count >= 3 AND sources_count >= 2 ORDER BY sources_count DESC, articles_count DESC, last_seen_at DESC, story_id DESC LIMIT 5)
"""


@query(V0_SQL + "SELECT story_id, articles_count, sources_count, round(age_hours, 6) AS age_hours, round(score, 6) AS score FROM v")
def top_stories_v0(spark, d):
    return rk.top_stories_v0(ad.coverage_articles(spark, d), ad.as_of()).select("story_id", "articles_count", "sources_count", r6("age_hours").alias("age_hours"), r6("score").alias("score"))


@query(V0_SQL + "SELECT story_id, articles_count, sources_count, last_seen_at FROM b")
def baseline_topk(spark, d):
    return rk.baseline_topk(ad.coverage_articles(spark, d), ad.as_of()).select("story_id", "articles_count", "sources_count", "last_seen_at")


@query(V0_SQL + """, x AS (SELECT story_id AS id, row_number() OVER (ORDER BY score DESC, story_id DESC) AS ra FROM v),
y AS (SELECT story_id AS id, row_number() OVER (ORDER BY sources_count DESC, articles_count DESC, last_seen_at DESC, story_id DESC) AS rb FROM b),
j AS (SELECT coalesce(x.id, y.id) AS id, ra, rb FROM x FULL JOIN y ON x.id = y.id),
m AS (SELECT *, coalesce(ra, greatest((SELECT max(ra) FROM x), (SELECT max(rb) FROM y)) + 1) AS p, coalesce(rb, greatest((SELECT max(ra) FROM x), (SELECT max(rb) FROM y)) + 1) AS q FROM j),
s AS (SELECT sign((l.p - r.p) * (l.q - r.q)) AS s FROM m l JOIN m r ON l.id < r.id),
c AS (SELECT count(*) FILTER (s > 0) AS concordant, count(*) FILTER (s < 0) AS discordant FROM s)
SELECT round((SELECT count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) / greatest(1, count(ra)) FROM m), 6) AS overlap, round((SELECT avg(abs(p - q)) FROM m), 6) AS mean_rank_delta, concordant, discordant,
round(CASE WHEN concordant + discordant = 0 THEN 0 ELSE (concordant - discordant) / (concordant + discordant) END, 6) AS tau FROM c""")
def rank_agreement(spark, d):
    a = ad.coverage_articles(spark, d)
    x = ev.running_ranks(rk.top_stories_v0(a, ad.as_of()), F.col("score").desc(), F.col("story_id").desc()).select(F.col("story_id").alias("id"), "rank")
    y = ev.running_ranks(rk.baseline_topk(a, ad.as_of()), F.col("sources_count").desc(), F.col("articles_count").desc(), F.col("last_seen_at").desc(), F.col("story_id").desc()).select(F.col("story_id").alias("id"), "rank")
    return ev.rank_metrics(x, y).select(r6("overlap").alias("overlap"), r6("mean_rank_delta").alias("mean_rank_delta"), "concordant", "discordant", r6("tau").alias("tau"))


@query("""SELECT o_orderkey AS story_id, count(l_orderkey) AS articles_count, count(DISTINCT l_suppkey) AS sources_count, min(l_shipdate) AS start_time, coalesce(max(l_shipdate), o_orderdate) AS last_seen_at
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate""")
def story_lifetime(spark, d):
    o = ad.read(spark, d, "orders").groupBy("o_orderkey", "o_orderdate").agg(F.count("*").alias("times"))
    per = cov.lifetimes(ad.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("story_id"), F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("published_at")))
    both = o.join(per, F.col("o_orderkey") == F.col("story_id"), "left")
    return both.select(F.col("o_orderkey").alias("story_id"), F.coalesce(F.col("articles_count") * F.col("times"), F.lit(0)).alias("articles_count"), F.coalesce("sources_count", F.lit(0)).alias("sources_count"), "start_time", F.coalesce("end_time", "o_orderdate").alias("last_seen_at"))


@query("""SELECT l_orderkey AS story_id, l_linenumber AS article_no, s_name AS source, coalesce(n_name, 'Unknown') AS country, l_shipdate AS published_at,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC NULLS LAST, l_linenumber DESC, l_partkey, l_suppkey) AS position FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""")
def story_articles(spark, d):
    s = ad.read(spark, d, "supplier").join(ad.read(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    rows = ad.read(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.col("l_shipdate").desc_nulls_last(), F.col("l_linenumber").desc(), "l_partkey", "l_suppkey"))
    return rows.select(F.col("l_orderkey").alias("story_id"), F.col("l_linenumber").alias("article_no"), F.col("s_name").alias("source"), F.coalesce("n_name", F.lit("Unknown")).alias("country"), F.col("l_shipdate").alias("published_at"), place.alias("position"))


MATRIX_TYPE = "CASE WHEN article_type IS NULL OR article_type = 'DEFAULT_FACT' THEN 'FACT' WHEN article_type = 'OPINION' THEN 'COMMENTARY' ELSE article_type END"


@query(f"""WITH {ad.ARTICLES_SQL}, t AS (SELECT a.*, n_name AS source, {MATRIX_TYPE} AS kind FROM a JOIN nation ON n_nationkey = source_id)
SELECT story_id, source, {', '.join(f"count(*) FILTER (kind = '{t}') AS n_{t.lower()}, coalesce(string_agg(CAST(article_id AS VARCHAR), ' ' ORDER BY published_at DESC NULLS LAST, article_id DESC) FILTER (kind = '{t}'), '') AS ids_{t.lower()}" for t in cov.TYPES)}, count(*) AS n_total FROM t GROUP BY ALL""")
def coverage_matrix(spark, d):
    m = cov.coverage_matrix(ad.coverage_articles(spark, d), ad.coverage_sources(spark, d))
    return m.select("story_id", "source", "n_total", *[f"n_{t.lower()}" for t in cov.TYPES], *[joined(f"ids_{t.lower()}").alias(f"ids_{t.lower()}") for t in cov.TYPES])


GAP_TYPES = ("FACT", "INTERPRETATION", "COMMENTARY")


@query(f"""WITH {ad.ARTICLES_SQL}, t AS (SELECT a.*, n_name AS source, coalesce(article_type, 'FACT') AS kind FROM a JOIN nation ON n_nationkey = source_id),
p AS (SELECT story_id, source, count(*) AS n, {', '.join(f"count(*) FILTER (kind = '{t}') AS {t}" for t in GAP_TYPES)} FROM t GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, source) AS rn FROM p),
s AS (SELECT story_id, CAST(sum(n) AS BIGINT) AS total_articles, count(*) AS sources_count, {', '.join(f"CAST(sum({t}) AS BIGINT) AS n_{t.lower()}" for t in GAP_TYPES)}, max(source) FILTER (rn = 1) AS dominant_source, max(n) / sum(n) AS ratio FROM q GROUP BY story_id),
u AS (SELECT *, total_articles < 4 OR sources_count < 3 AS few, concat_ws(' ', {', '.join(f"CASE WHEN n_{t.lower()} = 0 THEN '{t}' END" for t in GAP_TYPES)}) AS missing_types FROM s),
v AS (SELECT *, CASE WHEN few THEN '' ELSE concat_ws(' ', CASE WHEN missing_types <> '' THEN 'MISSING_TYPES' END, CASE WHEN ratio > 0.6 THEN 'DOMINANT_SOURCE' END) END AS codes FROM u)
SELECT story_id, total_articles, sources_count, n_fact, n_interpretation, n_commentary, dominant_source, round(ratio, 6) AS dominant_ratio, missing_types, codes, CASE WHEN few THEN 'INSUFFICIENT_DATA' WHEN codes <> '' THEN 'GAP_FOUND' ELSE 'NO_GAP' END AS status FROM v""")
def gap_hints(spark, d):
    g = cov.gap_hints(ad.coverage_articles(spark, d), ad.coverage_sources(spark, d))
    return g.select("story_id", "total_articles", "sources_count", "n_fact", "n_interpretation", "n_commentary", "dominant_source", r6("dominant_ratio").alias("dominant_ratio"), joined("missing_types").alias("missing_types"), joined("codes").alias("codes"), "status")


STATUS_SQL = f"""WITH {ad.ARTICLES_SQL}, l AS (SELECT story_id, max(published_at) AS seen FROM a GROUP BY story_id)
SELECT story_id, CASE WHEN {HOURS_SQL.format(NOW_SQL, 'seen')} <= 96 THEN 'active' WHEN {HOURS_SQL.format(NOW_SQL, 'seen')} <= 240 THEN 'closing' ELSE 'closed' END AS status FROM l"""


def _status(spark, d):
    last = ad.coverage_articles(spark, d).groupBy("story_id").agg(F.max("published_at").alias("at"))
    return last.select("story_id", cov.story_status(F.col("at"), ad.as_of()).alias("status"))


@query(STATUS_SQL)
def story_status(spark, d):
    return _status(spark, d)


@query(f"SELECT status, count(*) AS n FROM ({STATUS_SQL}) GROUP BY status")
def status_histogram(spark, d):
    return _status(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {ad.TITLED_SQL} SELECT id, title, published_at FROM d WHERE id NOT IN (SELECT vec_id FROM embeddings) ORDER BY published_at DESC, id DESC LIMIT 300")
def unassigned_articles(spark, d):
    e = ad.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return ad.titled_articles(spark, d).select("id", "title", "published_at").join(e, "id", "left_anti").orderBy(F.col("published_at").desc(), F.col("id").desc()).limit(300)


@query("SELECT o_orderkey AS story_id, o_orderstatus AS status, count(l_orderkey) AS articles_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def list_stories(spark, d):
    o, line = ad.read(spark, d, "orders"), ad.read(spark, d, "lineitem")
    per = line.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return o.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("story_id"), F.col("o_orderstatus").alias("status"), F.coalesce("n", F.lit(0)).alias("articles_count"))


@query("SELECT s_suppkey AS source_id, s_name AS name, count(l_orderkey) AS n, max(l_shipdate) AS latest FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL ORDER BY n DESC, source_id LIMIT 30")
def supply_report(spark, d):
    a = ad.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("published_at"))
    return ev.supply_report(ad.read(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name")), a)


@query(f"""WITH {ad.TITLED_SQL} SELECT (SELECT count(*) FROM d) AS articles, (SELECT count(*) FROM d WHERE {HOURS_SQL.format(NOW_SQL, 'published_at')} <= 168) AS recent_articles, (SELECT count(*) FROM d JOIN embeddings ON vec_id = id) AS embedded,
(SELECT count(*) FROM d JOIN labels ON doc_id = id) AS typed, (SELECT count(DISTINCT vec_id) FROM embeddings) AS linked, (SELECT count(DISTINCT label) FROM embeddings) AS stories, (SELECT count(DISTINCT label) FROM embeddings WHERE label % 2 = 0) AS with_signature""")
def funnel(spark, d):
    e = ad.read(spark, d, "embeddings")
    a = ad.titled_articles(spark, d).select("id", "published_at").join(e.select(F.col("vec_id").alias("id"), "embedding"), "id", "left").join(ad.read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("FACT").alias("article_type")), "id", "left")
    stories = e.select("label").distinct().select("label", F.when(F.col("label") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("signature_v0"))
    return ev.funnel(a, e.select(F.col("vec_id").alias("article_id")), stories, ad.as_of())


@query(f"WITH {ad.ARTICLES_SQL} SELECT (SELECT count(*) FROM a) AS articles, (SELECT count(*) FROM a WHERE article_type IS NULL) AS untyped, (SELECT count(DISTINCT story_id) FROM a) AS stories, (SELECT max(published_at) FROM a) AS latest, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events)) AS empty_stories")
def pipeline_probe(spark, d):
    a = ad.coverage_articles(spark, d)
    one = a.agg(F.count("*").alias("articles"), F.count_if(F.col("article_type").isNull()).alias("untyped"), F.countDistinct("story_id").alias("stories"), F.max("published_at").alias("latest"))
    return one.crossJoin(ad.coverage_stories(spark, d).join(a, "story_id", "left_anti").agg(F.count("*").alias("empty_stories")))


@query("SELECT date_trunc('day', ts) AS day, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS avg_k, CAST(sum(CASE WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_high FROM events GROUP BY ALL")
def gap_daily(spark, d):
    e = ad.read(spark, d, "events").select(F.col("ts").alias("created_at"), F.col("props").alias("metrics"))
    return ev.json_daily(e, ("avg_k", "avg", "metrics", "k"), ("n_high", 50, "metrics", "k")).select("day", "n", r6("avg_k").alias("avg_k"), "n_high")


@query("SELECT date_trunc('day', ts) AS day, event_type AS eval_type, max(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS max_k FROM events GROUP BY ALL")
def params_daily(spark, d):
    e = ad.read(spark, d, "events").select(F.col("ts").alias("created_at"), F.col("event_type").alias("eval_type"), F.concat(F.lit('{"weights": '), F.col("props"), F.lit("}")).alias("params"))
    return ev.json_daily(e, ("max_k", "max", "params", "weights.k"), by=("eval_type",)).drop("n")


def _logs(spark, d):
    """The evaluation log in its own shape, made of the click stream: even events are checks of gaps, odd ones runs of the top list."""
    e = ad.read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    gap = F.struct((F.col("k") >= 50).alias("gap_found"), (F.col("k") / 100).alias("dominant_source_ratio"), (F.col("k") % 4).alias("missing_type_count"))
    top = F.struct(F.col("k").alias("window_hours"), F.when(F.col("k") % 2 == 0, F.col("k") % 48).alias("tau_hours"), F.struct((F.col("k") / 100).alias("hot"), (F.col("k") / 200).alias("div")).alias("weights"))
    even = F.col("event_id") % 2 == 0
    return e.select(F.col("ts").alias("created_at"), F.when(even, "gap_hints_daily").otherwise("top_events_params").alias("eval_type"), F.when(even, F.to_json(gap)).alias("metrics"), F.when(~even, F.to_json(top)).alias("params"))


K_SQL = "SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_id % 2 = {0}"


@query(f"SELECT date_trunc('day', ts) AS day, count(*) AS events_checked, count(*) FILTER (k >= 50) AS events_with_gap, round(avg(k / 100), 6) AS avg_dominant_source_ratio, round(avg(k % 4), 6) AS avg_missing_type_count FROM ({K_SQL.format(0)}) GROUP BY ALL")
def gap_hints_by_day(spark, d):
    out = ev.gap_hints_daily(_logs(spark, d))
    return out.select("day", "events_checked", "events_with_gap", r6("avg_dominant_source_ratio").alias("avg_dominant_source_ratio"), r6("avg_missing_type_count").alias("avg_missing_type_count"))


@query(f"SELECT date_trunc('day', ts) AS day, count(*) AS runs, max(k) AS window_hours, max(CASE WHEN k % 2 = 0 THEN k % 48 END) AS tau_hours, round(max(k / 100), 6) AS w_hot, round(max(k / 200), 6) AS w_div, CAST(NULL AS DOUBLE) AS w_fresh FROM ({K_SQL.format(1)}) GROUP BY ALL")
def top_params_by_day(spark, d):
    return ev.top_events_params_daily(_logs(spark, d)).select("day", "runs", "window_hours", "tau_hours", r6("w_hot").alias("w_hot"), r6("w_div").alias("w_div"), "w_fresh")


@query(f"WITH {ad.ARTICLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY published_at DESC NULLS LAST, article_id DESC) AS rn FROM a) SELECT story_id, string_agg(CAST(article_id AS VARCHAR), ' ' ORDER BY rn) AS docs FROM r WHERE rn <= 5 GROUP BY story_id")
def newest_docs_per_story(spark, d):
    n = cov.newest_per_story(ad.coverage_articles(spark, d), 5)
    return n.groupBy("story_id").agg(joined(F.transform(F.sort_array(F.collect_list(F.struct("rn", "article_id"))), lambda x: x.article_id)).alias("docs"))


@query(f"WITH {ad.ARTICLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY published_at DESC NULLS LAST, article_id DESC) AS rn FROM a) SELECT story_id, article_id, published_at, rn FROM r WHERE rn <= 3")
def top_n_per_story(spark, d):
    return cov.newest_per_story(ad.coverage_articles(spark, d), 3).select("story_id", "article_id", "published_at", "rn")


@query(f"WITH {ad.ARTICLES_SQL}, p AS (SELECT story_id, source_id, count(*) AS source_articles FROM a GROUP BY ALL) SELECT *, round(source_articles / nullif(sum(source_articles) OVER (PARTITION BY story_id), 0), 6) AS share FROM p")
def source_share(spark, d):
    return rk.source_share(ad.coverage_articles(spark, d)).select("story_id", "source_id", "source_articles", r6("share").alias("share"))


@query(f"WITH {ad.ARTICLES_SQL} SELECT story_id, article_id, row_number() OVER (PARTITION BY story_id ORDER BY published_at DESC NULLS LAST, article_id DESC) AS position, 'TIME_ORDER' AS reason FROM a")
def diversity_time_order(spark, d):
    return cov.diversity_order(ad.coverage_articles(spark, d))


LIST_TYPE = "CASE WHEN article_type IS NULL THEN 'UNKNOWN' WHEN article_type = 'OPINION' THEN 'COMMENTARY' ELSE article_type END"
DIVERSE_SQL = f"""RECURSIVE {ad.ARTICLES_SQL}, r AS (SELECT story_id, article_id, source_id, {LIST_TYPE} AS kind, row_number() OVER (PARTITION BY story_id ORDER BY published_at DESC NULLS LAST, article_id DESC) AS i FROM a),
po AS (SELECT story_id, list(struct_pack(i := i, a := article_id, s := source_id, k := kind) ORDER BY i) AS rest, count(*) AS n FROM r GROUP BY story_id),
st AS (SELECT story_id, n, CAST(ceil(0.6 * n) AS BIGINT) AS cap, 0 AS step, rest, rest[1:0] AS taken, '' AS why FROM po
UNION ALL SELECT story_id, n, cap, step + 1, list_filter(rest, lambda x: x.i <> pick.i), list_append(taken, pick), why FROM (
SELECT story_id, n, cap, step, rest, taken, coalesce(fresh, of_type[1], under[1], rest[1]) AS pick, CASE WHEN fresh IS NOT NULL THEN 'NEW_SOURCE' WHEN len(of_type) > 0 THEN 'TYPE_COVERAGE' WHEN len(under) > 0 THEN 'BASELINE_FILL' ELSE 'CAP_RELAXED_FILL' END AS why FROM (
SELECT *, list_filter(under, lambda x: x.k = goal) AS of_type FROM (
SELECT *, list_filter(rest, lambda x: x.s IS NOT NULL AND len(list_filter(taken, lambda t: t.s = x.s)) = 0)[1] AS fresh, list_filter(rest, lambda x: x.s IS NULL OR len(list_filter(taken, lambda t: t.s = x.s)) < cap) AS under,
list_sort(list_transform(list_distinct(list_transform(rest, lambda x: x.k)), lambda y: struct_pack(c := len(list_filter(taken, lambda t: t.k = y)), k := y)))[1].k AS goal FROM st WHERE step < n))))"""


@query(f"WITH {DIVERSE_SQL} SELECT story_id, taken[step].a AS article_id, step AS position, why AS reason FROM st WHERE step > 0")
def diversity_30(spark, d):
    return cov.diversity_order(ad.coverage_articles(spark, d), 30)


@query(f"""WITH {DIVERSE_SQL}, ch AS (SELECT story_id, taken[step].s AS source, taken[step].k AS kind FROM st WHERE step > 0), ks AS (SELECT story_id, kind, count(*) AS n FROM ch GROUP BY ALL), ss AS (SELECT story_id, source, count(*) AS n FROM ch WHERE source IS NOT NULL GROUP BY ALL)
SELECT story_id, (SELECT string_agg(concat(kind, '=', n), ' ' ORDER BY kind) FROM ks WHERE ks.story_id = po.story_id) AS by_kind, (SELECT string_agg(concat(source, '=', n), ' ' ORDER BY CAST(source AS VARCHAR)) FROM ss WHERE ss.story_id = po.story_id) AS by_source FROM po""")
def diversity_histograms(spark, d):
    a = ad.coverage_articles(spark, d)
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e.key, F.lit("="), e.value)), " ")
    return cov.diversity_histograms(cov.diversity_order(a, 30), a).select("story_id", text("by_kind").alias("by_kind"), text("by_source").alias("by_source"))


@query(f"""WITH {ad.ARTICLES_SQL}, t AS (SELECT a.*, n_name AS source, {MATRIX_TYPE} AS kind FROM a JOIN nation ON n_nationkey = source_id)
SELECT story_id, {', '.join(f"count(*) FILTER (kind = '{t}') AS n_{t.lower()}" for t in cov.TYPES)}, count(*) AS n_total, count(DISTINCT source) AS n_sources FROM t GROUP BY story_id""")
def coverage_totals(spark, d):
    return cov.coverage_totals(cov.coverage_matrix(ad.coverage_articles(spark, d), ad.coverage_sources(spark, d)))


DETAIL_SQL = f"""{ad.ARTICLES_SQL}, o AS (SELECT story_id FROM a GROUP BY story_id ORDER BY count(*) DESC, story_id LIMIT 1), w AS (SELECT a.* FROM a JOIN o USING (story_id)),
h AS (SELECT *, row_number() OVER (ORDER BY published_at DESC NULLS LAST, article_id DESC) AS position FROM w WHERE {HOURS_SQL.format(NOW_SQL, 'published_at')} <= 720)"""


def _detail(spark, d, part):
    a = ad.coverage_articles(spark, d)
    largest = a.groupBy("story_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "story_id").first()["story_id"]
    return cov.story_detail(largest, a, ad.coverage_stories(spark, d), ad.coverage_sources(spark, d), ad.as_of())[part]


@query(f"WITH {DETAIL_SQL} SELECT story_id, article_id, position, n_name AS source, 'Unknown' AS country, {LIST_TYPE} AS type, published_at FROM h LEFT JOIN nation ON n_nationkey = source_id")
def story_page_articles(spark, d):
    """The page of the story with the most articles."""
    return _detail(spark, d, "articles").select("story_id", "article_id", "position", "source", "country", "type", "published_at")


@query(f"""WITH {DETAIL_SQL} SELECT w.story_id, any_value(substr(text, 1, 120)) AS title, min(published_at) AS start_time, count(*) AS articles_count, count(DISTINCT source_id) AS sources_count, strftime(max(published_at), '%Y-%m-%dT%H:%M:%S') AS last_seen_text,
CASE WHEN {HOURS_SQL.format(NOW_SQL, 'max(published_at)')} <= 96 THEN 'active' WHEN {HOURS_SQL.format(NOW_SQL, 'max(published_at)')} <= 240 THEN 'closing' ELSE 'closed' END AS status FROM w JOIN documents ON doc_id = w.story_id GROUP BY w.story_id""")
def story_page_summary(spark, d):
    return _detail(spark, d, "summary").select("story_id", "title", "start_time", "articles_count", "sources_count", "last_seen_text", "status")


@query()
def rerank_top(spark, d):
    return rk.rerank(_top(spark, d), 5)


@query(f"WITH {ad.TITLED_SQL}, g AS (SELECT source, max(published_at) AS latest, count(*) AS n FROM d GROUP BY source) SELECT *, row_number() OVER (ORDER BY latest DESC NULLS LAST, n DESC, source) AS position, row_number() OVER (ORDER BY latest DESC NULLS LAST, n DESC, source) = 1 AS featured FROM g")
def source_grouping(spark, d):
    return cov.source_groups(ad.titled_articles(spark, d))


@query(f"WITH {ad.ARTICLES_SQL}, s AS (SELECT story_id, min(published_at) AS lo, max(published_at) AS hi FROM a GROUP BY story_id) SELECT doc_id AS story_id, coalesce(lo, {NOW_SQL}) AS range_start, greatest(hi, {NOW_SQL} - INTERVAL 15 DAY, NULL) AS range_end FROM documents LEFT JOIN s ON story_id = doc_id")
def coverage_range(spark, d):
    s = ad.coverage_stories(spark, d).select("story_id", ad.as_of().alias("start_time"), (ad.as_of() - F.make_dt_interval(F.lit(15))).alias("end_time"), F.lit(None).cast("timestamp_ntz").alias("last_seen_at"))
    return cov.coverage_range(ad.coverage_articles(spark, d), s)


NORM_SQL = f"list_filter(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) > 1 AND t NOT IN ({words_sql(TITLE_STOP_WORDS)}))"
STEM_SQL = "list_transform({0}, lambda t: CASE " + " ".join(f"WHEN ends_with(t, '{s}') AND length(t) > {len(s) + 2} THEN left(t, length(t) - {len(s)})" for s in ("ing", "ed", "es", "s")) + " ELSE t END)"
SIMPLE_SQL = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+'), lambda t: length(t) >= 3))"
WORD_SQL = r"list_transform(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9\-]{1,}'), lambda t: lower(t))"


@query(f"WITH {ad.TITLED_SQL} SELECT id, list_aggregate(list_sort({SIMPLE_SQL}), 'string_agg', ' ') AS tokens FROM d")
def tokens_simple(spark, d):
    t = F.sort_array(tx.tokens_simple(F.col("title")))
    return ad.titled_articles(spark, d).select("id", F.when(F.size(t) > 0, joined(t)).alias("tokens"))


@query(f"WITH {ad.TITLED_SQL} SELECT id, coalesce(list_aggregate({STEM_SQL.format(NORM_SQL)}, 'string_agg', ' '), '') AS tokens FROM d")
def tokens_norm(spark, d):
    return ad.titled_articles(spark, d).select("id", joined(tx.tokens_norm(F.col("title"))).alias("tokens"))


@query(f"WITH {ad.TITLED_SQL} SELECT id, coalesce(list_aggregate({WORD_SQL}, 'string_agg', ' '), '') AS words, coalesce(list_aggregate({NORM_SQL}, 'string_agg', ' '), '') AS eval_tokens FROM d")
def tokens_word_eval(spark, d):
    return ad.titled_articles(spark, d).select("id", joined(tx.tokens_word(F.col("title"))).alias("words"), joined(tx.tokens_eval(F.col("title"))).alias("eval_tokens"))


def _neighbours(spark, d):
    order = W.partitionBy("source").orderBy("id")
    a = ad.titled_articles(spark, d).select("id", "source", "title")
    return a.withColumn("next_id", F.lead("id").over(order)).withColumn("next_title", F.lead("title").over(order)).where("next_id IS NOT NULL")


NEXT_SQL = ad.TITLED_SQL + ", w AS (SELECT id, title, lead(id) OVER (PARTITION BY source ORDER BY id) AS next_id, lead(title) OVER (PARTITION BY source ORDER BY id) AS next_title FROM d), p AS (SELECT * FROM w WHERE next_id IS NOT NULL)"


def jaccard_sql(a: str, b: str, empty: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {empty} ELSE len(list_intersect({a}, {b})) / greatest(1, len(list_distinct(list_concat({a}, {b})))) END"


@query(f"""WITH {NEXT_SQL}, t AS (SELECT id, next_id, list_distinct({STEM_SQL.format(NORM_SQL)}) AS n1, list_distinct({STEM_SQL.format(NORM_SQL.replace('title', 'next_title'))}) AS n2, {SIMPLE_SQL} AS s1, {SIMPLE_SQL.replace('title', 'next_title')} AS s2,
list_distinct({WORD_SQL}) AS w1, list_distinct({WORD_SQL.replace('title', 'next_title')}) AS w2, list_distinct({NORM_SQL}) AS e1, list_distinct({NORM_SQL.replace('title', 'next_title')}) AS e2 FROM p)
SELECT id, next_id, round({jaccard_sql('s1', 's2', '0.0')}, 6) AS simple, round({jaccard_sql('n1', 'n2', '1.0')}, 6) AS norm, round({jaccard_sql('w1', 'w2', '1.0')}, 6) AS word, round({jaccard_sql('e1', 'e2', '1.0')}, 6) AS eval FROM t""")
def title_jaccard_pairs(spark, d):
    j = lambda f, e=1.0: r6(tx.jaccard(f(F.col("title")), f(F.col("next_title")), e))
    return _neighbours(spark, d).select("id", "next_id", j(tx.tokens_simple, 0.0).alias("simple"), j(tx.tokens_norm).alias("norm"), j(tx.tokens_word).alias("word"), j(tx.tokens_eval).alias("eval"))


#: The tables' words are invented, so the query denies and asserts with words that occur.
DENY, ASSERT = ["the", "der", "les"], ["and", "die", "des"]


@query(f"""WITH {NEXT_SQL}, t AS (SELECT id, next_id, {SIMPLE_SQL} AS a, {SIMPLE_SQL.replace('title', 'next_title')} AS b FROM p)
SELECT id, next_id, len(list_intersect(a, b)) >= 2 AND ((list_has_any(a, {DENY}) AND list_has_any(b, {ASSERT})) OR (list_has_any(b, {DENY}) AND list_has_any(a, {ASSERT}))) AS conflict FROM t""")
def conflicting_titles(spark, d):
    return _neighbours(spark, d).select("id", "next_id", tx.conflicting_titles(F.col("title"), F.col("next_title"), DENY, ASSERT).alias("conflict"))


def fuzz_sql(pairs: str) -> str:
    """CTEs that end in fz: the rows of pairs, which has the sorted tokens a and b, with their fuzzy ratio as fuzz; the common length by the rows of the usual table."""
    return f"""s AS (SELECT *, array_to_string(list_filter(a, lambda x: list_contains(b, x)), ' ') AS c, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ' ') AS l, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ' ') AS r FROM {pairs}),
u AS (SELECT l, r, 0 AS step, list_transform(range(length(l) + 1), lambda j: 0) AS tab FROM (SELECT DISTINCT l, r FROM s)
UNION ALL SELECT l, r, step + 1, list_concat([0], list_transform(range(1, length(l) + 1), lambda j: list_max(new[1:j]))) FROM (SELECT *, list_transform(range(1, length(l) + 1), lambda j: CASE WHEN l[j] = r[step + 1] THEN tab[j] + 1 ELSE tab[j + 1] END) AS new FROM u WHERE step < length(r))),
m AS (SELECT l, r, tab[-1] AS common FROM u WHERE step = length(r)),
z AS (SELECT *, CASE WHEN c = '' THEN 0 ELSE length(c) + 1 END AS k FROM s JOIN m USING (l, r)),
fz AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 WHEN c <> '' AND (l = '' OR r = '') THEN 100.0 ELSE greatest(200.0 * (k + common)::DOUBLE / (2 * k + length(l) + length(r)), CASE WHEN c = '' THEN 0.0 ELSE greatest(200.0 * length(c)::DOUBLE / (length(c) + k + length(l)), 200.0 * length(c)::DOUBLE / (length(c) + k + length(r))) END) END AS fuzz FROM z)"""


@query(f"""WITH RECURSIVE {NEXT_SQL}, t AS (SELECT id, next_id, list_sort(list_distinct({STEM_SQL.format(NORM_SQL)})) AS a, list_sort(list_distinct({STEM_SQL.format(NORM_SQL.replace('title', 'next_title'))})) AS b FROM p),
{fuzz_sql('t')} SELECT id, next_id, round(fuzz, 4) AS ratio FROM fz""")
def fuzzy_titles(spark, d):
    return _neighbours(spark, d).select("id", "next_id", F.round(token_set_ratio(F.col("title"), F.col("next_title")), 4).alias("ratio"))


#: Lexicons of words that occur in the pages; single words without word boundaries that engines see differently.
PAGE_LEXICON = {"URL_OPINION": ["/en/1"], "URL_ANALYSIS": ["/en/2"], "TITLE_OPINION": ["for ble"], "TITLE_ANALYSIS": ["was eres"]}


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages)
SELECT page_id, CASE WHEN regexp_matches(url, '(?i)/en/1') THEN 'COMMENTARY' WHEN regexp_matches(url, '(?i)/en/2') THEN 'INTERPRETATION' WHEN regexp_matches(title, '(?i)^\s*for ble\s*:') THEN 'COMMENTARY' WHEN regexp_matches(title, '(?i)^\s*was eres\s*:') THEN 'INTERPRETATION' ELSE 'FACT' END AS type,
CASE WHEN regexp_matches(url, '(?i)/en/1') THEN 'URL_OPINION' WHEN regexp_matches(url, '(?i)/en/2') THEN 'URL_ANALYSIS' WHEN regexp_matches(title, '(?i)^\s*for ble\s*:') THEN 'TITLE_PREFIX_OPINION' WHEN regexp_matches(title, '(?i)^\s*was eres\s*:') THEN 'TITLE_PREFIX_ANALYSIS' ELSE 'DEFAULT_FACT' END AS reason FROM p""")
def article_types(spark, d):
    p = ad.read(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    t = tx.article_type(F.col("title"), F.lit(None).cast("string"), F.col("url"), **{k.lower(): v for k, v in PAGE_LEXICON.items()})
    return p.select("page_id", t.alias("t")).select("page_id", "t.type", "t.reason")


@query(f"""WITH {ad.ARTICLES_SQL} SELECT article_id, CASE WHEN article_type IS NULL THEN 'UNKNOWN' WHEN article_type = 'OPINION' THEN 'COMMENTARY' ELSE article_type END AS list_type, {MATRIX_TYPE} AS matrix_type, coalesce(article_type, 'FACT') AS gap_type FROM a""")
def effective_types(spark, d):
    t = F.col("article_type")
    return ad.coverage_articles(spark, d).select("article_id", tx.effective_type(t, "list").alias("list_type"), tx.effective_type(t, "matrix").alias("matrix_type"), tx.effective_type(t, "gap").alias("gap_type"))


def _doc_stories(spark, d):
    """One story per article of the documents: its title, its time, and the words of title and summary as signature."""
    a = ad.titled_articles(spark, d)
    return a.select(F.col("id").alias("story_id"), "title", "summary", F.col("published_at").alias("ts"))


TERMS_SQL = r"list_filter(list_transform(regexp_extract_all(regexp_replace({0}, 'https?://\S+|www\.\S+', ' ', 'g'), '[A-Za-z][A-Za-z0-9\-]{{1,}}'), lambda t: regexp_replace(lower(t), '^[-'']+|[-'']+$', '', 'g')), lambda t: length(t) >= 2 AND t NOT IN (" + words_sql(SIGNATURE_STOP_WORDS) + "))"
SIG_SQL = f"""{ad.TITLED_SQL}, p AS (SELECT id, 0 AS o, 4 AS w, {TERMS_SQL.format('title')} AS t FROM d UNION ALL SELECT id, 1, 2, {TERMS_SQL.format('title')} FROM d UNION ALL SELECT id, 2, 1, {TERMS_SQL.format('summary')} FROM d),
e AS (SELECT id, o, w, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM p), vt AS (SELECT id, term, sum(w) AS votes, min(o * 100000 + i) AS first FROM e GROUP BY id, term),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, first) AS rn FROM vt), sig AS (SELECT id, list(term ORDER BY rn) AS signature FROM rk WHERE rn <= 12 GROUP BY id)"""


def _signed(spark, d):
    s = _doc_stories(spark, d)
    sig = mg.signatures(s.select("story_id", "title"), s.select("story_id", F.lit(1).alias("rn"), "title", "summary"), phrases=False)
    return s.select("story_id", "title", "ts").join(sig, "story_id")


@query(f"WITH {SIG_SQL} SELECT id AS story_id, array_to_string(signature, ' ') AS signature FROM sig")
def signatures(spark, d):
    return _signed(spark, d).select("story_id", joined("signature").alias("signature"))


DF_SQL = SIG_SQL + ", n AS (SELECT count(*) AS n FROM sig), df AS (SELECT unnest(list_distinct(signature)) AS token, count(*) AS df FROM sig GROUP BY 1), idf AS (SELECT token, df, ln((n + 1) / (df + 1)) + 1 AS idf FROM df, n)"


@query(f"WITH {DF_SQL} SELECT token, df, round(idf, 6) AS idf FROM idf")
def df_idf(spark, d):
    return mg.df_idf(_signed(spark, d)).select("token", "df", r6("idf").alias("idf"))


#: The longest list that a token may have, as a share of the stories.
RATIO = 0.35
CAND_SQL = f"""{DF_SQL}, po AS (SELECT id, published_at AS ts, unnest(list_distinct(signature)) AS token FROM sig JOIN d USING (id)),
pr AS (SELECT po.*, idf, df FROM po JOIN idf USING (token), n WHERE df <= greatest(2, floor(n * {RATIO}))),
pa AS (SELECT x.id AS a, y.id AS b, sum(x.idf) AS weight, list_sort(list(x.token)) AS tokens, min(x.df) AS df_min FROM pr x JOIN pr y ON x.token = y.token AND (x.ts > y.ts OR (x.ts = y.ts AND x.id > y.id)) GROUP BY ALL),
tp AS (SELECT max(weight) AS top FROM pa),
sc AS (SELECT a, b, weight, tokens, df_min, abs(epoch_us(da.published_at) - epoch_us(db.published_at)) / 3.6e9 AS hours, list_distinct({WORD_SQL.replace('title', 'da.title')}) AS w1, list_distinct({WORD_SQL.replace('title', 'db.title')}) AS w2, top FROM pa JOIN d da ON da.id = a JOIN d db ON db.id = b, tp),
sd AS (SELECT *, {jaccard_sql('w1', 'w2', '1.0')} AS jac FROM sc WHERE hours <= 72),
se AS (SELECT *, round(0.70 * least(1, weight / top) + 0.20 * jac + 0.10 * greatest(0, 1 - hours / 72), 4) AS score FROM sd),
ca AS (SELECT * FROM se WHERE NOT (score < 0.10 AND weight < 1.5) ORDER BY score DESC, round(weight, 6) DESC, a, b LIMIT 60)"""


def _candidates(spark, d):
    return mg.merge_candidates(_signed(spark, d), max_df_ratio=RATIO)


@query(f"WITH {CAND_SQL} SELECT a, b, score, round(weight, 4) AS weight, array_to_string(tokens[1:8], ' ') AS evidence, df_min, round(hours, 6) AS hours, round(jac, 6) AS title_jaccard FROM ca")
def merge_candidates(spark, d):
    return _candidates(spark, d).select("a", "b", "score", "weight", joined("evidence").alias("evidence"), "df_min", "hours", "title_jaccard")


GENERIC_SQL = "'world', 'united states', 'new york', 'breaking', 'news', 'cup', 'government', 'election'"


def judge_sql(cached: str, budget: int) -> str:
    return f"""WITH {CAND_SQL}, ju AS (SELECT a, b, score, round(weight, 4) AS weight, CAST(len(list_filter(tokens[1:8], lambda t: t NOT IN ({GENERIC_SQL}))) AS INT) AS strong, df_min, hours, jac FROM ca),
ru AS (SELECT *, CASE WHEN strong = 0 AND jac < 0.20 THEN 'RULE_NO_GENERIC_ONLY' WHEN score >= 0.78 THEN 'RULE_HIGH_SCORE' WHEN df_min <= 2 AND weight >= 6 AND strong >= 1 THEN 'RULE_RARE_TOKEN_STRONG' WHEN strong >= 3 AND score >= 0.45 AND hours <= 36 THEN 'RULE_MULTI_TOKEN_STRONG' WHEN score BETWEEN 0.45 AND 0.70 THEN 'GREY' ELSE 'RULE_NO' END AS rule,
CASE WHEN {cached} THEN CASE WHEN (a + b) % 2 = 0 THEN 'NO_MERGE' ELSE 'SUGGEST_MERGE' END END AS cached FROM ju),
bu AS (SELECT *, coalesce(sum(CASE WHEN rule = 'GREY' AND cached IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY score DESC, weight DESC, a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM ru),
pt AS (SELECT *, CASE WHEN rule = 'GREY' AND spent < {budget} THEN 'LLM_GREY_ZONE' WHEN rule = 'GREY' THEN 'RULE_NO' ELSE rule END AS decision_path FROM bu)
SELECT least(a, b) AS a, greatest(a, b) AS b, score, CASE WHEN decision_path IN ('RULE_HIGH_SCORE', 'RULE_RARE_TOKEN_STRONG', 'RULE_MULTI_TOKEN_STRONG') OR (decision_path = 'LLM_GREY_ZONE' AND coalesce(cached = 'SUGGEST_MERGE', strong >= 2)) THEN 'SUGGEST_MERGE' ELSE 'NO_MERGE' END AS decision, decision_path, strong FROM pt"""


@query(judge_sql("false", 20))
def merge_judge(spark, d):
    return mg.merge_judge(_candidates(spark, d))


@query(judge_sql("a % 3 = 0", 3))
def merge_judge_cached(spark, d):
    """With judgements from before for a third of the stories' pairs, and a budget that the others use up."""
    pairs = saved(_candidates(spark, d), shared_dir(spark))
    decision = F.when((F.col("a") + F.col("b")) % 2 == 0, "NO_MERGE").otherwise("SUGGEST_MERGE")
    return mg.merge_judge(pairs, pairs.where("a % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"), decision.alias("decision")), budget=3)


KNN_SQL = ad.EMBEDDED_SQL + ", k AS (SELECT q.id AS query_id, c.id AS article_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS sim, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) DESC, c.id) AS rn, c.story_id FROM v q JOIN v c ON q.id <> c.id {where})"
SEVEN_DAYS = "AND abs(epoch_us(q.published_at) - epoch_us(c.published_at)) <= 604800000000"


@query(f"WITH {KNN_SQL.format(where='')} SELECT query_id, article_id, round(sim, 5) AS sim FROM k WHERE rn <= 5")
def knn_articles(spark, d):
    v = ad.embedded_articles(spark, d)
    return nearest(v, v, 5).select("query_id", "article_id", F.round("sim", 5).alias("sim"))


CANDIDATES_SQL = KNN_SQL.format(where=SEVEN_DAYS) + ", b AS (SELECT query_id, story_id, max(sim) AS best_sim FROM k WHERE rn <= 2000 GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_sim DESC, story_id) AS rank FROM b)"


def _story_candidates(spark, d, n=20):
    v = ad.embedded_articles(spark, d)
    return cl.candidate_stories(v, v, v.select(F.col("id").alias("article_id"), "story_id"), 7, 2000, n)


@query(f"WITH {CANDIDATES_SQL} SELECT query_id, story_id, round(best_sim, 5) AS best_sim, rank FROM c WHERE rank <= 20")
def candidate_stories(spark, d):
    return _story_candidates(spark, d).select("query_id", "story_id", F.round("best_sim", 5).alias("best_sim"), "rank")


@query(f"""WITH {KNN_SQL.format(where='')}, b AS (SELECT query_id, story_id, max(sim) AS best_sim FROM k WHERE rn <= 200 GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_sim DESC, story_id) AS rank FROM b)
SELECT query_id, story_id, round(best_sim, 5) AS best_sim, rank FROM c WHERE rank <= 20""")
def retrieve_candidates(spark, d):
    """Without a gate on time."""
    v = ad.embedded_articles(spark, d)
    return cl.candidate_stories(v, v, v.select(F.col("id").alias("article_id"), "story_id"), None, 200, 20).select("query_id", "story_id", F.round("best_sim", 5).alias("best_sim"), "rank")


@query(f"""WITH {KNN_SQL.format(where=SEVEN_DAYS)}, w AS (SELECT *, row_number() OVER (PARTITION BY query_id, story_id ORDER BY sim DESC, article_id) AS per FROM k WHERE rn <= 2000)
SELECT query_id, story_id, round(max(sim), 5) AS best_sim FROM w WHERE per <= 3 GROUP BY ALL""")
def cap_noop(spark, d):
    """Q05: the SQL caps articles per story, the query does not; the maxima are the same."""
    return _story_candidates(spark, d, 1 << 30).select("query_id", "story_id", F.round("best_sim", 5).alias("best_sim"))


@query(f"""WITH {CANDIDATES_SQL}, f AS (SELECT v.id, min(rank) AS rank FROM v LEFT JOIN c ON c.query_id = v.id AND c.story_id = v.story_id GROUP BY v.id)
SELECT k.k, count(*) FILTER (rank <= k.k) AS hits, count(*) AS n, round(count(*) FILTER (rank <= k.k) / count(*), 6) AS recall FROM f, (SELECT unnest([10, 20, 50]) AS k) k GROUP BY k.k""")
def retrieval_recall(spark, d):
    labels = ad.embedded_articles(spark, d).select(F.col("id").alias("query_id"), F.col("story_id").alias("true_story_id"))
    return ev.retrieval_recall(labels, _story_candidates(spark, d, 50)).select("k", "hits", "n", r6("recall").alias("recall"))


@query(f"WITH {CANDIDATES_SQL}, p AS (SELECT query_id, count(*) AS n FROM c WHERE rank <= 20 GROUP BY query_id) SELECT round(avg(n), 6) AS mean_candidates, round(quantile_cont(n, 0.95), 6) AS p95_candidates, count(*) AS queries FROM p")
def recall_percentiles(spark, d):
    return ev.recall_percentiles(_story_candidates(spark, d)).select(r6("mean_candidates").alias("mean_candidates"), r6("p95_candidates").alias("p95_candidates"), "queries")


def _named_stories(spark, d):
    """A story per label of the vectors: the title of its smallest article, its last time, closed where the label is a multiple of four."""
    v = ad.embedded_articles(spark, d)
    return v.groupBy("story_id").agg(F.min_by("title", "id").alias("title"), F.max("published_at").alias("end_time")).withColumn("status", F.when(F.col("story_id") % 4 == 0, "closed").otherwise("active"))


@query(f"""WITH {CANDIDATES_SQL}, st AS (SELECT story_id, arg_min(title, id) AS title, max(published_at) AS end_time FROM v GROUP BY story_id),
o AS (SELECT c.query_id, c.story_id, best_sim, list_distinct({STEM_SQL.format(NORM_SQL.replace('title', 'v.title'))}) AS w1, list_distinct({STEM_SQL.format(NORM_SQL.replace('title', 'st.title'))}) AS w2, row_number() OVER (PARTITION BY c.query_id ORDER BY best_sim DESC, c.story_id) AS rn FROM c JOIN v ON v.id = c.query_id JOIN st ON st.story_id = c.story_id WHERE rank <= 20 AND c.story_id % 4 <> 0),
e AS (SELECT *, {jaccard_sql('w1', 'w2', '1.0')} AS jac FROM o WHERE rn = 1),
x AS (SELECT v.id AS query_id, e.story_id, best_sim, jac, CASE WHEN best_sim IS NULL THEN 'new' WHEN best_sim < 0.74 AND jac <= 0.01 THEN 'new' WHEN best_sim >= 0.62 THEN 'merge' ELSE 'new' END AS action FROM v LEFT JOIN e ON e.query_id = v.id)
SELECT query_id, action, CASE WHEN action = 'merge' THEN story_id END AS story_id, round(best_sim, 5) AS best_sim, round(jac, 6) AS jac FROM x""")
def cluster_dry_run(spark, d):
    v = ad.embedded_articles(spark, d)
    out = cl.cluster_dry_run(v, v, v.select(F.col("id").alias("article_id"), "story_id"), _named_stories(spark, d), fuzzy=False)
    return out.select("query_id", "action", "story_id", F.round("best_sim", 5).alias("best_sim"), r6("jac").alias("jac"))


@query(f"""WITH RECURSIVE {CANDIDATES_SQL}, st AS (SELECT story_id, arg_min(title, id) AS title, max(published_at) AS end_time FROM v GROUP BY story_id),
t AS (SELECT c.query_id, c.story_id, best_sim, v.published_at, st.end_time, list_sort(list_distinct({STEM_SQL.format(NORM_SQL.replace('title', 'v.title'))})) AS a, list_sort(list_distinct({STEM_SQL.format(NORM_SQL.replace('title', 'st.title'))})) AS b
      FROM c JOIN v ON v.id = c.query_id JOIN st ON st.story_id = c.story_id WHERE rank <= 20 AND c.story_id % 4 <> 0 QUALIFY best_sim = max(best_sim) OVER (PARTITION BY c.query_id)),
{fuzz_sql('t')},
o AS (SELECT *, {jaccard_sql('a', 'b', '1.0')} AS jac FROM fz QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fuzz DESC, story_id) = 1),
x AS (SELECT v.id AS query_id, o.story_id, best_sim, fuzz, jac, CASE WHEN best_sim IS NULL OR (best_sim < 0.74 AND jac <= 0.01 AND fuzz < 45) THEN 'new' WHEN best_sim >= 0.62 OR (best_sim >= 0.54 AND fuzz >= 45) OR fuzz >= 85 OR (fuzz >= 60 AND (jac >= 0.20 OR coalesce(abs({HOURS_SQL.format('o.published_at', 'end_time')}) <= 6, false))) THEN 'merge' ELSE 'new' END AS action FROM v LEFT JOIN o ON o.query_id = v.id)
SELECT query_id, action, CASE WHEN action = 'merge' THEN story_id END AS story_id, round(best_sim, 5) AS best_sim, round(fuzz, 4) AS fuzz, round(jac, 6) AS jac FROM x""")
def cluster_decisions(spark, d):
    """X14 to X17 with the fuzzy ratio, every vector being a query."""
    v = ad.embedded_articles(spark, d)
    out = cl.cluster_dry_run(v, v, v.select(F.col("id").alias("article_id"), "story_id"), _named_stories(spark, d))
    return out.select("query_id", "action", "story_id", F.round("best_sim", 5).alias("best_sim"), F.round("fuzz", 4).alias("fuzz"), r6("jac").alias("jac"))


@query()
def cluster_write(spark, d):
    v = ad.embedded_articles(spark, d).withColumn("story_id", F.col("story_id").cast("long"))
    links = v.where("id % 2 = 0").select(F.col("id").alias("article_id"), "story_id")
    stories = _named_stories(spark, d).withColumn("story_id", F.col("story_id").cast("long"))
    return cl.cluster(cl.newest_unassigned(v, links, ad.as_of()), v, links, stories, m=200)


#: Checksum of an ASCII text t by its bits: a step for each character, then one for each of its bits.
CRC_SQL = "CAST(xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(t, ''), lambda c: list_prepend(CAST(1000 + ascii(c) AS UBIGINT), list_transform(range(8), lambda b: 0::UBIGINT))))), lambda s, x: CASE WHEN x > 0 THEN xor(s, x - 1000) ELSE xor(s >> 1, (s & 1) * 3988292384::UBIGINT) END)) AS BIGINT)"


@query(f"""WITH {ad.TITLED_SQL}, w AS (SELECT id, unnest({STEM_SQL.format(NORM_SQL)}) AS t FROM d), h AS (SELECT id, {CRC_SQL} AS h FROM w), c AS (SELECT id, h % 384 AS i, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS n FROM h GROUP BY ALL),
g AS (SELECT id, count(*) FILTER (n <> 0) AS nonzero, CAST(sum(sign(n) * i) AS BIGINT) AS signs, count(*) FILTER (n <> 0) > 0 AS filled FROM c GROUP BY id)
SELECT id, 384 AS width, coalesce(nonzero, 0) AS nonzero, coalesce(signs, 0) AS signs, CASE WHEN filled THEN 1.0::DOUBLE ELSE 0.0 END AS norm2 FROM d LEFT JOIN g USING (id)""")
def embed_titles(spark, d):
    a = ad.titled_articles(spark, d)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    places = F.aggregate(F.transform("embedding", lambda x, i: F.signum(x).cast("long") * i), F.lit(0).cast("long"), lambda s, x: s + x)
    return embed(a, tx.tokens_norm(F.col("title"))).select("id", F.size("embedding").alias("width"), F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("nonzero"), places.alias("signs"), F.round(square, 5).alias("norm2"))


AUDIT_SQL = f"""{TOP_SQL.strip().removeprefix('WITH')}, tt AS (SELECT story_id, title FROM t ORDER BY score DESC, last_seen_at DESC NULLS LAST, story_id DESC LIMIT 5),
ar AS (SELECT a.article_id, a.story_id, substr(d.text, 121, 120) AS title FROM a JOIN documents d ON d.doc_id = a.story_id WHERE a.story_id IN (SELECT story_id FROM tt)),
sm AS (SELECT article_id, ar.story_id, tt.story_id AS other, list_distinct({NORM_SQL.replace('title', 'ar.title')}) AS w1, list_distinct({NORM_SQL.replace('title', 'tt.title')}) AS w2 FROM ar, tt),
sj AS (SELECT *, {jaccard_sql('w1', 'w2', '1.0')} AS sim FROM sm),
au AS (SELECT article_id, story_id, max(sim) FILTER (other = story_id) AS self_sim, coalesce(max(sim) FILTER (other <> story_id), 0.0) AS best_other_sim FROM sj GROUP BY ALL)"""


@query(f"WITH {AUDIT_SQL} SELECT article_id, story_id, round(self_sim, 6) AS self_sim, round(best_other_sim, 6) AS best_other_sim, round(self_sim - best_other_sim, 6) AS margin, self_sim - best_other_sim <= 0 AS conflict, best_other_sim - self_sim >= 0.15 AS suspect FROM au")
def misattachment_audit(spark, d):
    out = _audit(spark, d)
    return out.select("article_id", "story_id", r6("self_sim").alias("self_sim"), r6("best_other_sim").alias("best_other_sim"), r6("margin").alias("margin"), "conflict", "suspect")


@query(f"WITH {AUDIT_SQL} SELECT round(avg(self_sim), 4) AS avg_title_match, round(avg(self_sim - best_other_sim), 4) AS avg_margin, round(avg(CASE WHEN self_sim - best_other_sim <= 0 THEN 1.0 ELSE 0.0 END), 4) AS conflict_rate, count(*) FILTER (best_other_sim - self_sim >= 0.15) AS suspects, count(*) AS articles FROM au")
def audit_summary(spark, d):
    return ev.audit_summary(_audit(spark, d))


def _audit(spark, d):
    a = ad.coverage_articles(spark, d)
    titles = ad.read(spark, d, "documents").select(F.col("doc_id").alias("story_id"), F.substring("text", 121, 120).alias("title"))
    return ev.misattachment_audit(a.join(titles, "story_id").select("article_id", "story_id", "title"), _top(spark, d, 5).select("story_id", "title"))


@query(f"""WITH c AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'SUCCESS' WHEN 'view' THEN 'PENDING' WHEN 'error' THEN 'ERROR' ELSE 'SUCCESS' END AS status, ts AS updated_at, (epoch_us({NOW_SQL}) - epoch_us(ts)) / 1e6 AS age FROM events)
SELECT event_id, CASE WHEN status = 'SUCCESS' AND NOT age >= 172800 THEN 'USE' WHEN status = 'SUCCESS' THEN 'USE_AND_REFRESH' WHEN status = 'PENDING' AND age < 90 THEN 'SKIP' ELSE 'REFRESH' END AS action FROM c""")
def title_cache_action(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "view", "PENDING").when(kind == "error", "ERROR").otherwise("SUCCESS")
    return ad.read(spark, d, "events").select("event_id", st.cache_action(status, F.col("ts"), ad.as_of()).alias("action"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events),
o AS (SELECT * FROM l WHERE rn = 1 AND ts < TIMESTAMP '2024-01-16 00:00:00'), n AS (SELECT user_id, event_type, max(event_id) AS event_id, CAST(sum(value) AS DOUBLE) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY ALL)
SELECT user_id, event_type, event_id, round(value, 4) AS value FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.event_type = o.event_type) UNION ALL SELECT user_id, event_type, event_id, round(value, 4) FROM n""")
def upsert_latest(spark, d):
    e, cut = ad.read(spark, d, "events"), ad.as_of("2024-01-16 00:00:00")
    columns = ["user_id", "event_type", "event_id", "value"]
    old = st.latest(e, ["user_id", "event_type"], "ts", F.col("event_id").desc()).where(F.col("ts") < cut).select(*columns)
    new = e.where(F.col("ts") >= cut).groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.sum("value").alias("value"))
    return st.upsert(old, new, ["user_id", "event_type"]).withColumn("value", F.round("value", 4))


@query("""WITH b AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS url, 0 AS copy FROM pages UNION ALL SELECT page_id, url, 1 FROM pages WHERE page_id % 3 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY copy, page_id) AS rn FROM b WHERE url <> '')
SELECT page_id, url, copy FROM f WHERE rn = 1 AND url NOT IN (SELECT url FROM pages WHERE page_id % 7 = 0)""")
def url_dedup(spark, d):
    p = ad.read(spark, d, "pages").select("page_id", "url")
    batch = p.select("page_id", F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("url")).alias("url"), F.lit(0).alias("copy")).unionByName(p.where("page_id % 3 = 0").withColumn("copy", F.lit(1)))
    return st.insert_ignore(st.first_of(batch, "url", F.col("copy"), F.col("page_id")), p.where("page_id % 7 = 0"), "url").select("page_id", "url", "copy")


@query("""SELECT o_orderkey AS story_id, least(o_orderdate, min(l_shipdate)) AS start_time, greatest(o_orderdate, max(l_shipdate)) AS end_time FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate""")
def touch_window(spark, d):
    o = ad.read(spark, d, "orders").select(F.col("o_orderkey").alias("story_id"), F.col("o_orderdate").alias("start_time"), F.col("o_orderdate").alias("end_time"))
    return cov.touch_window(o, ad.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("story_id"), F.col("l_shipdate").alias("published_at")))


@query("""SELECT story_id, end_time FROM (SELECT o_orderkey AS story_id, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS end_time FROM orders) WHERE end_time IS NULL OR end_time >= TIMESTAMP '1996-01-01 00:00:00'""")
def open_stories(spark, d):
    """Orders that are open have no end."""
    end = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("timestamp_ntz"))
    o = ad.read(spark, d, "orders").select(F.col("o_orderkey").alias("story_id"), end.alias("end_time"), F.col("o_orderdate").alias("created_at"))
    return ls.open_stories(o, ad.as_of("1996-01-01 00:00:00")).select("story_id", "end_time")


@query(r"""SELECT DISTINCT source, CASE WHEN lower(trim(source)) = 'src1' THEN '来源一' WHEN regexp_matches(concat('BBC ', source), '(?i)^bbc(\s|$)') AND source LIKE 'src2%' THEN 'BBC新闻' ELSE trim(source) END AS name_zh FROM documents""")
def source_names(spark, d):
    s = ad.read(spark, d, "documents").select("source").distinct()
    name = F.when(F.col("source").startswith("src2"), F.concat(F.lit("BBC "), "source")).otherwise(F.col("source"))
    return s.select("source", tx.source_name_zh(name, {"SRC1": "来源一"}).alias("name_zh"))


@query("SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 500) GROUP BY status")
def type_audit(spark, d):
    a = ad.read(spark, d, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_orderdate").alias("published_at"), F.col("o_orderstatus").alias("article_type"))
    return ev.type_audit(a, 500).select(F.col("article_type").alias("status"), "n")


@query(f"""WITH {KNN_SQL.format(where='')}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, story_id ORDER BY rn) AS nth FROM k WHERE rn <= 50 AND story_id % 3 <> 0),
f AS (SELECT query_id, story_id, min(rn) AS first, count(*) AS articles FROM p WHERE nth <= 3 GROUP BY ALL)
SELECT query_id, story_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank, articles FROM f""")
def baseline_candidates(spark, d):
    """X34's baseline; every third story's articles have no link."""
    v = ad.embedded_articles(spark, d)
    v = ev.known_queries(v.withColumn("query_id", F.col("id")), v).drop("query_id")
    return ev.baseline_candidates(v, v, v.where("story_id % 3 <> 0").select(F.col("id").alias("article_id"), "story_id"))


TITLE_CACHE_SQL = """c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'another title' ELSE trim(substr(text, 1, 120)) END AS of_title, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('t', doc_id) END AS translated, CASE doc_id % 3 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'PENDING' ELSE 'ERROR' END AS was, doc_id % 200 AS age FROM documents WHERE doc_id % 5 <> 0)"""


@query(f"""WITH {TITLE_CACHE_SQL}, b AS (SELECT d.doc_id AS story_id, CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE trim(substr(text, 1, 120)) END AS source_title, c.* FROM documents d LEFT JOIN c USING (doc_id)),
a AS (SELECT *, CASE WHEN source_title = '' THEN 'EMPTY' WHEN was IS NULL THEN 'CLAIM' WHEN of_title <> source_title THEN 'CHANGED' WHEN was = 'SUCCESS' AND translated <> '' THEN 'USE' WHEN was = 'PENDING' AND age < 90 THEN 'WAIT' ELSE 'RETRY' END AS action FROM b)
SELECT story_id, CASE action WHEN 'EMPTY' THEN 'EMPTY_SOURCE_TITLE' WHEN 'USE' THEN 'SUCCESS' ELSE 'PENDING' END AS status, CASE action WHEN 'USE' THEN translated WHEN 'EMPTY' THEN NULL ELSE source_title END AS title, action IN ('USE', 'WAIT') AS cache_hit, action FROM a""")
def translated_titles(spark, d):
    """X27 over a cache that is made of the documents: all transitions, and titles that changed since."""
    docs = ad.read(spark, d, "documents").select(F.col("doc_id").alias("story_id"), F.trim(F.substring("text", 1, 120)).alias("own"))
    stories = docs.select("story_id", F.when(F.col("story_id") % 11 == 0, F.lit(" ")).otherwise(F.col("own")).alias("title"))
    was = F.when(F.col("story_id") % 3 == 0, "SUCCESS").when(F.col("story_id") % 3 == 1, "PENDING").otherwise("ERROR")
    cache = docs.where("story_id % 5 <> 0").select(
        "story_id", F.lit("zh").alias("lang"), F.lit("v1").alias("prompt_version"), F.when(F.col("story_id") % 7 == 0, "another title").otherwise(F.col("own")).alias("source_title"),
        F.when(F.col("story_id") % 4 == 0, "").otherwise(F.concat(F.lit("t"), "story_id")).alias("translated_title"), was.alias("status"), F.lit(None).cast("string").alias("error"), (ad.as_of() - F.make_dt_interval(secs=(F.col("story_id") % 200).cast("decimal(18,6)"))).alias("updated_at"),
    )
    return tr.translation_state(stories, cache, ad.as_of()).select("story_id", "status", "title", "cache_hit", "action")


def fnv_sql(text: str) -> str:
    return f"list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda h, x: (xor(h, x) * 16777619::UBIGINT) & 4294967295::UBIGINT)"


#: Categories as they come: in any case, odd, or missing.
RAW_CATEGORIES = ["Crime", "ECONOMY", "geopolitics", "Politics", "sports", "Technology", "General", "Weather"]
POOLS_SQL = ", ".join(f"('{c}', [{', '.join(repr(x) for x in bg.pool_of(c))}])" for c in bg.FILES)


@query(f"""WITH RECURSIVE pools(category, pool) AS (VALUES {POOLS_SQL}),
e AS (SELECT doc_id AS story_id, CASE doc_id % 9 {' '.join(f"WHEN {k} THEN '{c.capitalize() if c != 'Weather' else 'General'}'" for k, c in enumerate(RAW_CATEGORIES))} ELSE 'General' END AS category FROM documents),
h AS (SELECT *, concat('2024-01-31:', category, ':', story_id) AS key, len(pool) AS n, row_number() OVER (PARTITION BY category ORDER BY story_id) AS turn FROM e JOIN pools USING (category)),
g AS (SELECT *, CAST({fnv_sql('key')} % n AS BIGINT) AS base, CAST(1 + {fnv_sql("concat('step:', key)")} % (n - 1) AS BIGINT) AS step FROM h),
f AS (SELECT category, 0::BIGINT AS turn, NULL::BIGINT AS story_id, CAST([] AS BIGINT[]) AS used, NULL::BIGINT AS slot FROM pools
UNION ALL SELECT category, turn, story_id, list_append(used, slot), slot FROM (SELECT g.category, g.turn, g.story_id, f.used, coalesce(list_filter(list_transform(range(0, n + 1), lambda i: (base + step * i) % n), lambda s: NOT list_contains(f.used, s))[1], base) AS slot FROM f JOIN g ON g.category = f.category AND g.turn = f.turn + 1))
SELECT f.story_id, category, pool[slot + 1] AS background FROM f JOIN pools USING (category) WHERE f.turn > 0""")
def story_backgrounds(spark, d):
    raw = F.get(F.array(*map(F.lit, RAW_CATEGORIES)), (F.col("doc_id") % 9).cast("int"))
    stories = ad.read(spark, d, "documents").select(F.col("doc_id").alias("story_id"), raw.alias("category"), F.lit(0).alias("place"))
    return bg.assigned_backgrounds(stories, ad.AS_OF[:10]).select("story_id", "category", "background")


@query(f"""WITH {ad.TITLED_SQL}, e AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 3 <> 0)
SELECT count(*) FILTER (WHERE {HOURS_SQL.format(NOW_SQL, 'published_at')} <= 168 AND embedding IS NULL) AS missing_embeddings, count(*) FILTER (WHERE {HOURS_SQL.format(NOW_SQL, 'published_at')} <= 168 AND toxic IS NULL) AS missing_types,
count(*) FILTER (WHERE {HOURS_SQL.format(NOW_SQL, 'published_at')} <= 240 AND embedding IS NOT NULL AND id % 2 = 0) AS unassigned FROM d LEFT JOIN e ON vec_id = id LEFT JOIN labels ON labels.doc_id = id""")
def missing_work(spark, d):
    """A third of the vectors and the even articles' stories are missing; labels stand for types."""
    e = ad.read(spark, d, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("id"), "embedding")
    kinds = ad.read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("string").alias("article_type"))
    a = ad.titled_articles(spark, d).select("id", "published_at").join(e, "id", "left").join(kinds, "id", "left")
    return ev.missing_work(a, a.where("id % 2 = 1").select(F.col("id").alias("article_id")), ad.as_of())


def _listed_stories(spark, d):
    """Stories of the vectors' labels, each with its articles; one story without any."""
    v = ad.embedded_articles(spark, d)
    stories = v.groupBy("story_id").agg(F.min_by("title", "id").alias("title"), F.max("published_at").alias("ts"))
    stories = stories.select(F.col("story_id").cast("long").alias("story_id"), "title", "ts").unionByName(spark.createDataFrame([(-1, None)], "story_id long, title string").withColumn("ts", ad.as_of()))
    return mg.signature_input(stories, v.select(F.col("story_id").cast("long").alias("story_id"), F.col("id").alias("article_id"), "title", "summary", "published_at"))


LISTED_SQL = f"""{ad.EMBEDDED_SQL}, st AS (SELECT CAST(story_id AS BIGINT) AS story_id, arg_min(title, id) AS title, max(published_at) AS ts FROM v GROUP BY story_id UNION ALL SELECT -1, '', {NOW_SQL}),
rd AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY published_at DESC NULLS LAST, id DESC) AS rn FROM v)"""


@query(f"""WITH {LISTED_SQL}, a AS (SELECT story_id, string_agg(concat(title, chr(1), summary), chr(2) ORDER BY rn) AS docs, count(*) AS n FROM rd WHERE rn <= 5 GROUP BY story_id)
SELECT st.story_id, title, ts, coalesce(docs, '') AS docs, coalesce(n, 0) AS n_docs FROM st LEFT JOIN a USING (story_id)""")
def signature_docs(spark, d):
    """What signatures are made of."""
    docs = F.array_join(F.transform("docs", lambda x: F.concat(x["title"], F.lit("\x01"), x["summary"])), "\x02")
    return _listed_stories(spark, d).select("story_id", "title", "ts", docs.alias("docs"), F.size("docs").cast("long").alias("n_docs"))


#: RE2's word boundary knows ASCII only, so that accented letters become underscores, which are parts of words for both engines.
_PLAIN = r"regexp_replace(regexp_replace({0}, 'https?://\S+|www\.\S+', ' ', 'g'), '[\x{{C0}}-\x{{24F}}]', '_', 'g')"
PHRASES_SQL = r"list_concat(list_filter(list_transform(list_concat(regexp_extract_all(" + _PLAIN + r", '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b'), regexp_extract_all(" + _PLAIN + r", '\b[A-Z]{{2,}}\b')), lambda t: lower(t)), lambda t: length(t) >= 2 AND t NOT IN (" + words_sql(SIGNATURE_STOP_WORDS) + ")), " + TERMS_SQL + ")"


@query(f"""WITH {LISTED_SQL}, p AS (SELECT story_id, 0 AS o, 4 AS w, {PHRASES_SQL.format('title')} AS t FROM st UNION ALL SELECT story_id, 2 * rn - 1, 2, {PHRASES_SQL.format('title')} FROM rd WHERE rn <= 5 UNION ALL SELECT story_id, 2 * rn, 1, {PHRASES_SQL.format('summary')} FROM rd WHERE rn <= 5),
e AS (SELECT story_id, o, w, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM p), vt AS (SELECT story_id, term, sum(w) AS votes, min(o * 100000 + i) AS first FROM e GROUP BY story_id, term),
rk AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY votes DESC, first) AS rn FROM vt), sg AS (SELECT story_id, string_agg(term, '|' ORDER BY rn) AS signature FROM rk WHERE rn <= 12 GROUP BY story_id)
SELECT story_id, coalesce(signature, '') AS signature, '' AS keywords_hit FROM st LEFT JOIN sg USING (story_id)""")
def signatures_with_phrases(spark, d):
    """X10 with runs of capitalised words and acronyms; the tables' words are invented, so no keyword is hit."""
    out = mg.signed_stories(_listed_stories(spark, d))
    return out.select("story_id", F.array_join("signature", "|").alias("signature"), F.array_join("keywords_hit", "|").alias("keywords_hit"))


@query(f"""WITH {KNN_SQL.format(where='')}, b AS (SELECT query_id, story_id, max(sim) AS best_sim FROM k WHERE rn <= 200 AND query_id % 2 = 0 GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_sim DESC, story_id) AS rank FROM b),
g AS (SELECT query_id, string_agg(CAST(story_id AS VARCHAR), ' ' ORDER BY rank) FILTER (WHERE rank <= 20) AS stories, count(*) AS n FROM c GROUP BY query_id)
SELECT d.doc_id AS query_id, coalesce(stories, '') AS stories, coalesce(n, 0) AS unique_stories, CASE WHEN d.doc_id NOT IN (SELECT id FROM v) THEN 'query_article_not_found' WHEN d.doc_id % 2 = 1 THEN 'query_embedding_is_null' END AS error FROM documents d LEFT JOIN g ON g.query_id = d.doc_id""")
def retrieved_candidates(spark, d):
    """X13 for every document: some are no articles with a vector, and the odd ones have lost theirs as queries."""
    v = ad.embedded_articles(spark, d).withColumn("story_id", F.col("story_id").cast("long"))
    asked = v.withColumn("embedding", F.when(F.col("id") % 2 == 0, F.col("embedding")))
    queries = ad.read(spark, d, "documents").select(F.col("doc_id").alias("query_id"))
    out = cl.retrieved(queries, v, v.select(F.col("id").alias("article_id"), "story_id"), asked=asked)
    return out.select("query_id", joined("stories").alias("stories"), "unique_stories", "error")
