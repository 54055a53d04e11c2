"""Defaults and branches that no registered query reaches: word lists, phrases, the fuzzy score, feeds, views, cached judgements."""

from datetime import datetime

from pyspark.sql import functions as F

from storyweft.functions import text as tx
from storyweft.operators import clustering as cl, coverage as cov, evaluation as ev, merging as mg
from storyweft.plans import adapters as ad
from storyweft.sources import feeds, tables


def test_atom_feed_and_failed_fetches(spark, tmp_path):
    entry = '<entry><title>{}</title><link rel="self" href="s{}"/><link rel="alternate" href="u{}"/><summary>x</summary><updated>2024-01-01T10:00:00+01:00</updated></entry>'
    (tmp_path / "a.xml").write_text("<feed>" + "".join(entry.format(t, t, t) for t in "ABC") + "</feed>")
    rows = feeds.read_feed(spark, str(tmp_path / "a.xml"), "entry")
    assert [(r.position, r.title, r.url, r.summary, r.published_at, r.broken) for r in rows.orderBy("position").collect()] == [(k + 1, t, f"u{t}", "x", datetime(2024, 1, 1, 9), False) for k, t in enumerate("ABC")]
    feed = rows.first().feed
    fetches = spark.createDataFrame([(feed, 200, None), ("b", 404, None), ("c", None, "timeout"), ("d", 200, None)], "feed string, http_status int, error string")
    assert {r.feed: (r.status, r.entries) for r in feeds.feed_health(rows, fetches).collect()} == {feed: ("OK", 3), "b": ("FAILED", 0), "c": ("FAILED", 0), "d": ("EMPTY", 0)}


def test_fixed_sources(spark):
    s = tables.seed_sources(spark)
    assert s.count() == 42 and tables.seeded(s.limit(1), s).count() == 41  # one address stands there twice


def test_daily_views(spark):
    rows = [("gap_hints_daily", '{"gap_found": true, "dominant_source_ratio": 0.5, "missing_type_count": 2}', None), ("gap_hints_daily", '{"gap_found": false}', None), ("top_events_params", None, '{"window_hours": 72, "weights": {"hot": 0.45}}')]
    logs = spark.createDataFrame([(datetime(2024, 1, 2, 5), *r) for r in rows], "created_at timestamp_ntz, eval_type string, metrics string, params string")
    tables.daily_views(logs)
    g = spark.sql("SELECT * FROM vw_gap_hints_daily").first()
    assert (g.day, g.events_checked, g.events_with_gap, g.avg_dominant_source_ratio, g.avg_missing_type_count) == (datetime(2024, 1, 2), 2, 1, 0.5, 2.0)
    t = spark.sql("SELECT * FROM vw_top_events_params_daily").first()
    assert (t.window_hours, t.tau_hours, t.w_hot, t.w_div, t.runs) == (72, None, 0.45, None, 1)


def test_cached_judgements_stand_and_cost_nothing(spark):
    pairs = spark.createDataFrame([(1, 2, 0.6, 5.0, ["a", "b"], 5, 50.0, 0.5), (3, 4, 0.58, 5.0, ["a"], 5, 50.0, 0.5), (5, 6, 0.57, 5.0, ["a", "b"], 5, 50.0, 0.5), (7, 8, 0.5, 5.0, ["a", "b"], 5, 50.0, 0.5), (9, 10, 0.49, 5.0, ["a", "b"], 5, 50.0, 0.5)], tables.mock_candidates(spark).schema)
    cache = spark.createDataFrame([(2, 1, "NO_MERGE"), (3, 4, "SUGGEST_MERGE"), (9, 10, "SUGGEST_MERGE")], "a long, b long, decision string")
    got = {r.a: (r.decision, r.decision_path) for r in mg.merge_judge(pairs, cache, budget=2).collect()}
    assert got == {1: ("NO_MERGE", "LLM_GREY_ZONE"), 3: ("SUGGEST_MERGE", "LLM_GREY_ZONE"), 5: ("SUGGEST_MERGE", "LLM_GREY_ZONE"), 7: ("SUGGEST_MERGE", "LLM_GREY_ZONE"), 9: ("NO_MERGE", "RULE_NO")}
    assert [r.decision_path for r in mg.merge_judge(tables.mock_candidates(spark)).orderBy("a").collect()] == ["RULE_HIGH_SCORE", "LLM_GREY_ZONE", "RULE_NO_GENERIC_ONLY", "RULE_NO"]


def test_diversity_of_types_and_missing_sources(spark):
    kind = "story_id long, article_id long, source_id int, article_type string, published_at timestamp_ntz"
    rows = [(1, 10 - i, 1, t, datetime(2024, 1, 10 - i)) for i, t in enumerate(["FACT", "INTERPRETATION", "INTERPRETATION", "FACT"])]
    order = cov.diversity_order(spark.createDataFrame(rows, kind), 30).orderBy("position").collect()
    assert [(10 - r.article_id, r.reason) for r in order] == [(0, "NEW_SOURCE"), (1, "TYPE_COVERAGE"), (3, "TYPE_COVERAGE"), (2, "CAP_RELAXED_FILL")]
    rows = [(1, 10 - i, None if i < 3 else 5, "FACT", datetime(2024, 1, 10 - i)) for i in range(4)]
    order = cov.diversity_order(spark.createDataFrame(rows, kind), 30).orderBy("position").collect()
    assert [(10 - r.article_id, r.reason) for r in order] == [(3, "NEW_SOURCE"), (0, "TYPE_COVERAGE"), (1, "TYPE_COVERAGE"), (2, "TYPE_COVERAGE")]


def test_signatures_with_phrases_and_addresses_in_any_case(spark):
    s = spark.createDataFrame([(1, "Quake in New Delhi HTTP://X.COM/Abc says WHO")], "story_id long, title string")
    d = spark.createDataFrame([(1, 1, "new delhi", None)], "story_id long, rn int, title string, summary string")
    terms = mg.signatures(s, d).first().signature
    assert "new delhi" in terms and "who" in terms and "quake" in terms and not any("abc" in t or "http" in t for t in terms)


def test_largest_weight_is_that_of_all_pairs(spark):
    import random

    rng = random.Random(2)
    rows = [(i, f"t{i}", datetime(2024, 1, 1 + rng.randrange(28)), sorted({f"w{int(rng.paretovariate(0.7))}" for _ in range(6)})) for i in range(120)]
    stories = spark.createDataFrame(rows, "story_id long, title string, ts timestamp_ntz, signature array<string>")
    got = mg.merge_candidates(stories, top_k=10_000, window_hours=50).collect()
    from collections import Counter
    from math import log

    df = Counter(t for r in rows for t in r[3])
    idf = {t: log(121 / (n + 1)) + 1 for t, n in df.items() if n <= max(2, int(120 * 0.35))}
    weight = {(max((a[2], a[0]), (b[2], b[0]))[1], min((a[2], a[0]), (b[2], b[0]))[1]): sum(idf.get(t, 0) for t in set(a[3]) & set(b[3])) for k, a in enumerate(rows) for b in rows[:k]}
    top = max(weight.values())
    at = {r[0]: r[2] for r in rows}
    for r in got:
        hours = abs((at[r.a] - at[r.b]).total_seconds()) / 3600
        assert hours <= 50 and abs(r.weight - weight[r.a, r.b]) < 1e-3
        assert abs(r.score - (0.7 * weight[r.a, r.b] / top + 0.2 * r.title_jaccard + 0.1 * (1 - hours / 50))) < 1e-3
    near = [p for p, w in weight.items() if w >= 1.5 and abs((at[p[0]] - at[p[1]]).total_seconds()) <= 50 * 3600]
    assert set(near) <= {(r.a, r.b) for r in got}


def test_default_word_lists(spark):
    row = spark.createDataFrame([("Officials deny strike on port", "Officials confirm strike on port", "https://x.org/opinion/a", "Analysis: what it means")], "a string, b string, url string, t string")
    got = row.select(tx.conflicting_titles(F.col("a"), F.col("b")).alias("c"), tx.article_type(F.col("t"), F.lit(None).cast("string"), F.col("url")).alias("u"), tx.article_type(F.col("t"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("t")).first()
    assert got.c is True and got.u.type == "COMMENTARY" and got.t.type == "INTERPRETATION"


def test_dry_run_with_the_fuzzy_score(spark):
    kind = "id long, title string, published_at timestamp_ntz, embedding array<float>"
    q = spark.createDataFrame([(1, "Quake hits northern Japan coast", datetime(2024, 1, 2), [1.0, 0.0]), (2, "Budget vote delayed", datetime(2024, 1, 2), [0.0, 1.0])], kind)
    a = spark.createDataFrame([(10, "x", datetime(2024, 1, 1), [0.6, 0.8]), (11, "y", datetime(2024, 1, 1), [0.3, 0.95])], kind)
    links = spark.createDataFrame([(10, 100), (11, 101)], "article_id long, story_id long")
    stories = spark.createDataFrame([(100, "Japan coast quake hits northern", datetime(2024, 1, 1), "active"), (101, "Budget vote delayed again", datetime(2024, 1, 1), "closed")], "story_id long, title string, end_time timestamp_ntz, status string")
    got = {r.query_id: r for r in cl.cluster_dry_run(q, a, links, stories).collect()}
    assert got[1].action == "merge" and got[1].story_id == 100 and got[1].fuzz == 100.0
    assert got[2].action == "merge" or got[2].fuzz < 60


def test_evaluation_log_and_summary(spark):
    audited = spark.createDataFrame([(0.5, 0.2, False, False), (0.1, -0.3, True, True)], "self_sim double, margin double, conflict boolean, suspect boolean")
    assert tuple(ev.audit_summary(audited).first()) == (0.3, -0.05, 0.5, 1, 2)


def test_story_page_takes_the_rewritten_title(spark):
    a = spark.createDataFrame([(1, 5, 0, None, datetime(2024, 1, 30))], "story_id long, article_id long, source_id int, article_type string, published_at timestamp_ntz")
    stories = spark.createDataFrame([(1, "old", "new")], "story_id long, title string, title_override string")
    sources = spark.createDataFrame([(0, "S")], "source_id int, source string")
    page = cov.story_detail(1, a, stories, sources, ad.as_of())
    assert page["summary"].first().title == "new" and page["articles"].first().country == "Unknown" and page["histograms"].first().by_kind == {"UNKNOWN": 1}


def test_model_step(spark):
    from storyweft.plans import models

    rows = spark.createDataFrame([(1, ["a", "longer", None]), (2, None), (3, ["x"]), (4, ["y"])], "story_id long, titles array<string>")
    got = {r.story_id: (r.status, r.output_json) for r in models.model_answers(rows).collect()}
    assert got == {1: ("SUCCESS", '{"title": "longer"}'), 2: ("SUCCESS", '{"title": ""}'), 3: ("SUCCESS", '{"title": "x"}'), 4: ("SUCCESS", '{"title": "y"}')}

    def broken(requests):
        if any(r["story_id"] == 3 for r in requests):
            raise TimeoutError("slow")
        return ["[1]" if r["story_id"] == 4 else "{}" for r in requests]

    got = {r.story_id: (r.status, r.error) for r in models.model_answers(rows, broken, batch=1).collect()}
    assert got == {1: ("SUCCESS", None), 2: ("SUCCESS", None), 3: ("ERROR", "TimeoutError: slow"), 4: ("ERROR", "no JSON object")}
    cache = spark.createDataFrame([(1, "SUCCESS", datetime(2024, 1, 30, 23)), (2, "SUCCESS", datetime(2024, 1, 1)), (3, "ERROR", datetime(2024, 1, 30))], "story_id long, status string, updated_at timestamp_ntz")
    assert {r.story_id for r in models.refreshed_titles(rows, cache, ad.as_of()).collect()} == {2, 3, 4}


def test_embedded_titles_are_signed_counts(spark):
    import zlib

    from storyweft.functions.vectors import embed

    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, ["c"])], "id long, tokens array<string>")
    for r in embed(rows, F.col("tokens"), batch=1).join(rows, "id").collect():
        want = [0.0] * 384
        for t in r.tokens:
            h = zlib.crc32(t.encode())
            want[h % 384] += 1.0 if h >> 31 else -1.0
        norm = sum(x * x for x in want) ** 0.5 or 1.0
        assert all(abs(x - y / norm) < 1e-6 for x, y in zip(r.embedding, want))


def test_lifetimes_sort_once(spark):
    rows = [(1, 5, datetime(2024, 1, 2)), (1, None, datetime(2024, 1, 9)), (1, 5, None), (1, 4, datetime(2024, 1, 1)), (2, None, None), (None, 3, datetime(2024, 1, 1))]
    articles = spark.createDataFrame(rows, "story_id long, source_id long, published_at timestamp_ntz")
    got = cov.lifetimes(articles)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, 4, 2, datetime(2024, 1, 1), datetime(2024, 1, 9)), (2, 1, 0, None, None)]
    assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_story_lifetime_of_repeated_orders(spark, tmp_path):
    from storyweft.catalogue import QUERIES

    at = datetime(2024, 1, 5)
    spark.createDataFrame([(1, at), (1, at), (2, at), (None, at)], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 7, datetime(2024, 1, 6)), (1, 7, datetime(2024, 1, 8)), (3, 7, at), (None, 7, at)], "l_orderkey long, l_suppkey long, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["story_lifetime"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 4, 1, datetime(2024, 1, 6), datetime(2024, 1, 8)), (2, 0, 0, None, at), (None, 0, 0, None, at)]


def test_candidates_are_found_without_all_pairs(spark):
    """Stories with frequent words and copies: the search joins few of the pairs that share a word, and finds those of all pairs."""
    import random
    from collections import Counter
    from datetime import timedelta
    from math import log

    rng = random.Random(4)
    n = 800
    texts = [sorted({*(f"w{rng.randrange(40)}" for _ in range(8)), *(f"r{rng.randrange(900)}" for _ in range(3))}) for _ in range(n // 2)]
    rows = [(i, f"alpha beta t{rng.randrange(9)}", datetime(2024, 1, 1) + timedelta(hours=rng.randrange(700)), rng.choice(texts)) for i in range(n)]
    stories = spark.createDataFrame(rows, "story_id long, title string, ts timestamp_ntz, signature array<string>")
    df = Counter(t for r in rows for t in r[3])
    idf = {t: log((n + 1) / (k + 1)) + 1 for t, k in df.items() if k <= int(n * 0.35)}
    pairs, top = [], 0.0
    for a in rows:
        for b in rows:
            shared = [t for t in a[3] if t in b[3] and t in idf] if (a[2], a[0]) > (b[2], b[0]) else []
            weight = sum(idf[t] for t in shared)
            top = max(top, weight)
            if shared and a[2] - b[2] <= timedelta(hours=72):
                pairs.append((a, b, weight))
    words = lambda t: set(t.split())
    want = []
    for a, b, weight in pairs:
        jac = len(words(a[1]) & words(b[1])) / len(words(a[1]) | words(b[1]))
        want.append((-round(0.7 * min(1, weight / top) + 0.2 * jac + 0.1 * (1 - (a[2] - b[2]).total_seconds() / 3600 / 72), 4), -round(weight, 6), a[0], b[0]))
    got = [(r.a, r.b, r.score) for r in mg.merge_candidates(stories, top_k=20).collect()]
    assert [p[:2] for p in got] == [(a, b) for _, _, a, b in sorted(want)[:20]]
    post = stories.select("story_id", "ts", F.explode("signature").alias("token")).join(spark.createDataFrame([(t, df[t], x) for t, x in idf.items()], "token string, df long, idf double"), "token")
    made: list[int] = []
    mg.top_pairs(post, stories, mg._Scores(top, 72, 20, 1), made)
    assert sum(made) < n < len(pairs) / 20


def test_signatures_deal_texts_not_terms(spark):
    s = spark.createDataFrame([(1, "quake hits port")], "story_id long, title string")
    d = spark.createDataFrame([(1, 1, "port quake", "harbour wall fell"), (2, 1, None, "flood")], "story_id long, rn int, title string, summary string")
    out = mg.signatures(s, d, phrases=False)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.story_id: r.signature for r in out.collect()} == {1: ["quake", "port", "hits", "harbour", "wall", "fell"], 2: ["flood"]}
