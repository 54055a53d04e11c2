"""Golden rows and properties of the operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from storyweft.operators import clustering as cl, coverage as cov, evaluation as ev, merging as mg, ranking as rk, store as st
from storyweft.plans import adapters as ad
from storyweft.plans.pipeline import run_merge_pipeline, run_pipeline

NOW = datetime(2024, 1, 31)
ARTICLES = "article_id long, story_id long, source_id int, published_at timestamp_ntz, article_type string"


def ago(hours):
    return NOW - timedelta(hours=hours)


def articles(spark, rows):
    return spark.createDataFrame([(i, s, src, None if h is None else ago(h), t) for i, (s, src, h, t) in enumerate(rows)], ARTICLES)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(1, 0), (1, 48), (2, 24)], (1.974410, 2, 0.666667, 1.342234, 48)),
        ([(1, 1), (1, 2), (1, 3)], (2.877985, 1, 1.0, 1.013010, 3)),
        ([(1, 10), (2, 20), (3, 30), (4, 160)], (2.042112, 4, 0.25, 2.362615, 160)),
    ],
)
def test_top_story_scores(spark, rows, want):
    a = articles(spark, [(1, s, h, None) for s, h in rows] + [(1, 9, None, None), (1, 9, 169, None)])
    stories = spark.createDataFrame([(1, "t")], "story_id long, title string")
    r = rk.top_stories(a, stories, ad.as_of()).first()
    assert (r.weight, r.recent_sources, r.max_share, r.score, r.age_hours) == pytest.approx(want, abs=1e-5)
    assert r.articles_count == len(rows) + 2


def test_top_stories_plan_is_native_with_a_semi_join(spark):
    a = articles(spark, [(1, 1, 1, None)])
    plan = rk.top_stories(a, spark.createDataFrame([(1, "t")], "story_id long, title string"), ad.as_of())._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Python" not in plan


def test_rerank(spark):
    rows = [(1, "Quake strikes coastal Japan city", 5.0, 100.0), (2, "Quake strikes coastal Japan town", 4.9, 90.0), (3, "Parliament passes budget bill", 3.0, 12.0), (4, "Markets rally after rate decision", 2.0, 5.0), (5, "Parliament passes budget law", 1.5, 3.0)]
    df = spark.createDataFrame(rows, "story_id long, title string, score double, age_hours double")
    for limit, want in ((2, [3, 4]), (3, [3, 4, 1]), (4, [3, 4, 1, 2]), (5, [1, 2, 3, 4, 5])):
        assert [r.story_id for r in rk.rerank(df, limit).orderBy("position").collect()] == want


def test_gap_hints(spark):
    kinds = ["FACT", "INTERPRETATION", "COMMENTARY"]
    rows = [(1, 1, 1, "FACT"), (1, 2, 1, "FACT"), (1, 3, 1, "FACT")]
    rows += [(2, s, 1, "FACT") for s in (1, 1, 2, 3)]
    rows += [(3, s, 1, kinds[i % 3]) for i, s in enumerate((1, 1, 1, 2, 3))]
    rows += [(4, s, 1, kinds[i % 3]) for i, s in enumerate((1, 1, 1, 1, 1, 1, 1, 2, 3, 3))]
    sources = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "source_id int, source string")
    got = {r.story_id: r for r in cov.gap_hints(articles(spark, rows), sources).collect()}
    assert (got[1].status, got[1].reason) == ("INSUFFICIENT_DATA", "below_thresholds")
    assert (got[2].status, got[2].codes) == ("GAP_FOUND", ["MISSING_TYPES"])
    assert got[3].status == "NO_GAP" and got[3].dominant_ratio == pytest.approx(0.6)
    assert got[4].codes == ["DOMINANT_SOURCE"]


def test_diversity_is_a_permutation(spark):
    a = articles(spark, [(s, i % 3, i, ("FACT", None, "OPINION")[i % 2]) for s in (1, 2) for i in range(7)])
    for level in (0, 30, 60):
        rows = cov.diversity_order(a, level).collect()
        assert {(r.story_id, r.article_id) for r in rows} == {(r.story_id, r.article_id) for r in a.collect()}
        assert sorted(r.position for r in rows if r.story_id == 1) == list(range(1, 8))


def test_status(spark):
    df = spark.createDataFrame([(h, None if h is None else ago(h)) for h in (96, 97, 240, 241, None)], "h int, at timestamp_ntz")
    assert [r[0] for r in df.select(cov.story_status(F.col("at"), ad.as_of())).collect()] == ["active", "closing", "closing", "closed", "closed"]


def test_decisions(spark):
    rows = [(0.73, 44.0, 0.01, None, "new"), (0.74, 44.0, 0.01, None, "merge"), (0.62, 50.0, 0.1, None, "merge"), (0.54, 45.0, 0.1, None, "merge"), (0.53, 85.0, 0.1, None, "merge"), (0.53, 60.0, 0.20, None, "merge")]
    rows += [(0.10, 60.0, 0.10, 6 * 3600, "merge"), (0.10, 60.0, 0.10, 6 * 3600 + 1, "new"), (0.10, 60.0, 0.10, None, "new"), (None, None, None, None, "new")]
    df = spark.createDataFrame([(*r[:3], NOW, None if r[3] is None else NOW - timedelta(seconds=r[3]), r[4]) for r in rows], "v double, f double, j double, t timestamp_ntz, e timestamp_ntz, want string")
    assert all(r[0] == r[1] for r in df.select("want", cl.decide_action(F.col("v"), F.col("f"), F.col("j"), F.col("t"), F.col("e"))).collect())


def test_cluster_sees_earlier_decisions(spark):
    kind = "id long, title string, published_at timestamp_ntz, embedding array<float>"
    a = spark.createDataFrame([(1, "quake japan", ago(1), [1.0, 0.0]), (2, "quake japan city", ago(2), [1.0, 0.1]), (3, "budget vote", ago(3), [0.0, 1.0])], kind)
    links = spark.createDataFrame([], "article_id long, story_id long")
    stories = spark.createDataFrame([], "story_id long, title string, status string, end_time timestamp_ntz")
    got = {r.article_id: (r.action, r.story_id) for r in cl.cluster(a, a, links, stories).collect()}
    assert got == {1: ("new", 1), 2: ("merge", 1), 3: ("new", 2)}


def test_signature(spark):
    s = spark.createDataFrame([(1, "Mock event 1 city council update")], "story_id long, title string")
    d = spark.createDataFrame([(1, 1, "Mock related article", "Mock summary for event pipeline")], "story_id long, rn int, title string, summary string")
    assert mg.signatures(s, d).first().signature == ["mock", "event", "city", "council", "related", "article", "summary", "pipeline"]


def stories(spark):
    rows = [(1003, "World cup final tonight", ago(3), ["football"]), (1002, "El Mencho captured in raid", ago(2), ["el mencho", "world cup"]), (1001, "El Mencho raid: what happened", ago(1), ["el mencho", "world cup"])]
    return spark.createDataFrame(rows, "story_id long, title string, ts timestamp_ntz, signature array<string>")


def test_merge_pipeline(spark):
    pairs = mg.merge_candidates(stories(spark)).collect()
    assert [(r.a, r.b, r.weight, r.df_min, r.evidence) for r in pairs] == [(1001, 1002, 2.5754, 2, ["el mencho", "world cup"])]
    assert [(r.a, r.b) for r in run_merge_pipeline(stories(spark)).collect()] == [(1001, 1002)]
    assert mg.merge_candidates(stories(spark).limit(0)).count() == 0


def test_judge(spark):
    kind = "a long, b long, score double, weight double, evidence array<string>, df_min long, hours double, title_jaccard double"
    rows = [
        (1, 2, 0.9, 1.0, ["world", "news"], 2, 1.0, 0.1, "NO_MERGE", "RULE_NO_GENERIC_ONLY"),
        (1, 3, 0.78, 1.0, ["x"], 3, 1.0, 0.1, "SUGGEST_MERGE", "RULE_HIGH_SCORE"),
        (1, 4, 0.3, 6.0, ["x"], 2, 1.0, 0.1, "SUGGEST_MERGE", "RULE_RARE_TOKEN_STRONG"),
        (1, 5, 0.45, 1.0, ["x", "y", "z"], 3, 36.0, 0.1, "SUGGEST_MERGE", "RULE_MULTI_TOKEN_STRONG"),
        (1, 6, 0.5, 1.0, ["x", "y"], 3, 50.0, 0.1, "SUGGEST_MERGE", "LLM_GREY_ZONE"),
        (1, 7, 0.5, 1.0, ["x"], 3, 50.0, 0.1, "NO_MERGE", "LLM_GREY_ZONE"),
        (1, 8, 0.72, 1.0, ["x"], 3, 50.0, 0.1, "NO_MERGE", "RULE_NO"),
    ]
    got = {r.b: (r.decision, r.decision_path) for r in mg.merge_judge(spark.createDataFrame([r[:8] for r in rows], kind)).collect()}
    assert got == {r[1]: r[8:] for r in rows}
    grey = spark.createDataFrame([(0, i, 0.5, 1.0, ["x"], 3, 50.0, 0.1) for i in range(1, 24)], kind)
    paths = [r.decision_path for r in mg.merge_judge(grey).collect()]
    assert paths.count("LLM_GREY_ZONE") == 20 and paths.count("RULE_NO") == 3


def test_rank_metrics(spark):
    ranks = lambda ids: spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "id long, rank int")
    r = ev.rank_metrics(ranks([1, 2, 3, 4, 5]), ranks([2, 1, 6, 3, 7])).first()
    with pytest.raises(ValueError, match="over 3 rows"):
        ev.rank_metrics(ranks([1, 2, 3, 4]), ranks([1]), longest=3)
    assert (r.overlap, r.mean_rank_delta, r.concordant, r.discordant, r.tau) == (0.6, pytest.approx(1.429, abs=1e-3), 13, 6, pytest.approx(0.368, abs=1e-3))


def test_store(spark):
    batch = spark.createDataFrame([("u1", 0), ("u1", 1), ("", 2), ("u2", 3)], "url string, pos int")
    known = spark.createDataFrame([("u2",)], "url string")
    assert [tuple(r) for r in st.insert_ignore(st.first_of(batch, "url", F.col("pos")), known, "url").collect()] == [("u1", 0)]
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    assert sorted(tuple(r) for r in st.keyed_update(old, new, "id").collect()) == [(1, "a", "x"), (2, "B", "y")]
    assert "z" in st.with_column_if_missing(old, "z", "int").columns
    titles = spark.createDataFrame([([" A  b ", "a B", None, "", "c"],)], "t array<string>")
    assert titles.select(st.prompt_titles(F.col("t"))).first()[0] == ["A b", "c"]


def test_empty_tables(spark):
    none = articles(spark, [])
    sources = spark.createDataFrame([], "source_id int, source string")
    for df in (cov.coverage_matrix(none, sources), cov.gap_hints(none, sources), rk.source_share(none), cov.diversity_order(none, 30), rk.baseline_topk(none, ad.as_of())):
        assert df.count() == 0


def test_run_pipeline_stops_at_an_error(spark):
    seen = []
    ok = lambda s: seen.append("a") or {"x": spark.range(1)}
    with pytest.raises(ValueError):
        run_pipeline({}, [("a", ok), ("b", lambda s: (_ for _ in ()).throw(ValueError())), ("c", ok)])
    assert seen == ["a"]
