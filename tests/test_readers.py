"""What readers get, and what is logged and counted."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from storyweft.functions import text as tx
from storyweft.operators import clustering as cl, evaluation as ev, listing as ls, merging as mg, ranking as rk, store as st
from storyweft.plans import adapters as ad
from storyweft.sources.tablestore import TableStore

NOW = datetime(2024, 1, 31)


def test_the_top_list_has_clamped_limits(spark):
    a = spark.createDataFrame([(s, s * 10 + k, k % 3, NOW - timedelta(hours=s % 40 + k)) for s in range(70) for k in range(3)], "story_id long, article_id long, source_id int, published_at timestamp_ntz")
    stories = spark.createDataFrame([(s, f"title number{s} word{s % 7}x other{s % 5}y") for s in range(70)], "story_id long, title string")
    for limit, want in ((-3, 1), (1, 1), (7, 7), (20, 20), (500, 20)):
        got = rk.top_list(a, stories, ad.as_of(), limit).collect()
        assert len(got) == want and sorted(r.position for r in got) == list(range(1, want + 1))
    assert [rk.clamped(6 * n, 20, 60) for n in (1, 5, 20)] == [20, 30, 60]


def test_prompt_titles_are_a_fixed_sample_in_order(spark):
    titles = [f"Title {k}" for k in range(20)]
    df = spark.createDataFrame([(titles,), (titles[:6],), ([" a  b", "A B", None, " "],), (None,)], "t array<string>")
    many, six, few, none = (r[0] for r in df.select(st.prompt_titles(F.col("t"))).collect())
    assert len(many) == 6 and many == [t for t in titles if t in many] and six == titles[:6] and few == ["a b"] and none is None
    assert many != [r[0] for r in df.select(st.prompt_titles(F.col("t"), seed=1)).collect()][0]


def test_lists(spark):
    a = spark.createDataFrame([(k,) for k in (3, 9, 5)], "article_id long")
    assert [r.article_id for r in ls.list_articles(a, 2).collect()] == [9, 5] and ls.list_articles(a, 0).count() == 1
    assert [r.source_id for r in ls.list_sources(spark.createDataFrame([(2,), (1,)], "source_id int")).collect()] == [1, 2]


def test_loose_lists_and_explanations(spark):
    df = spark.createDataFrame([('["a", "b"]',), ("plain words",), (None,), ("[1, bad",)], "x string")
    assert [r[0] for r in df.select(tx.loose_list(F.col("x"))).collect()] == [["a", "b"], ["plain", "words"], [], ["bad"]]
    one = spark.range(1).select(tx.explain_jaccard(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("b"), F.lit("c"))).alias("e")).first().e
    assert (one.intersection, one.union, round(one.score, 3)) == (["b"], ["a", "b", "c"], 0.333)


def test_signatures_from_stories_and_their_documents(spark):
    stories = spark.createDataFrame([(1, "City council", NOW), (2, None, NOW - timedelta(hours=1)), (3, "old", NOW - timedelta(days=9)), (4, "no time", None)], "story_id long, title string, ts timestamp_ntz")
    articles = spark.createDataFrame([(1, k, f"Police Raid {k}", "the FIFA cup", NOW - timedelta(hours=k)) for k in range(8)] + [(3, 50, "x", "y", NOW)], "story_id long, article_id long, title string, summary string, published_at timestamp_ntz")
    listed = mg.signature_input(stories, articles, ad.as_of() - F.make_dt_interval(F.lit(7)))
    got = {r.story_id: r for r in listed.collect()}
    assert set(got) == {1, 2} and got[2].docs == [] and got[2].title == ""
    assert [d.title for d in got[1].docs] == [f"Police Raid {k}" for k in range(5)]
    assert {r.story_id for r in mg.signature_input(stories, articles, most=1).collect()} == {1}
    signed = {r.story_id: r for r in mg.signed_stories(listed).collect()}
    assert signed[2].signature == [] == signed[2].keywords_hit
    assert signed[1].keywords_hit == ["cup", "fifa", "police"] and "police raid" in signed[1].signature
    pair = spark.createDataFrame([(1, "city council vote", NOW, ["vote", "city"]), (2, "city council", NOW, ["city", "mayor"])], "story_id long, title string, ts timestamp_ntz, signature array<string>")
    assert mg.merge_candidates(pair).first().merged_signature == ["city", "mayor", "vote"]


def test_retrieval_says_what_is_wrong(spark):
    a = spark.createDataFrame([(1, NOW, [1.0, 0.0]), (2, NOW, [1.0, 0.1]), (3, NOW, None), (4, NOW, [0.0, 1.0, 0.0])], "id long, published_at timestamp_ntz, embedding array<double>")
    links = spark.createDataFrame([(1, 10), (2, 20), (2, 30)], "article_id long, story_id long")
    queries = spark.createDataFrame([(1,), (3,), (4,), (77,), (1,)], "query_id long")
    got = {r.query_id: (r.stories, r.unique_stories, r.error) for r in cl.retrieved(queries, a, links).collect()}
    assert got == {1: ([20, 30], 2, None), 3: ([], 0, "query_embedding_is_null"), 4: ([], 0, None), 77: ([], 0, "query_article_not_found")}


def test_runs_are_logged_once(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    made = spark.createDataFrame([("r1", "top_events_params", "v0", [1, 2], {"k": 5.0})], "run_id string, eval_type string, algorithm_name string, algo_topk array<int>, metrics map<string, double>")
    for _ in range(2):
        ev.log_eval(made, store, F.lit(NOW))
    ev.log_eval(made.withColumn("run_id", F.lit("r2")).drop("metrics"), store, F.lit(NOW))
    got = {r.run_id: r for r in store.read("algorithm_eval_logs").collect()}
    assert set(got) == {"r1", "r2"} and store.read("algorithm_eval_logs").count() == 2
    assert (got["r1"].algo_topk, got["r1"].metrics, got["r1"].params, got["r1"].sample_event_ids, got["r1"].created_at) == ("[1,2]", '{"k":5.0}', "{}", "[]", NOW)
    assert got["r2"].metrics == "{}" and got["r2"].notes is None


def test_missing_work(spark):
    rows = [(1, NOW, None, None), (2, NOW - timedelta(days=8), [1.0], None), (3, NOW, [1.0], "FACT"), (4, NOW, [1.0], None), (5, None, None, None), (6, NOW - timedelta(days=11), [1.0], None)]
    a = spark.createDataFrame(rows, "id long, published_at timestamp_ntz, embedding array<double>, article_type string")
    links = spark.createDataFrame([(3,), (3,)], "article_id long")
    assert tuple(ev.missing_work(a, links, ad.as_of()).first()) == (1, 2, 2)
