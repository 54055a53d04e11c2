"""Runs that go on where they stopped, translations, backgrounds, baseline retrieval, the largest pair weight."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from storyweft.functions.text import fnv1a, tokens_norm
from storyweft.operators import backgrounds as bg, coverage as cov, evaluation as ev, merging as mg
from storyweft.plans import pipeline as pl, translations as tr
from storyweft.sources.tablestore import TableStore

NOW = datetime(2024, 1, 31)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    store, calls = TableStore(spark, str(tmp_path)), Counter()
    articles = spark.createDataFrame([(i, f"quake storm {i}", NOW - timedelta(hours=i)) for i in range(6)] + [(9, " ", NOW), (10, None, NOW)], "id long, title string, published_at timestamp_ntz")
    store.append("articles", articles)

    def fails(at):
        calls["fails"] += 1
        if calls["fails"] == 2:  # the first is the dry run
            raise RuntimeError("stopped")
        return {"counts": ("replace", at.read("embeddings").agg(F.count("*").alias("n")))} if "embeddings" in at else {}

    steps = [pl.embedding_step(lambda at: at.read("articles"), lambda df: F.col("title"), tokens_norm, limit=4), pl.Step("counts", fails)]
    assert pl.run_steps(store, 1, steps, dry_run=True) == [("embeddings", "DRY_RUN", {"embeddings": 4}), ("counts", "DRY_RUN", {})] and store.snapshot().version == 1
    with pytest.raises(RuntimeError):
        pl.run_steps(store, 1, steps)
    assert sorted(r.id for r in store.read("embeddings").collect()) == [0, 1, 2, 3]  # the newest
    assert pl.run_steps(store, 1, steps) == [("embeddings", "SKIPPED", {}), ("counts", "DONE", {"counts": 1})]
    assert [x[1] for x in pl.run_steps(store, 1, steps)] == ["SKIPPED", "SKIPPED"]
    assert pl.run_steps(store, 2, steps, only={"embeddings"}) == [("embeddings", "DONE", {"embeddings": 2})]
    before = {r.id: r.hash for r in store.read("embeddings").collect()}
    assert pl.run_steps(store, 3, steps, only={"embeddings"}) == [("embeddings", "DONE", {"embeddings": 0})]
    store.update("articles", spark.createDataFrame([(2, "another title", None)], articles.schema), "id")
    pl.run_steps(store, 4, steps, only={"embeddings"})  # a changed text is embedded anew
    after = {r.id: r.hash for r in store.read("embeddings").collect()}
    assert [i for i in after if after[i] != before[i]] == [2] and len(after) == 6


def test_rounds_until_nothing_is_left(spark, tmp_path):
    assert [pl.rounds_for(n) for n in (0, 1, 100, 101, 950, 5000)] == [2, 3, 3, 4, 12, 30]
    kind = "id long, title string, published_at timestamp_ntz, embedding array<double>"
    a = spark.createDataFrame([(i, f"alpha bravo {'canal ember'.split()[i % 2]}", NOW - timedelta(minutes=i), [1.0, float(i % 2), 0.01 * i]) for i in range(10)], kind)
    none, stories = spark.createDataFrame([], "article_id long, story_id long"), spark.createDataFrame([], "story_id long, title string, status string, end_time timestamp_ntz")
    free = lambda links: a.join(links.select(F.col("article_id").alias("id")), "id", "left_anti")
    save = lambda name, df: (df.write.parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}"))[1]
    links, named = pl.cluster_until_converged(a, none, stories, lambda links: free(links).orderBy(F.col("published_at").desc()).limit(4), save, remaining=lambda links: free(links).count())
    assert links.count() == 10 == links.select("article_id").distinct().count()
    assert {r.story_id for r in links.collect()} == {r.story_id for r in named.collect()}
    stuck, _ = pl.cluster_until_converged(a, none, stories, lambda links: a.limit(0), save, most_rounds=5)
    assert stuck.count() == 0


def test_translations_follow_their_source_titles(spark, tmp_path):
    store, asked = TableStore(spark, f"{tmp_path}/s"), f"{tmp_path}/asked"
    stories = spark.createDataFrame([(1, "One", None), (2, " Two ", "Generated"), (3, None, " "), (4, "bad", None)], "story_id long, title string, generated_title string")

    def call(requests):
        with open(asked, "a") as f:
            f.writelines(f"{r['titles'][0]}\n" for r in requests)
        return ["no json" if r["titles"] == ["bad"] else f'{{"title": "zh {r["titles"][0]}"}}' for r in requests]

    said = lambda: sorted(open(asked).read().split("\n")[:-1])  # noqa: E731, SIM115
    got = {r.story_id: (r.status, r.title, r.action) for r in tr.translated(store, stories, NOW, call=call).collect()}
    assert got == {1: ("SUCCESS", "zh One", "USE"), 2: ("SUCCESS", "zh Generated", "USE"), 3: ("EMPTY_SOURCE_TITLE", None, "EMPTY"), 4: ("PENDING", "bad", "RETRY")}
    assert said() == ["Generated", "One", "bad"]
    later = stories.withColumn("title", F.when(F.col("story_id") == 1, "One, changed").otherwise(F.col("title")))
    got = {r.story_id: (r.status, r.title) for r in tr.translated(store, later, NOW + timedelta(minutes=5), call=call).collect()}
    assert got[1] == ("SUCCESS", "zh One, changed") and got[2] == ("SUCCESS", "zh Generated") and said() == ["Generated", "One", "One, changed", "bad", "bad"]
    pending = spark.createDataFrame([(1, "zh", "v1", "One", None, "PENDING", None, NOW)], tr.CACHE)
    state = lambda s: [r.action for r in tr.translation_state(stories.where("story_id = 1"), pending, F.lit(NOW + timedelta(seconds=s)).cast("timestamp_ntz")).collect()]
    assert state(89) == ["WAIT"] and state(90) == ["RETRY"]
    assert [r.action for r in tr.translation_state(stories.where("story_id = 1"), pending, F.lit(NOW), prompt_version="v2").collect()] == ["CHANGED"]


def test_backgrounds_equal_the_fold(spark):
    def fnv(text):
        h = 2166136261
        for c in text:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h

    rng = random.Random(8)
    stories = [(k, rng.choice(["crime", "SPORTS", "Politics", None, "weather"]), k // 3) for k in range(400)]
    used, want = {}, {}
    for k, raw, _ in sorted(stories, key=lambda s: (s[2], s[0])):
        cat = {c.lower(): c for c in bg.FILES}.get((raw or "").lower(), "General")
        pool, taken = bg.pool_of(cat), used.setdefault(cat, set())
        key = f"2024-01-31:{cat}:{k}"
        at, step = fnv(key) % len(pool), 1 + fnv(f"step:{key}") % (len(pool) - 1)
        pick = next((pool[(at + step * i) % len(pool)] for i in range(len(pool) + 1) if pool[(at + step * i) % len(pool)] not in taken), pool[at])
        taken.add(pick)
        want[k] = (cat, pick)
    df = spark.createDataFrame(stories, "story_id long, category string, place int")
    assert {r.story_id: (r.category, r.background) for r in bg.assigned_backgrounds(df, "2024-01-31").collect()} == want
    assert bg.assigned_backgrounds(df.limit(0), "2024-01-31").count() == 0
    assert [len(bg.pool_of(c)) for c in bg.FILES] == [10] * 6 + [15] and spark.range(1).select(fnv1a(F.lit("a"))).first()[0] == fnv("a")


def test_baseline_retrieval(spark):
    kind = "id long, title string, published_at timestamp_ntz, embedding array<double>"
    a = spark.createDataFrame([(i, f"t{i}", NOW, [1.0, 0.1 * i]) for i in range(8)] + [(99, " ", NOW, [1.0, 0.0])], kind)
    links = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 10), (5, 30)], "article_id long, story_id long")
    got = rows(ev.baseline_candidates(a.where("id = 0"), a, links, 5, 2))
    assert got == [(0, 10, 1, 2), (0, 20, 2, 1)]  # neighbours 99, 1 to 4
    labels = spark.createDataFrame([(0, 10), (1, 20)], "query_id long, true_story_id long")
    assert ev.known_queries(labels, a).count() == 2
    with pytest.raises(ValueError, match=r"\[7777, 9999\]"):
        ev.known_queries(labels.unionByName(spark.createDataFrame([(9999, 1), (7777, 1)], labels.schema)), a)
    with pytest.raises(ValueError, match="99"):
        ev.known_queries(spark.createDataFrame([(99, 1)], labels.schema), a)


def posted(spark, lists, share=0.35):
    df = Counter(t for own in lists for t in set(own))
    n = len(lists)
    idf = {t: math.log((n + 1) / (k + 1)) + 1 for t, k in df.items() if k <= max(2, int(n * share))}
    post = [(i, t, df[t], idf[t]) for i, own in enumerate(lists) for t in set(own) if t in idf]
    return spark.createDataFrame(post, "story_id long, token string, df long, idf double"), idf


@pytest.mark.parametrize(("n", "shape"), [(300, 0.7), (300, 0.2), (60, 5.0), (2, 1.0)])
def test_largest_weight(spark, n, shape):
    rng = random.Random(n)
    lists = [sorted({f"w{int(rng.paretovariate(shape)) % 5000}" for _ in range(12)}) for _ in range(n)]
    post, idf = posted(spark, lists)
    want = max((sum(idf.get(t, 0) for t in set(a) & set(b)) for k, a in enumerate(lists) for b in lists[:k]), default=0)
    got = mg.largest_weight(post)
    assert (got or 0) == pytest.approx(want) and (mg.largest_weight(post, want + 1) == want + 1)


def test_pairs_stay_linear(spark):
    made = {}
    for n in (10_000, 100_000):
        lists = spark.range(n, numPartitions=4).select(F.col("id").alias("story_id"), F.array_distinct(F.array(*[(F.floor(F.pow(F.rand(k) * 0.999999 + 0.000001, F.lit(-1.1))) % 500_000).cast("string") for k in range(12)])).alias("signature"))
        lists.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/lists{n}")
        lists = spark.read.parquet(path)
        rare = mg.df_idf(lists).where(F.col("df") <= int(0.35 * n))
        post = lists.select("story_id", F.explode("signature").alias("token")).join(rare, "token")
        made[n] = []
        assert mg.largest_weight(post, 0.0, made[n]) > 10
    assert sum(made[100_000]) < 30 * sum(made[10_000]) + 1000 and sum(made[100_000]) < 40 * 100_000


def test_an_order_of_eighty_articles(spark):
    rng = random.Random(3)
    for heavy in (0.0, 0.7, 0.95):
        made = [(1, i, 0 if rng.random() < heavy else rng.choice([None, 1, 2, 3]), rng.choice(["FACT", "OPINION", None, "ANALYSIS"]), NOW - timedelta(hours=rng.randrange(60))) for i in range(80)]
        df = spark.createDataFrame(made, "story_id long, article_id long, source_id int, article_type string, published_at timestamp_ntz")
        kinds = {"FACT": "FACT", "OPINION": "COMMENTARY", None: "UNKNOWN", "ANALYSIS": "INTERPRETATION"}
        rest, cap, by_source, by_kind, want = sorted(((-(r[4] - NOW).total_seconds(), -r[1], r[1], r[2], kinds[r[3]]) for r in made)), 48, Counter(), Counter(), []
        rest = [r[2:] for r in rest]
        while rest:
            under = [r for r in rest if r[1] is None or by_source[r[1]] < cap]
            least = min({r[2] for r in rest}, key=lambda t: (by_kind[t], t))
            ways = (([r for r in under if r[1] is not None and not by_source[r[1]]], "NEW_SOURCE"), ([r for r in under if r[2] == least], "TYPE_COVERAGE"), (under, "BASELINE_FILL"), (rest, "CAP_RELAXED_FILL"))
            pick, why = next((f[0], w) for f, w in ways if f)
            rest.remove(pick)
            by_source[pick[1]] += 1
            by_kind[pick[2]] += 1
            want.append((pick[0], len(want) + 1, why))
        got = [tuple(r)[1:] for r in cov.diversity_order(df, 30).orderBy("position").collect()]
        assert got == want
        assert [r.article_id for r in cov.diversity_order(df).orderBy("position").collect()] == [r[1] for r in sorted(made, key=lambda r: (r[4], r[1]), reverse=True)]
        assert cov.diversity_order(df, 60, k=5, pool=50).count() == 5
    with pytest.raises(ValueError, match="share"):
        cov.diversity_order(df, 30, share=0.5)


def test_an_audit_against_all_of_many_stories(spark):
    top = spark.createDataFrame([(k, f"quake storm w{k}" if k % 50 else "the") for k in range(1200)], "story_id long, title string")
    a = spark.createDataFrame([(k, k, f"quake w{k}" if k % 3 else "of the") for k in range(1300)], "article_id long, story_id long, title string")
    out = {r.article_id: r for r in ev.misattachment_audit(a, top).collect()}
    assert len(out) == 1200
    assert (out[1199].self_sim, out[1199].best_other_sim, out[1199].best_other, out[1199].conflict) == (pytest.approx(2 / 3), 0.25, 1, False)
    assert (out[150].self_sim, out[150].best_other_sim, out[150].best_other) == (1.0, 1.0, 0)  # both without a token
    assert (out[3].self_sim, out[3].best_other_sim, out[3].suspect) == (0.0, 1.0, True)
    assert ev.misattachment_audit(a, top.where("story_id = 7")).first().best_other is None
