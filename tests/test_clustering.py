"""Rounds of clustering against one plain loop over all queries."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from storyweft.functions import vectors
from storyweft.functions.fuzzy import token_set
from storyweft.functions.vectors import nearest
from storyweft.operators import clustering as cl
from storyweft.operators.graph import components

NOW = datetime(2024, 1, 31)
ARTICLES = "id long, title string, published_at timestamp_ntz, embedding array<double>"
STORIES = "story_id long, title string, status string, end_time timestamp_ntz"
WORDS = "alpha bravo canal delta ember flood grant heron ivory joker karma lemon mango noble ocean piano".split()


def made(rng, n, asked, topics, spread):
    """Articles around topics, of which the newest `asked` have no story; links and stories of the others."""
    base = rng.normal(size=(topics, 24))
    rows = []
    for i in range(n):
        t = int(rng.integers(topics))
        v = base[t] + spread * rng.normal(size=24)
        words = [WORDS[(t + int(k)) % len(WORDS)] for k in rng.integers(0, 5, 4)]
        rows.append((i, " ".join(words), NOW - timedelta(minutes=int(rng.integers(0, 9 * 24 * 60))) if i % 37 else None, v.tolist(), t))
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or NOW, r[0]), reverse=True)
    free = {r[0] for r in order[:asked]}
    stories = {}
    for r in rows:
        if r[0] not in free:
            stories.setdefault(r[4] * 10 + int(rng.integers(3)), []).append(r)
    links = [(r[0], s) for s, own in stories.items() for r in own]
    named = [(s, own[0][1], "closed" if s % 7 == 0 else "active", max((r[2] for r in own if r[2]), default=None)) for s, own in stories.items() if s % 11]
    return [r[:4] for r in rows], [r for r in rows if r[0] in free], links, named


def plain_loop(articles, asked, links, named, days, m, n):
    """The decisions, one query after another, each over all of its neighbours."""
    ids, at = [r[0] for r in articles], {r[0]: r[2] for r in articles}
    unit = np.array([r[3] for r in articles])
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    where = {i: k for k, i in enumerate(ids)}
    of, info = dict(links), {s: [t, c, e] for s, t, c, e in named}
    tokens = lambda t: t.split()  # noqa: E731  these words have no stop words and no suffixes
    fresh, out = max(info), {}
    for i, title, when, *_ in sorted(asked, key=lambda r: (r[2] is not None, r[2] or NOW, r[0]), reverse=True):
        sims = unit @ unit[where[i]]
        near = [(float(sims[where[j]]), j) for j in ids if j != i and at[j] and when and abs(at[j] - when) <= timedelta(days=days)]
        best = {}
        for sim, j in sorted(near, key=lambda x: (-x[0], x[1]))[:m]:
            if j in of:
                best[of[j]] = max(best.get(of[j], -2.0), sim)
        choice = None
        for s, sim in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:n]:
            if s in info and info[s][1] != "closed":
                a, b = set(tokens(title)), set(tokens(info[s][0]))
                key = (sim, token_set(tokens(title), tokens(info[s][0])), -s, len(a & b) / len(a | b))
                choice = max(choice, key) if choice else key
        if choice and cl.merges(choice[0], choice[1], choice[3], when, info[-choice[2]][2]):
            s, action = -choice[2], "merge"
            if when and (info[s][2] is None or when > info[s][2]):
                info[s][2] = when
        else:
            fresh, action = fresh + 1, "new"
            s = fresh
            info[s] = [title, None, when]
        of[i] = s
        out[i] = (action, s)
    return out


@pytest.mark.parametrize(("n", "asked", "topics", "spread", "m", "top"), [(700, 300, 30, 0.5, 2000, 20), (700, 300, 12, 1.1, 40, 3), (500, 300, 200, 0.7, 2000, 20), (4200, 3000, 300, 0.6, 60, 20)])
def test_a_round_equals_the_plain_loop(spark, n, asked, topics, spread, m, top):
    articles, free, links, named = made(np.random.default_rng(n + topics), n, asked, topics, spread)
    a = spark.createDataFrame(articles, ARTICLES)
    q = a.join(spark.createDataFrame([(r[0],) for r in free], "id long"), "id", "left_semi")
    got = cl.cluster(q, a, spark.createDataFrame(links, "article_id long, story_id long"), spark.createDataFrame(named, STORIES), 7, m, top)
    got = {r.article_id: (r.action, r.story_id) for r in got.collect()}
    want = plain_loop(articles, free, links, named, 7, m, top)
    assert got == want
    assert {x[0] for x in want.values()} == {"new", "merge"}


def test_a_round_of_nothing(spark):
    none = spark.createDataFrame([], ARTICLES)
    links, stories = spark.createDataFrame([], "article_id long, story_id long"), spark.createDataFrame([], STORIES)
    assert cl.cluster(none, none, links, stories).count() == 0
    one = spark.createDataFrame([(5, "alpha", NOW, [1.0, 0.0])], ARTICLES)
    assert [tuple(r) for r in cl.cluster(one, one, links, stories).collect()] == [(5, "new", 1)]


def test_components_of_a_chain_and_a_star(spark, tmp_path):
    rng = random.Random(3)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    links = [*zip(chain, chain[1:]), *((7, k) for k in range(1000, 1200)), (5, 7), (50, 50), (61, 60), (60, 61)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u int, v int"), str(tmp_path)).collect()}
    want = {k: 100 for k in chain} | {k: 5 for k in [5, 7, *range(1000, 1200)]} | {60: 60, 61: 60}
    assert got == want
    assert components(spark.createDataFrame([], "u int, v int"), f"{tmp_path}/none").count() == 0


def test_neighbours_have_the_same_width(spark):
    rows = [(1, "a", NOW, [1.0, 0.0]), (2, "b", NOW, [1.0, 0.1]), (3, "c", NOW, [1.0, 0.0, 0.0]), (4, "d", NOW, [1.0, 0.0, 0.2]), (5, "e", NOW, None), (6, "f", NOW, [])]
    a = spark.createDataFrame(rows, ARTICLES)
    for days in (None, 7):
        assert sorted((r.query_id, r.article_id) for r in nearest(a, a, 5, days).collect()) == [(1, 2), (2, 1), (3, 4), (4, 3)]


def test_rows_of_neighbours_do_not_grow_with_blocks(spark):
    """What leaves the tasks is as long as the result, however many blocks a query meets; ties, several stories and none included."""
    rng = random.Random(5)
    n, m = 900, 7
    vector = lambda: [rng.choice((-1.0, 1.0)) for _ in range(4)] if rng.random() < 0.7 else [float(k == 0) for k in rng.sample(range(4), 4)]  # noqa: E731  (exact when of unit length)
    rows = [(k, "", NOW - timedelta(hours=rng.randrange(400)), vector()) for k in range(n)]
    a = spark.createDataFrame(rows, ARTICLES).repartition(9).select("id", "published_at", "embedding")
    links = [(k, s) for k in range(n) for s in rng.sample(range(40), rng.choice([0, 1, 1, 3]))]
    told = spark.createDataFrame(links + links[:50], "article_id long, story_id int")
    of = {k: {s for x, s in links if x == k} for k in range(n)}
    unit = {k: np.array(v) / np.linalg.norm(v) for k, _, _, v in rows}
    for days in (None, 5):
        assert vectors._met(a, a, m, days, 64).count() == n * m
        want = set()
        for k, _, at, _ in rows:
            near = [(-round(float(unit[k] @ unit[x]), 9), x) for x, _, when, _ in rows if x != k and (days is None or abs(at - when) <= timedelta(days=days))]
            for s in {s for _, x in sorted(near)[:m] for s in of[x]}:
                sim, x = min(p for p in sorted(near)[:m] if s in of[p[1]])
                want.add((k, s, -sim, x))
        got = vectors.nearest_stories(a, a, told, m, days, block=64)
        assert got.schema["story_id"].dataType.typeName() == "integer"
        assert {(r.query_id, r.story_id, round(r.sim, 9), r.article_id) for r in got.collect()} == want
