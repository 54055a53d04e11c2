import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyweft.llm import jaccard, lines, substrings
from storyweft.llm.common import shared_dir
from storyweft.llm.components import connected

from . import cases


def rows_of(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


@pytest.mark.parametrize("batches", [1, 5])
def test_suffix_arrays_equal_brute_force(spark, batches):
    rows = cases.awkward()
    got = rows_of(substrings.substring_dedup(cases.documents(spark), batches=batches), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == cases.removed(rows)


@pytest.mark.parametrize("flush", [1, 7, 1 << 16])
def test_a_document_that_repeats_a_passage_loses_every_occurrence(spark, flush):
    passage, other = ("".join(map(chr, np.random.default_rng(k).integers(97, 123, 300))) for k in (1, 2))
    rows = [(1, "owner " + passage + other), *[(k, f"{k}" * k) for k in range(2, 6)], (7, f"x {passage} y {passage} z {passage} {other}"), (7, f"w {passage}{passage}"), (8, "a" * 400), (9, "b " + "a" * 900), (10, passage * 3)]
    docs = cases.documents(spark, rows).repartition(4, F.col("text"))
    got = rows_of(substrings.substring_dedup(docs, flush=flush), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == cases.removed(rows)


def test_suffix_levels_merge_geometrically(spark):
    family = substrings.SuffixIndexFamily(spark, 4)
    for k in range(4):
        docs = spark.createDataFrame([(k, b"0123456789abcdefghijklmnopqrstuvwxyz" * 3)], "doc_id long, text binary")
        family.add(docs)
        assert set(family.levels) == {r for r in range(3) if (k + 1) >> r & 1}
    assert {r.doc for r in family.candidates().collect()} == {0, 1, 2, 3}


def test_samples_depend_on_content_alone():
    rng = np.random.default_rng(0)
    shared = bytes(rng.integers(97, 100, 50, dtype=np.uint8))
    for n in range(60):
        a, b = bytes(rng.integers(97, 122, n, dtype=np.uint8)) + shared, shared + bytes(rng.integers(97, 122, 2 * n, dtype=np.uint8))
        doc, _, key = substrings.sampled([a, b])
        assert set(key[doc == 0]) & set(key[doc == 1])


def test_suffix_arrays_of_nothing(spark):
    assert substrings.substring_dedup(cases.documents(spark).limit(0)).count() == 0


def test_jaccard_equals_brute_force(spark):
    rows = cases.awkward()
    assert rows_of(jaccard.jaccard_components(cases.documents(spark)), "doc_id", "n_shingles", "component_id") == cases.components(rows)


@pytest.mark.parametrize(("rare", "rounds"), [(32, 0), (1, 0), (2, 1)])
def test_jaccard_token_combinations_alone_lose_no_link(spark, rare, rounds):
    rows = cases.awkward(1, 20) + [(400 + k, "a b c d e f g h i j k l m n o p q r s t u v w x y z " + f"tail{k}") for k in range(6)]
    got = rows_of(jaccard.jaccard_components(cases.documents(spark, rows), rare=rare, rounds=rounds), "doc_id", "n_shingles", "component_id")
    assert got == cases.components(rows)


def test_one_of_each_keeps_the_columns(spark):
    docs = cases.documents(spark)
    one = jaccard.one_of_each(docs)
    assert one.columns == docs.columns
    rows = one.collect()
    assert Counter(r.doc_id for r in rows) == cases.one_of_each(cases.awkward())
    assert {r.text for r in rows if r.doc_id == 311} == {"same id", "other text of the same id"}


def test_ids_that_repeat_and_ids_that_are_null(spark):
    rng = random.Random(5)
    a, b, c, d = (cases.prose(rng, 60) for _ in range(4))
    rows = [(3, a), (7, a), (7, b), (9, b), (5, c), (None, c + " x"), (None, d), (None, None), (None, d)]
    got = rows_of(jaccard.jaccard_components(cases.documents(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == cases.components(rows) and (9, 56, 3) in got
    assert Counter(r.doc_id for r in jaccard.one_of_each(cases.documents(spark, rows)).collect()) == Counter({3: 1, 7: 1, 5: 1, None: 2})


@pytest.mark.parametrize("rare", [2, 32])
def test_a_group_of_near_copies_needs_few_pairs(spark, rare, monkeypatch):
    rng = random.Random(rare)
    base, rows, pairs = cases.prose(rng, 150).split(" "), [], []
    for i in range(700):  # copies with 1 to 12 edits, of the text or of a copy
        words = list(base if i < 20 or rng.random() < 0.7 else rows[rng.randrange(len(rows))][1].split(" "))
        for _ in range(rng.randrange(1, 13)):
            words[rng.randrange(len(words))] = f"edit{i}_{rng.randrange(99)}"
        rows.append((i, " ".join(words)))
    verified = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda p, lists, percent: pairs.append(p.count()) or verified(p, lists, percent))
    got = rows_of(jaccard.jaccard_components(cases.documents(spark, rows), rare=rare), "doc_id", "n_shingles", "component_id")
    assert got == cases.components(rows)
    assert sum(pairs) < 700 * 40  # of 245 thousand pairs


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_components(cases.documents(spark).limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31), (31, 30), (40, 40)], "u long, v long")
    got = {r.node: r.component for r in connected(links, shared_dir(spark)).collect()}
    assert got == {k: 0 for k in range(21)} | {30: 30, 31: 30}


LOG = ["user 17 logged in from 10.0.0.1 today", "user 23 logged in from 10.9.0.1 today", "user 5 logged in from elsewhere today"]


def test_lines(spark):
    rows = [(i, f"unique line of document {chr(97 + i)} {'ab'[i % 2] * (i + 1)}\n{LOG[i % 3]}\nshared licence line here\nshort") for i in range(9)]
    rows += [(20, None), (21, ""), (22, "shared licence line here\nshared licence line here"), (23, "shared licence line here\nshared licence line here"), (23, "shared licence line here\nshared licence line here"), (None, "shared licence line here")]
    docs = cases.documents(spark, rows)
    got = {(r.doc_id, r.text) for r in lines.line_deduplicated(docs).collect()}
    assert (0, rows[0][1]) in got  # the first holder keeps its lines
    assert (5, rows[5][1].split("\n")[0] + "\nshort") in got
    assert (20, None) in got and (21, "") in got and (22, "") in got and (None, "") in got
    counted = lines.without_recurring_lines(docs).where("row.doc_id = 23").collect()
    assert [(r.n_lines, r.n_dropped) for r in counted] == [(2, 2), (2, 2)]
    assert lines.line_deduplicated(docs.limit(0)).count() == 0
    plan = lines.line_deduplicated(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def masked_lines(text):
    import re

    return [re.sub(r"[\t\r ]+", " ", re.sub(r"(?<!\S)[^\s0-9]*[0-9]\S*", "<*>", x)).strip(" ") for x in text.split("\n")]


def brute_lines(rows, least=5, tokens=3, depth=4, splits=3, similarity=0.7):
    """The template tree, wording by wording."""
    texts, first = {}, {}
    for i, t in rows:
        for x in masked_lines(t or ""):
            if len(x.split(" ")) >= tokens and x.replace("<*>", "").strip():
                texts.setdefault(x, set()).add(t)
                first[x] = min(first.get(x, i), i)
    drop = {x: first[x] for x in texts if len(texts[x]) >= least}
    nodes = {}
    for x in texts:
        w = x.split(" ")
        nodes.setdefault((len(w), *w[:depth]), []).append(w)
    for k in range(splits + 1):
        children = {}
        for key, node in nodes.items():
            if len(node) < 2 or sum(len(texts[" ".join(w)]) for w in node) < least:
                continue
            votes = Counter((j, v) for w in node for j, v in enumerate(w))
            fixed = {t for t, n in votes.items() if 2 * n > len(node)}
            agreed = lambda w: [v for j, v in enumerate(w) if (j, v) in fixed]  # noqa: E731, B023
            members = [w for w in node if len(agreed(w)) >= similarity * len(w) and set(agreed(w)) - {"<*>"}]
            of = set().union(*(texts[" ".join(w)] for w in members))
            for w in members if len(of) >= least else []:
                x = " ".join(w)
                drop[x] = min(drop.get(x, 1 << 62), min(first[" ".join(v)] for v in members))
            for w in node:
                shared = [(votes[j, v], -j, v) for j, v in enumerate(w) if 1 < votes[j, v] < len(node)]
                if w not in members and shared:
                    children.setdefault((key, max(shared)[1:]), []).append(w)
        nodes = children
    return sorted((i, "\n".join(a for a, b in zip(t.split("\n"), masked_lines(t)) if drop.get(b, i) == i)) for i, t in rows)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(3)) for _ in range(n))


@pytest.mark.parametrize("seed", range(2))
def test_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    hot = [words(rng, 6) for _ in range(3)] + ["12 34 56 78"]
    heads = [words(rng, 4) for _ in range(3)]
    tails = [words(rng, 5).split(" ") for _ in range(4)]

    def line():
        kind = rng.random()
        if kind < 0.4:
            return words(rng, 8)
        if kind < 0.6:
            return rng.choice(hot)
        tail = list(rng.choice(tails))
        tail[rng.randrange(5)] = words(rng, 1)
        return f"{rng.choice(heads)} {' '.join(tail)}" + (f"\t at {rng.randrange(99)}" if rng.random() < 0.3 else "")

    rows = [(i, "\n".join(line() for _ in range(8))) for i in range(70)]
    got = sorted((r.doc_id, r.text) for r in lines.line_deduplicated(cases.documents(spark, rows)).collect())
    assert got == brute_lines(rows)


def test_templates_that_share_a_leaf_are_both_found(spark):
    rng = random.Random(9)
    a, b = "the job on alpha named {} has ended well", "the job on alpha was put off until {}"
    rows = [(i, f"{(a, b)[i % 2].format(words(rng, 1))}\n{words(rng, 7)}") for i in range(40)]
    rows += [(100 + i, "the job on alpha that is the hot line\n" + words(rng, 7)) for i in range(60)]
    docs = cases.documents(spark, rows)
    got = {r.doc_id: r.text for r in lines.line_deduplicated(docs).collect()}
    assert sum(t.startswith("the job") for t in got.values()) == 3 and got == dict(brute_lines(rows))


def test_lines_of_documents_without_an_id(spark):
    rng = random.Random(4)
    shared, loose = "this line stands in every document", "the job on beta {} is at its end"
    text = lambda k: f"{shared}\n{loose.format(words(rng, 1))}\n{words(rng, 7)}"
    for rows in ([(None, text(k)) for k in range(6)], [(i, text(i)) for i in range(6)] + [(None, text(k)) for k in range(6)]):
        out = lines.without_recurring_lines(cases.documents(spark, rows)).collect()
        kept = [r for r in out if shared in r.text]
        assert len(kept) == 1 == len([r for r in out if "the job on" in r.text])
        assert kept[0].row.doc_id == min((i for i, _ in rows if i is not None), default=None)
        assert sorted(r.n_dropped for r in out) in ([0] + [2] * (len(rows) - 1), [1, 1] + [2] * (len(rows) - 2))
