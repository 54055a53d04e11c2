import numpy as np
from pyspark.sql import functions as F

from storyweft.llm import language, toxicity

from . import cases

BAD = ["vile", "rotten", "beastly"]


def labelled(spark, n=600):
    rng = __import__("random").Random(2)
    rows, marks = [], []
    for i in range(n):
        words = cases.prose(rng, 40).split(" ")
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(40), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic) if i % 97 else None))
    return cases.documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_of_held_out_rows(spark):
    docs, labels = labelled(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 600 and all(r.held_out == (cases.crc(str(r.doc_id)) % 5 == 0) for r in rows)
    out = [(r.predicted, int(r.doc_id % 5 == 0)) for r in rows if r.held_out]
    assert np.mean([p == y for p, y in out]) >= 0.95
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(3), labels.repartition(2)).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_toxicity_of_odd_texts(spark):
    _, labels = labelled(spark)
    docs = cases.documents(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def speech(spark, n=300):
    rng = __import__("random").Random(3)
    parts = {"xx": ["ka", "lo", "mi"], "yy": ["sch", "ung", "ei"], "zz": ["éa", "ou", "qua"]}
    rows = []
    for i in range(n):
        lang = "xyz"[i % 3] * 2
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(12)), lang if i % 11 else None, "s", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_language_of_held_out_rows(spark):
    docs = speech(spark)
    model = language.train(docs)
    rows = language.identified(docs, model).withColumn("out", language.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang_pred == "xyz"[r.doc_id % 3] * 2 for r in rows if r.out]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in language.identified(spark.createDataFrame([(1, None), (2, ""), (3, "12 34 ²"), (4, "schung" * 3000)], "doc_id long, text string"), model).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and odd[4].lang_pred == "yy"
    assert model == language.train(docs.repartition(5))


def test_language_without_labels(spark):
    docs = speech(spark, 30).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identified(docs, language.train(docs)).collect()} == {"und"}
    assert language.identified(docs.limit(0), None).count() == 0


def plain_features(text):
    """Kinds of features as texts: words, and pairs with up to two words between."""
    import re

    w = re.findall(r"\w+", (text or "").lower())
    return {("word", x) for x in w} | {(gap, a, b) for gap in (1, 2, 3) for a, b in zip(w, w[gap:])}


def test_features_are_the_distinct_words_and_pairs():
    f = toxicity.Features()
    for text in ["a b c a b", "one two", "x", "", None, "ä ö ü ß " * 50, cases.prose(__import__("random").Random(1), 300)]:
        assert len(f(text)) == len(plain_features(text)) or len(plain_features(text)) > 500 and len(f(text)) > 0.99 * len(plain_features(text))
        assert list(f(text)) == list(toxicity.Features()(text))


def test_ftrl_equals_the_scalar_algorithm():
    rng = np.random.default_rng(4)
    rows = [(np.unique(rng.integers(0, 40, 6)), int(rng.random() < 0.4)) for _ in range(120)] + [(np.array([toxicity.HALF + 3]), 1)]
    alpha, beta, l1, positive = 3.0, 1.0, 0.5, 2.0
    z, n, bias = {}, {}, 1 << toxicity.BITS
    value = lambda i: 0.3 if toxicity.HALF <= i < bias else 1.0

    def weight(i):
        limit = 0.0 if i == bias else l1
        if abs(z.get(i, 0.0)) <= limit:
            return 0.0
        return -(z[i] - np.sign(z[i]) * limit) / ((beta + n[i] ** 0.5) / alpha)

    for _ in range(6):
        for x, y in rows:
            ids = [*map(int, x), bias]
            w = [weight(i) for i in ids]
            p = 1 / (1 + np.exp(-sum(a * value(i) for a, i in zip(w, ids))))
            for i, a in zip(ids, w):
                g = (p - y) * (positive if y else 1.0) * value(i)
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha * a
                n[i] = n.get(i, 0.0) + g * g
    got = toxicity.ftrl(rows, l1=l1)
    assert np.allclose(got[list(z)], [weight(i) * value(i) for i in z]) and not np.delete(got, list(z)).any()


def test_scores_equal_a_plain_sum(spark):
    docs, labels = labelled(spark, 200)
    weights = toxicity.train(docs, labels)
    w, f = dict(weights), toxicity.Features()
    rows = {r.doc_id: r.score for r in toxicity.scored(docs, weights).collect()}
    for r in docs.collect():
        x = w[1 << toxicity.BITS] + sum(w.get(int(i), 0.0) for i in f(r.text))
        assert abs(rows[r.doc_id] - 1 / (1 + np.exp(-x))) < 1e-9
    twice = docs.unionByName(docs.where("doc_id < 50"))
    assert toxicity.train(twice, labels.unionByName(labels)) == weights


def test_language_scores_equal_a_plain_average(spark):
    docs = speech(spark, 120)
    m = language.train(docs)
    table = np.array(m["sums"]).reshape(-1, len(m["langs"]))
    for r in language.identified(docs, m).join(docs.drop("lang"), "doc_id").collect():
        grams = []
        for w in language.words(r.text):
            marked = f"<{w}>"
            grams += [marked] + [marked[i : i + k] for k in (2, 3, 4) for i in range(len(marked) - k + 1)]
        x = (sum(table[cases.crc(g) % language.BUCKETS] for g in grams) / len(grams) + np.array(m["bias"])) / m["temperature"]
        p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        assert r.lang_pred == m["langs"][int(p.argmax())] and abs(r.score - p.max()) < 1e-9


def test_language_learns_one_row_of_an_id(spark):
    texts = {"de": "der die das und nicht", "en": "the and of to not"}
    rows = [(1, texts["de"] + f" wort {k}", "de", "s") for k in range(3000)] + [(i, texts["en" if i % 2 else "de"] + f" {i}", "en" if i % 2 else "de", "s") for i in range(2, 200)]
    docs = spark.createDataFrame([*rows, (None, texts["en"], "en", "s")], "doc_id long, text string, lang string, source string")
    out = {(r.doc_id, r.lang_pred) for r in language.identified(docs, language.train(docs, 2000)).collect()}
    assert (1, "de") in out and (3, "en") in out and (None, "en") in out
