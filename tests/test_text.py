"""Golden rows of the text functions."""

import pytest
from pyspark.sql import functions as F

from storyweft.functions import fuzzy, text as tx

PAIRS = [
    ("Five killed after strong quake in Japan", "Japan earthquake leaves several dead", 0.1, 0.111111, 0.090909, 0.111111, 51.6129),
    ("Trump says tariffs will start next week", "Tariffs to begin next week, Trump says", 0.625, 0.625, 0.555556, 0.625, 89.6552),
    ("Live: Floods hit northern England as rain continues", "Flooding in northern England after heavy rain", 0.3, 0.571429, 0.25, 0.375, 90.0),
    ("", "", 0.0, 1.0, 1.0, 1.0, 0.0),
]


def test_jaccard_and_fuzzy(spark):
    df = spark.createDataFrame([p[:2] for p in PAIRS], "a string, b string")
    j = lambda f, e=1.0: F.round(tx.jaccard(f(F.col("a")), f(F.col("b")), e), 6)
    rows = df.select("a", j(tx.tokens_simple, 0.0), j(tx.tokens_norm), j(tx.tokens_word), j(tx.tokens_eval), F.round(fuzzy.token_set_ratio(F.col("a"), F.col("b")), 4)).collect()
    want = {p[0]: p[2:] for p in PAIRS}
    for r in rows:
        assert tuple(r)[1:] == pytest.approx(want[r[0]], abs=1e-4)


def test_stemming_after_stop_words(spark):
    df = spark.createDataFrame([("Japan earthquake leaves several dead",), (None,)], "a string")
    assert [list(r[0]) for r in df.select(tx.tokens_norm(F.col("a"))).collect()] == [["japan", "earthquake", "leav", "several", "dead"], []]


def test_conflicts(spark):
    rows = [("Minister denies budget deal", "Minister confirms budget deal", True), ("No budget deal reached", "Minister says budget deal reached", False), ("Storm hits coast", "Storm damages coast", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", tx.conflicting_titles(F.col("a"), F.col("b"))).collect())


TYPES = [
    ("Any", "", "https://x.test/Opinion/1", "COMMENTARY", "URL_OPINION"),
    ("Opinion: a", "", "https://x.test/analysis/1", "INTERPRETATION", "URL_ANALYSIS"),
    ("Our view : tax", "", "https://x.test/n/1", "COMMENTARY", "TITLE_PREFIX_OPINION"),
    ("What we know: quake", "", "https://x.test/n/1", "INTERPRETATION", "TITLE_PREFIX_ANALYSIS"),
    ("Tax plan", "We believe they must act", "https://x.test/n/1", "COMMENTARY", "TEXT_COMMENTARY_STRONG"),
    ("Tax plan", "They must act, they should act", "https://x.test/n/1", "FACT", "DEFAULT_FACT"),
    ("Tax plan", "This signals a risk", "https://x.test/n/1", "INTERPRETATION", "TEXT_INTERPRET_STRONG"),
    ("Tax plan", "risk risk risk", "https://x.test/n/1", "FACT", "DEFAULT_FACT"),
    (None, None, None, "FACT", "DEFAULT_FACT"),
]


def test_article_types(spark):
    df = spark.createDataFrame(TYPES, "title string, summary string, url string, type string, reason string")
    for r in df.select("type", "reason", tx.article_type(F.col("title"), F.col("summary"), F.col("url")).alias("t")).collect():
        assert (r.t.type, r.t.reason) == (r.type, r.reason)


def test_effective_types(spark):
    df = spark.createDataFrame([(None,), ("DEFAULT_FACT",), (" explainer ",), ("COMMENT",)], "t string")
    got = [tuple(r) for r in df.select(*[tx.effective_type(F.col("t"), m) for m in ("list", "matrix", "gap")]).collect()]
    assert got[0] == ("UNKNOWN", "FACT", "FACT") and got[1] == ("UNKNOWN", "FACT", "FACT")
    assert got[2][0] == "INTERPRETATION" and got[3] == ("COMMENTARY", "COMMENTARY", "COMMENT")


def test_fnv_and_names(spark):
    df = spark.createDataFrame([("a",), ("BBC News",)], "t string")
    rows = df.select(tx.fnv1a(F.col("t")), tx.source_name_zh(F.col("t"), {"x": "y"})).collect()
    assert rows[0][0] == 0xE40C292C and rows[1][1] == "BBC新闻"


def test_native_functions_have_no_python(spark):
    df = spark.createDataFrame([("a b",)], "t string").select(tx.tokens_norm(F.col("t")), tx.article_type(F.col("t"), F.col("t"), F.col("t")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
