"""The native fuzzy ratio against the bit-parallel one in Python, and against the plain table."""

import random

from pyspark.sql import functions as F

from storyweft.functions import fuzzy


def table_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_length(spark):
    rng = random.Random(1)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    rows = [(text(n, s), text(m, s)) for s in ("ab", "abc d0", "abcdefghijklmnopqrstuvwxyz 0123456789") for n in (0, 1, 2, 61, 62, 63, 124, 125, 300) for m in (0, 1, 62, 63, 140, 300)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", fuzzy.common_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n == table_length(r.a, r.b) == fuzzy._common(r.a, r.b)


def test_ratio_of_ten_thousand_pairs(spark):
    rng = random.Random(2)
    words = ["quake", "storm", "court", "ruling", "minister", "talks", "budget", "2024", "vote", "strike", "rail", "port", "harbour", "flood", "north", "south"]
    title = lambda: " ".join(rng.choice(words)[: rng.choice([3, 20, 20])] for _ in range(rng.randrange(0, 14)))
    rows = [(k, *(title(), title())) for k in range(10_000)] + [(-1, None, "a b"), (-2, "", ""), (-3, "the", "of")]
    df = spark.createDataFrame(rows, "k int, a string, b string").repartition(4)
    out = df.select("k", "a", "b", fuzzy.token_set_ratio(F.col("a"), F.col("b")).alias("r"), fuzzy.tokens_norm(F.col("a")).alias("x"), fuzzy.tokens_norm(F.col("b")).alias("y"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert len(got) == 10_003
    for r in got:
        assert abs(r.r - fuzzy.token_set(r.x, r.y)) < 1e-9, (r.a, r.b)
    assert len({round(r.r) for r in got}) > 60
