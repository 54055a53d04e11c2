import hashlib
import random
import zlib

import numpy as np

from storyweft.llm import runs

from . import cases


def brute(w):
    """Every maximal run, from every period and place."""
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng, n):
    w, letters = [], rng.choice([1, 2, 3, 50])
    while len(w) < n:
        unit = [rng.randrange(letters) for _ in range(rng.randint(1, 12))]
        w += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
        if rng.random() < 0.5:  # an earlier stretch once more, for runs inside a block
            k = rng.randrange(len(w))
            w += w[k : k + rng.randint(1, 80)]
    return w[:n]


def test_all_runs_are_found():
    rng, seen = random.Random(5), 0
    for _ in range(150):
        docs = [repetitive(rng, rng.choice([0, 1, 23, 24, 60, 200])) if rng.random() < 0.8 else [rng.randrange(3) for _ in range(100)] for _ in range(5)]
        got = runs.all_runs(np.array([x for d in docs for x in d], np.int64), [len(d) for d in docs])
        for d, g in zip(docs, got, strict=True):
            assert g == brute(d)
            seen += len(g)
    assert seen > 300


def test_previous_factors_and_blocks():
    rng = random.Random(6)
    for _ in range(60):
        w = repetitive(rng, 40)
        levels = runs.factor_ranks(np.array(w), np.zeros(40, np.int64))
        order = np.argsort(levels[-1])
        assert [w[i:] + [99] for i in order] == sorted(w[i:] + [99] for i in range(40))  # an end is larger than any word
        lcp = [0, *runs.extended(levels, order[:-1], order[1:]).tolist()]
        length, source = runs.previous_factors(order.tolist(), lcp)
        same = lambda i, j: next((k for k in range(40) if max(i, j) + k >= 40 or w[i + k] != w[j + k]), 40)
        assert length == [max((same(i, j) for j in range(i)), default=0) for i in range(40)]
        assert all(n == 0 or (0 <= j < i and same(i, j) == n) for i, (n, j) in enumerate(zip(length, source)))
        blocks = runs.lz_blocks(length, source)
        assert [b[0] for b in blocks[1:]] + [40] == [b[1] for b in blocks]


def expected(doc_id, text, plant):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, n, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join("%d,%d,%d\n" % r for r in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_documents_with_awkward_cases(spark):
    rows = [(i, t if t is None or len(t) < 30000 else " ".join(t.split()[:1500])) for i, t in cases.awkward()]
    rows += [(400, "ab " * 200), (401, "x y\tz\x0b" * 9 + "end"), (402, "a b c " * 30), (403, ("line one\nline two\n" * 7) + "line three"), (404, "tick " * 23), (405, "tick " * 24)]
    rows += [(500 + k, cases.prose(random.Random(k), 300)) for k in range(60)]
    df = cases.documents(spark, rows)
    for plant in (True, False):
        got = [tuple(r) for r in runs.periodic_runs(df, runs.planted if plant else None).collect()]
        assert sorted(got, key=repr) == sorted((expected(i, t, plant) for i, t in rows), key=repr)
    assert sum(r[2] > 0 for r in got) >= 4
    assert runs.periodic_runs(df.limit(0)).count() == 0
    long = runs.periodic_runs(spark.createDataFrame([(1, "la la li " * 40000)], "doc_id long, text string"), None).first()
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 120000, 3, 40000000)
