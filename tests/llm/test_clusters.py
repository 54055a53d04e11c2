import hashlib
import math
import random

import numpy as np
import pytest

from storyweft.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, `a.b` string"


def rows(rng, n=300, scale=1.0, width=64):
    out = []
    for i in range(n):
        base = i % 9
        out.append((i, [scale * (math.sin(base * k) + rng.gauss(0, 0.2)) for k in range(width)]))
    return out


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in vectors], SCHEMA)


def brute(vectors, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    find = lambda v: min((far(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [find(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                c = [*c[:j], [sum(x) // len(own) for x in zip(*own)], *c[j + 1 :]]
    found = [(i, *find(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    return sorted([(i, j, d, sum(x for _, x, y in found if y == j), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found], key=repr)


def got(spark, vectors, **options):
    return sorted([tuple(r) for r in clusters.centroid_clusters(clusters.whole_vectors(frame(spark, vectors)), **options).collect()], key=repr)


def test_clusters_of_awkward_vectors(spark):
    vectors = rows(random.Random(1))
    same = vectors[5][1]
    vectors += [(None, same), (None, [-x for x in same]), (7, same), (7, same), (900, None), (901, same[:63]), (902, [*same, 0.0]), (903, [None, *same[1:]]), (904, [float("nan"), *same[1:]]), (905, [float("inf"), *same[1:]]), (906, [0.0] * 64), (907, [0.0] * 64)]
    assert got(spark, vectors, block=50) == got(spark, vectors) == brute(vectors)
    few = vectors[:5]
    assert got(spark, few) == brute(few) and len({r[1] for r in brute(few)}) == 5
    assert got(spark, []) == [] == got(spark, [(900, None)])


@pytest.mark.parametrize("scale", [1e4, 3e5])
def test_large_components_stay_exact(spark, scale):
    vectors = rows(random.Random(2), 60, scale)
    assert got(spark, vectors) == brute(vectors)


def test_beyond_64_bits():
    rng = np.random.default_rng(0)
    for most in (1 << 20, 1 << 26, 1 << 40):
        x, c = rng.integers(-most, most, (20, 64)), rng.integers(-most, most, (4, 64)).astype(object)
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s)) for s in c] for r in x]
        assert [[int(d) for d in r] for r in clusters.distances(x, c)] == want
    zero = np.zeros((1, 2), object), np.zeros(1, object), np.zeros(1, object)
    big = np.full((8, 2), 1 << 60)
    sums, counts, _ = clusters.add_block(zero, big, np.zeros((1, 2), object))
    assert sums.tolist() == [[8 << 60, 8 << 60]] and counts.tolist() == [8]


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        got(spark, [(1, [1e30] * 64)])
