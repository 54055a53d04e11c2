import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyweft.llm import chat, mixing, packing, topk

from . import cases

TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi </s>[INST] <|end|>\n"), (1, 2, "assistant", "a\\b\\\\<|turn|>user\nx<|end|>\n"), (1, 3, "user", None), (1, 4, "assistant", "<<SYS>>\\n \\"),
    (2, 0, "assistant", ""), (2, 0, "assistant", ""), (2, None, None, "first"), (3, 5, "od\nd\\n<|x", "é日本𝄞" * 400), (None, 1, "user", "no id"),
]
TURNS += [(4, i, "assistant" if i % 2 else "user", f"turn {i} " * 40) for i in range(40)]


def test_chat_reads_back(spark):
    df = spark.createDataFrame([(*t, 1, "c") for t in TURNS], "conv_id long, turn long, role string, text string, window int, t string")
    by = defaultdict(list)
    for c, k, role, text in TURNS:
        by[c].append((k is not None, k or 0, role or "", text or ""))
    for budget in (64, 256, 100000):
        windows = chat.chat_windows(df, budget=budget)
        got = {r.conv_id: r for r in chat.digests(chat.read_back(windows)).collect()}
        assert set(got) == set(by)
        for c, turns in by.items():
            turns.sort()
            lines = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
            loss = "".join(t for *_, r, t in turns if r == "assistant")
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha(lines), len(loss), sha(loss))
    rows = chat.chat_windows(df, budget=512).where("conv_id = 4").orderBy("window").collect()
    assert len(rows) > 3 and all(r.n_tokens <= 512 for r in rows) and all(r.n_repeated for r in rows[1:])
    assert all(r.text[s.start : s.start + s.length].startswith("turn") for r in rows for s in r.loss)
    assert chat.chat_windows(df, budget=32).where("conv_id = 1 AND window > 0 AND text LIKE '%be brief%'").count() > 0
    assert chat.digests(chat.read_back(chat.chat_windows(df.limit(0)))).count() == 0
    plan = chat.digests(chat.read_back(chat.chat_windows(df)))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def water(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while free and left > 1e-9:
        total = sum(w[s] for s in free)
        over = {s for s in free if target[s] + left * w[s] / total >= most * sizes[s]}
        if not over:
            for s in free:
                target[s] += left * w[s] / total
            break
        rest = left
        for s in over:
            rest -= most * sizes[s] - target[s]
            target[s] = most * sizes[s]
        free -= over
        left = rest if not free else share * sum(sizes.values()) - sum(target[s] for s in names if s not in free)
        for s in free:
            target[s] = 0.0
    return target


def test_mixing(spark):
    docs = cases.documents(spark)
    rows = mixing.mix(docs, block_words=100, shards=4).collect()
    assert len(rows) == docs.count()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(d.words for d in r.draws) and all(0 <= d.shard < 4 for d in r.draws)
    want = water(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    key = lambda rs: sorted(((r.doc_id, r.text_hash, r.taken, str(r.draws)) for r in rs), key=repr)
    assert key(rows) == key(mixing.mix(docs.repartition(3), block_words=100, shards=4).collect())
    mixed = mixing.mixed_documents(docs, block_words=100, shards=4)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split()) if r.text.isascii() else 1
    assert all(abs(words[s] - taken[s]) <= 0 for s in sizes)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_dealt_to_all_blocks(spark):
    rows = [(None, f"no id but text {k} " * 5) for k in range(300)] + [(7, "the same row " * 5)] * 300 + [(i, f"own {i} " * 10) for i in range(1000, 1100)]
    df = cases.documents(spark, rows).withColumn("source", F.lit("s"))
    numbered = mixing._numbered(df.select("doc_id", F.xxhash64("text").alias("text_hash")), 64)
    assert numbered.count() == len(rows) == numbered.distinct().count()
    out = mixing.mix(df, block_words=100).collect()
    size = sum(len(t.split()) for _, t in rows)
    assert len(out) == len(rows) and abs(sum(r.taken for r in out) - round(1.5 * size)) <= 1
    assert 60 < sum(r.taken > r.size for r in out if r.doc_id == 7) < 240  # the second pass takes about half of them
    again = mixing.mix(df.repartition(7), block_words=100).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_splitting_tree_is_exact_and_fair(spark):
    quotas = spark.createDataFrame([(1, 1000), (2, 500), (3, 0), (4, 3)], "sid int, units long")
    means = []
    for seed in range(3):
        ends = {r.sid: r.ends for r in mixing.split_quotas(quotas, 4, seed).collect()}
        assert {s: e[-1] for s, e in ends.items()} == {1: 1000, 2: 500, 3: 0, 4: 3}
        parts = {s: np.diff([0, *e]) for s, e in ends.items()}
        totals = sum(parts.values())
        assert max(totals) - min(totals) <= 2 and all((p >= 0).all() for p in parts.values())
        means.append(parts[1])
    assert not (means[0] == means[1]).all() and abs(np.mean(means) - 250) < 1 and np.std(means) < 40
    with pytest.raises(ValueError):
        mixing.split_quotas(quotas, 3)


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def test_packing(spark):
    docs = cases.documents(spark, [*cases.awkward(), (500, "İ ΣΑΣ <|endoftext|>a, b.! 's don't x³")])
    rows = packing.best_fit_packing(docs).collect()
    t, want = tokenizer(), Counter()
    for r in docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[(r.doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.best_fit_packing(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    hist = np.bincount(rng.integers(1, (65, 40, 20, 33)[seed], 3000), minlength=65)
    groups = packing.plan(hist)
    used = Counter()
    for lengths, n, _ in groups:
        assert sum(lengths) <= 64 and n > 0
        for v in lengths:
            used[v] += n
    assert used == Counter({v: int(c) for v, c in enumerate(hist) if c})
    assert sum(n for _, n, _ in groups) <= 1.03 * sum(v * c for v, c in enumerate(hist)) / 64 + 1


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], 1, i) for i in range(300)]
    rows += [(300 + i, [0.5] * 8, 1, i) for i in range(60)] + [(400, None, 1, 0), (450, [1.0] * 7 + [None], 1, 0), (500, [float("nan")] * 8, 1, 0), (550, [float("inf")] * 8, 1, 0), (600, [], 1, 0), (50, rows[3][1], 1, 0), (50, rows[3][1], 1, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score int")
    vectors = topk.integer_vectors(df)
    sound = [(r.vec_id, np.array(r.v, np.int64)) for r in vectors.collect()]
    dot = lambda a, b: int(sum(int(x) * int(y) for x, y in zip(a, b)))
    want = Counter()
    for k, (q, v) in enumerate(sound):
        if q % 50 == 0:
            others = sorted((-dot(v, u), w) for j, (w, u) in enumerate(sound) if j != k)
            want.update((q, rank + 1, w, -s) for rank, (s, w) in enumerate(others[:5]))
    assert sum(q == 50 for q, *_ in want.elements()) == 15  # three rows of one id, two of them the same
    for block in (7, 4096):
        got = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), block=block).collect()
        assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    few = vectors.where("vec_id IN (0, 1, 2)")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_phases_score_few_entries():
    rng = np.random.default_rng(3)
    m = rng.integers(-60, 60, (3000, 64))
    m[:, :16] *= 9  # lists that differ in weight
    q = m[:20]
    i, j = topk.leading_entries(q, m, 5, 4)
    assert len(i) <= 20 * 4 * 5
    exact = q @ m.T
    cut = np.array([np.sort(exact[a, j[i == a]])[-5] for a in range(20)])
    a, b = topk.sufficient_entries(q, m, cut, 4)
    best = {(r, c) for r in range(20) for c in np.argsort(-exact[r], kind="stable")[:5]}
    assert best <= set(zip(a.tolist(), b.tolist())) and len(a) < 20 * 3000 / 2


def test_exact_products_of_large_components():
    a = np.array([[1 << 30, 3], [-(1 << 31), 5]], np.int64)
    assert topk.products(a, a)[0, 0] == (1 << 60) + 9
    big = np.array([[1 << 40, 1]], np.int64)
    assert topk.products(big, np.array([[1 << 20, 7]], np.int64))[0, 0] == (1 << 60) + 7
