"""Small documents with the awkward cases, and brute-force versions of the operators."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long, value int, text_hash string, `a.b` string"


def documents(spark, rows=None):
    """doc_id and text of rows, with a null source here and there, and columns whose names clash with the operators' own."""
    rows = awkward() if rows is None else rows
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), k, "x", "y") for k, (i, t) in enumerate(rows)], DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}{'xyz'[rng.randrange(3)]}" for _ in range(n))


def awkward(seed=0, n=40):
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows = []
    for i in range(n):
        t = prose(rng, rng.randrange(1, 120))
        if i % 4 == 0:
            t = f"{t}\n{passage}\n{prose(rng, 5)}"
        rows.append((i, t))
    base = rows[7][1] + " " + prose(rng, 200)
    for k in range(12):  # near copies
        w = base.split(" ")
        w[rng.randrange(len(w))] = f"edit{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, base) for k in range(5)]  # exact copies
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "one two three"), (304, "ONE two  three"), (305, "é" * 30 + "日本" * 20), (306, "é" * 30 + "日本" * 20 + "x"), (307, prose(rng, 30000, 5000)), (308, "a" * 5000), (309, "a" * 4000 + "b")]
    rows += [(310, "same row twice " * 8), (310, "same row twice " * 8), (311, "same id"), (311, "other text of the same id"), (None, "no id at all, but a text of some length that is over fifty bytes"), (None, None)]
    return rows


def removed(rows, least=50):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, sha256)}"""
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - least + 1):
            w = b[s : s + least]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - least + 1):
            if first[b[s : s + least]] < key(i):
                gone[s : s + least] = b"\1" * least
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def components(rows, percent=75, width=5, by_id=True):
    keys = [(1 << 62) + k if i is None else i for k, (i, _) in enumerate(rows)]
    if not by_id:
        keys = list(range(len(rows)))
    sets, parent = [], {}
    for key, (_, t) in zip(keys, rows):
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
        parent[key] = key

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            lists[x].append(k)
    for k, s in enumerate(sets):
        shared = Counter(j for x in s for j in lists[x] if j < k)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(keys[k]), find(keys[j])
                parent[max(a, b)] = min(a, b)
    if not by_id:
        return [find(k) for k in keys], sets
    shown = lambda x: None if x >= 1 << 62 else x
    return sorted([(i, len(s), shown(find(k))) for k, (i, _), s in zip(keys, rows, sets)], key=repr)


def one_of_each(rows):
    """How often each doc_id stays: the smallest of each group of texts, and every row without a word."""
    place, sets = components(rows, by_id=False)
    first = {}
    for (i, t), c, s in zip(rows, place, sets):
        if s:
            first[c] = min(first.get(c, 1 << 62), 1 << 62 if i is None else i)
    return Counter([None if i >= 1 << 62 else i for i in first.values()] + [i for (i, _), s in zip(rows, sets) if not s])


def crc(text):
    return zlib.crc32(text.encode())
