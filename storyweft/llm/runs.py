"""Periodic runs in sequences of words: suffix array, LCP, longest previous factors, LZ blocks, Main's extensions, copying.

A run is a maximal stretch of words with smallest period q that is at least max(24, 3q) words long.  All of it happens
document by document inside tasks, so nothing is shuffled; a batch's documents are worked on together in whole arrays.

1. Words get numbers, and every sixteen consecutive words a hash.  A run of L words has sixteen words or more that recur q
   words later (L - q >= max(24 - q, 2q) >= 16), so a document without a recurring hash has no run and is done.
2. For the other documents, prefix doubling gives the rank of every factor of 1, 2, 4, ... words.  The last ranks are the
   suffix array; LCPs, and extensions to the left and right of any two places, are read from the levels, largest first.
3. The suffix array and its LCPs give, with a stack, the longest previous factor of each place and where it occurs
   before; going from one longest previous factor to the next cuts the document into LZ blocks.
4. A run that crosses or touches a boundary of blocks has its period at most as long as the block before or after it
   (else a longer previous factor had made the block longer).  So for every boundary x, all periods p up to those lengths
   are tried: (x, x + p) and (x - p, x) are extended both ways.  These are at most 2n trials for n words.
5. A run strictly inside a block is a copy of one inside the block's previous occurrence, with the same breaks at its
   ends.  Runs lie in buckets by start, and a block's are copied from its source in order of start, new ones included.
6. Of several periods of the same stretch the smallest is its period.

Defined cases: a null or empty text has no words, no runs, four nulls, and the digests of empty strings; a null doc_id is
kept (and plants nothing in op12); very long texts are worked on whole; ties of the greatest exponent go to the smaller
start, then the smaller period; repeated rows are treated alike; an empty table gives no rows; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from storyweft.llm.common import table
from storyweft.llm.packing import _portions as portions

#: The shortest run, the least number of periods in one, and the words that recur in any run (see 1).
LEAST, TIMES, RECURRING = 24, 3, 16
FOUND = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
Run = tuple[int, int, int]


def recurs(words: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """By document, whether some RECURRING words in a row may stand in it twice (certainly not where it says no)."""
    h, k = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    h ^= h >> np.uint64(29)
    while k < RECURRING:
        h = h[:-k] * np.uint64(0xBF58476D1CE4E5B9) + h[k:] if len(h) > k else h[:0]
        h ^= h >> np.uint64(31)
        k *= 2
    whole = doc[: len(h)] == doc[len(doc) - len(h) :]
    h, own = h[whole] + doc[: len(h)][whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), doc[: len(h)][whole]
    order = np.argsort(h)
    h, own = h[order], own[order]
    out = np.zeros(n_docs, bool)
    out[own[1:][(h[1:] == h[:-1]) & (own[1:] == own[:-1])]] = True
    return out


def factor_ranks(words: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Level k: the rank of the 2**k words from each place on; places of different documents never have equal ranks.

    A factor that crosses the end of its document goes on in the next one, whose words are others, so it matches none.
    The last level has a rank for each place: it is the inverse suffix array.
    """
    n = len(words)
    levels = [np.unique(doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words, return_inverse=True)[1].astype(np.int64)]
    k = 1
    while levels[-1].max(initial=-1) + 1 < n:
        rank = levels[-1]
        after = np.full(n, n, np.int64)  # the end of all is larger than any word
        after[: max(0, n - k)] = rank[k:]
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        levels.append(new)
        k *= 2
    return levels


def extended(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, left: bool = False) -> np.ndarray:
    """How many words from i and j on (with left: before i and j) are the same; i and j differ."""
    n, out = len(levels[0]), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        a, b = (i - out - step, j - out - step) if left else (i + out, j + out)
        sound = np.minimum(a, b) >= 0 if left else np.maximum(a, b) < n
        same = sound & (levels[k][np.where(sound, a, 0)] == levels[k][np.where(sound, b, 0)])
        out += np.where(same, step, 0)
    return out


def previous_factors(suffixes: list[int], lcp: list[int]) -> tuple[list[int], list[int]]:
    """For each place of one document, the length of the longest factor that also starts before it, and the place of that start.

    suffixes are its places in order, lcp[r] what suffixes r - 1 and r share.  A place's longest previous factor is with
    the nearest smaller place on either side in the order; the stack holds places that wait for one on their right.
    """
    n = len(suffixes)
    length, source = [0] * n, [-1] * n
    stack: list[tuple[int, int]] = []  # (place, what it shares with the one below it)
    for r in range(n + 1):
        here, shared = (suffixes[r], lcp[r]) if r < n else (-1, 0)
        while stack and stack[-1][0] > here:
            place, below = stack.pop()
            if shared >= below:
                length[place], source[place] = shared, here if shared else -1
            else:
                length[place], source[place] = below, stack[-1][0]
            shared = min(shared, below)
        stack.append((here, shared if stack else 0))
    return length, source


def lz_blocks(length: list[int], source: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, start of the previous occurrence or -1) of the blocks of one document."""
    at, out = 0, []
    while at < len(length):
        end = at + max(1, length[at])
        out.append((at, end, source[at] if length[at] else -1))
        at = end
    return out


def touching(blocks: list[tuple[int, int, int]], base: int, levels: list[np.ndarray]) -> list[Run]:
    """(start, length, period) of the runs that cross or touch a boundary of blocks, the end of the document included."""
    first, end = (np.array(c) for c in list(zip(*blocks, strict=True))[:2])
    n, sizes = int(end[-1]), end - first
    p = np.arange(n) - np.repeat(first, sizes) + 1  # 1 to the size of each block
    # a boundary's periods up to the block after it, to the right; then those up to the block before it, to the left
    i, p = np.concatenate([np.repeat(first, sizes), np.repeat(end, sizes) - p]), np.concatenate([p, p])
    sound = i + p <= n
    i, p = i[sound] + base, p[sound]
    ahead, back = np.where(i + p < base + n, extended(levels, i, np.minimum(i + p, len(levels[0]) - 1)), 0), extended(levels, i, i + p, True)
    start, size = i - back - base, p + ahead + back
    good = size >= np.maximum(LEAST, TIMES * p)
    return list(zip(start[good].tolist(), size[good].tolist(), p[good].tolist(), strict=True))


def runs_of(blocks: list[tuple[int, int, int]], found: list[Run]) -> list[Run]:
    """All runs: the ones found at boundaries and their copies inside blocks, each with its smallest period, by start and period."""
    period: dict[tuple[int, int], int] = {}
    for start, size, p in found:
        period[start, size] = min(p, period.get((start, size), p))
    starts = sorted({s for s, _ in period})
    bucket: dict[int, list[int]] = {}
    for s, size in period:
        bucket.setdefault(s, []).append(size)
    for at, end, source in blocks:
        if source < 0 or end - at < LEAST + 2:
            continue
        k = bisect.bisect_right(starts, source)
        while k < len(starts) and starts[k] < source + end - at:
            s = starts[k]
            for size in bucket[s]:
                new = s + at - source
                if s + size < source + end - at and (new, size) not in period:
                    period[new, size] = period[s, size]
                    if new not in bucket:
                        bucket[new] = []
                        bisect.insort(starts, new)
                    bucket[new].append(size)
            k += 1
    return sorted(((s, size, p) for (s, size), p in period.items()), key=lambda r: (r[0], r[2]))


def all_runs(words: np.ndarray, sizes: list[int]) -> list[list[Run]]:
    """The runs of each of some documents, whose numbered words stand one after another; `sizes` words each."""
    n_docs = len(sizes)
    doc = np.repeat(np.arange(n_docs), sizes)
    out: list[list[Run]] = [[] for _ in sizes]
    open_ = recurs(words, doc, n_docs)
    if not open_.any():
        return out
    kept = open_[doc]
    words, doc = words[kept], doc[kept]
    levels = factor_ranks(words, doc)
    suffixes = np.empty(len(words), np.int64)
    suffixes[levels[-1]] = np.arange(len(words))  # documents are apart, and in order
    lcp = np.concatenate([[0], extended(levels, suffixes[:-1], suffixes[1:])])
    base = 0
    for d in np.nonzero(open_)[0].tolist():
        n = sizes[d]
        own = slice(base, base + n)
        blocks = lz_blocks(*previous_factors((suffixes[own] - base).tolist(), [0, *lcp[base + 1 : base + n].tolist()]))
        out[d] = runs_of(blocks, touching(blocks, base, levels))
        base += n
    return out


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each of n places in the contract's variant of the text."""
    i = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return i
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(i < a, i, a + (i - a) % p)


def _report(doc_id: int | None, n: int, text: memoryview, runs: list[Run]) -> tuple:
    best: tuple[int | None, ...] = (None,) * 4
    if runs:
        top = runs[0]
        for r in runs[1:]:  # in order of start and period, so a tie keeps the one before
            if r[1] * top[2] > top[1] * r[2]:
                top = r
        best = *top, 1000 * top[1] // top[2]
    listed = "".join(f"{s},{size},{p}\n" for s, size, p in runs).encode()
    return (doc_id, n, len(runs), *best, hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest())


def collapsed(words: pa.Array, offsets: np.ndarray, runs: list[list[Run]]) -> pa.Array:
    """By document, its words but those that a run repeats, joined by one space."""
    keep = np.ones(len(words), bool)
    for at, own in zip(offsets, runs, strict=False):
        for start, size, period in own:
            keep[at + start + period : at + start + size] = False
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(keep))), b" ")


def _split(texts: pa.Array) -> pa.ListArray:
    """The words of each text as bytes."""
    words = [t.split() if t else [] for t in texts.cast(pa.binary()).to_pylist()]  # for bytes, white space is 20 and 09 to 0D
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([x for w in words for x in w], pa.binary()))


def periodic_runs(docs: DataFrame, variant: Callable[[int | None, int], np.ndarray] | None = None) -> DataFrame:
    """docs(doc_id, text) -> the columns FOUND: number of runs, the run with the greatest exponent, digests of all runs and of the text without repeats.

    variant(doc_id, n), if given, says which word of the text stands at each of its n places.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for lo, hi in portions(texts):
                words = _split(texts.slice(lo, hi - lo))
                flat, offsets = words.flatten(), words.offsets.to_numpy().astype(np.int64)
                sizes = np.diff(offsets)
                if variant:
                    flat = flat.take(pa.array(np.concatenate([np.zeros(0, np.int64), *(at + variant(i, int(n)) for i, at, n in zip(ids[lo:hi], offsets, sizes, strict=False))])))
                numbered = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
                runs = all_runs(numbered, sizes.tolist())
                texts_left = collapsed(flat, offsets, runs)
                rows = [_report(i, n, memoryview(t.as_buffer()), r) for i, n, t, r in zip(ids[lo:hi], sizes.tolist(), texts_left, runs, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, FOUND)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), planted)


#: Checksum of a decimal id by its bits: a step for each character, then one for each of its bits.
_CRC = "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_prepend(CAST(1000 + ascii(c) AS UBIGINT), list_transform(range(8), lambda b: 0::UBIGINT))))), lambda s, x: CASE WHEN x > 0 THEN xor(s, x - 1000) ELSE xor(s >> 1, (s & 1) * 3988292384::UBIGINT) END))"
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, CAST({_CRC} AS BIGINT) AS h FROM documents),
e AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
w AS (SELECT doc_id, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS x, n FROM f, unnest(range(0, n)) AS t(i)),
m AS (SELECT a.doc_id, b.i - a.i AS q, a.i, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS g FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM m GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
b AS (SELECT doc_id, count(*) AS n_runs, first(struct_pack(start := start, length := length, period := period) ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS top, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, i FROM r, unnest(range(start + period, start + length)) AS t(i)),
k AS (SELECT w.doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM w ANTI JOIN x ON x.doc_id = w.doc_id AND x.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period, 1000 * top.length // top.period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""
