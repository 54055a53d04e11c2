"""Best-fit packing of token pieces by length patterns fitted with non-negative least squares.

Lengths are counted in a histogram of at most `capacity` bins, which is all that the driver sees.  All patterns of one to
three lengths that fill a sequence exactly are enumerated (their number is bounded by the capacity); their repeat counts
are fitted to the histogram by multiplicative updates, which keep them non-negative; the counts are rounded and taken in
order of size while the histogram lasts; what is left is packed by best fit decreasing on the histogram.  The roundings
in `ROUNDINGS` are tried, one of which uses no pattern, and the plan with the fewest sequences is used.  The plan is a
list of runs, bounded by the number of patterns and bins, not by the data; every piece finds its sequence through its
rank among the pieces of its length, which is counted in parts.  Of n pieces of a length there are some sqrt(n) / 4 parts,
so that neither the pieces of a part nor the parts of a common length are many in one task.

Defined cases: a null or empty text is the closing token alone; a null doc_id is kept; a very long text is cut into
pieces of `capacity` tokens; ties of rank go by doc_id, piece and checksum; repeated rows are pieces of their own; an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from storyweft.llm.common import saved, shared_dir, short_batches, table

TOKENIZER, CAPACITY = "word_bpe_49k.json", 2048
#: Words that a worker remembers, and bytes of text that it splits at once.
CACHE, PORTION = 300_000, 2 << 20
#: ASCII marks that never join with letters; without the apostrophe and the signs of special tokens.
MARKS = ",.;:!?$%&*#()\"-"
#: Letters that are their own normal form and whose lower case is one letter.
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and c not in "ªµº")
#: The least fitted count of a pattern that is rounded up and used; with infinity there is none.
ROUNDINGS = (0.2, 0.5, 1.0, float("inf"))
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of texts, as one array with the bounds of each text.

    No token of the vocabulary crosses an ASCII blank, so texts are split there, and a batch's different words are
    looked up or encoded once; the ids of a text are then gathered.  New words of Latin letters (perhaps with final
    MARKS, which are a word of their own) need no normaliser but lower case and are encoded together: each gives one run
    of tokens up to an end-of-word token.  If the runs are not as many as the words, and for any other word, the whole
    tokenizer is asked word by word.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers as pre

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.ByteLevel(add_prefix_space=False, use_regex=False, trim_offsets=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.last[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.at, self.n = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, words: pa.StringArray, ids: np.ndarray, n: np.ndarray) -> None:
        self.at = np.append(self.at, len(self.ids) + np.cumsum(n) - n)
        self.n, self.ids = np.append(self.n, n), np.append(self.ids, ids)
        self.known = pa.concat_arrays([self.known, words])

    def _each(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64)

    def _together(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py()
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.nonzero(self.last[ids])[0] + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) and ends[-1] == len(ids) else self._each(words)

    def _slots(self, words: pa.StringArray, learn: bool = False) -> np.ndarray:
        """Where words are known; those that are not are learned first, or have -1."""
        slot = pc.fill_null(pc.index_in(words, self.known), -1).to_numpy().astype(np.int64)
        if learn and len(new := np.nonzero(slot < 0)[0]):
            slot[new] = len(self.known) + np.arange(len(new))
            self._learn(words.take(pa.array(new)))
        return slot

    def _learn(self, new: pa.StringArray) -> None:
        """Adds new words in their order."""
        stems, tails = pc.utf8_lower(pc.utf8_rtrim(new, MARKS)), pc.utf8_ltrim(new, LETTERS)
        plain = pc.and_(pc.match_substring_regex(stems, f"^[{LETTERS}]+$"), pc.equal(pc.add(pc.utf8_length(stems), pc.utf8_length(tails)), pc.utf8_length(new)))
        stems, tails, odd = stems.filter(plain).dictionary_encode(), tails.filter(plain).dictionary_encode(), new.filter(pc.invert(plain))
        other = Encoder.__new__(Encoder)  # parts that are no words of the text themselves are kept for this call only
        other.__dict__ |= self.__dict__
        is_new = other._slots(stems.dictionary) < 0
        fresh = stems.dictionary.filter(pa.array(is_new))
        for k in range(0, len(fresh), 20_000):
            other._add(fresh.slice(k, 20_000), *other._together(fresh.slice(k, 20_000)))
        rest = pa.concat_arrays([tails.dictionary, odd])
        first = len(other.known)
        other._add(rest, *other._each(rest))
        plain = plain.to_numpy(zero_copy_only=False)
        parts = np.zeros((len(new), 2), np.int64)  # a word is a stem and a tail, or an odd word alone
        parts[plain, 0], parts[plain, 1] = other._slots(stems.dictionary)[stems.indices.to_numpy()], first + tails.indices.to_numpy()
        parts[~plain, 0] = first + len(tails.dictionary) + np.arange(len(odd))
        n = other.n[parts]
        n[~plain, 1] = 0
        self._add(new, gathered(other.ids, other.at[parts].ravel(), n.ravel()), n.sum(1))

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of text k are ids[bounds[k] : bounds[k + 1]]."""
        words = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        if len(self.known) > CACHE:
            self._forget()
        slot = self._slots(coded.dictionary, True)[coded.indices.to_numpy()]
        n = self.n[slot]
        ends = np.concatenate([[0], np.cumsum(n)])
        return gathered(self.ids, self.at[slot], n), ends[np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])]


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs values[start : start + size], one after another."""
    return values[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


def _portions(texts: pa.StringArray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about PORTION bytes of text (a longer text alone)."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < len(size):
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + PORTION, "right")))
        yield at, end
        at = end


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text) -> its pieces: doc_id, piece, start, length, ids_crc32; tokenizer is a path or the name of a public file."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        encode = Encoder(path)
        for b in batches:
            doc, texts = b.column("doc_id").to_pylist(), b.column("text")
            for lo, hi in _portions(texts):
                ids, bounds = encode(texts.slice(lo, hi - lo))
                rows = []
                for k in range(hi - lo):
                    raw = ids[bounds[k] : bounds[k + 1]].tobytes() + b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        rows.append((doc[lo + k], piece, at // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def patterns(hist: np.ndarray) -> np.ndarray:
    """Rows (a, b, c) of lengths in hist with a <= b <= c and a + b + c = capacity, where 0 stands for no document."""
    capacity = len(hist) - 1
    there = hist > 0
    there[0] = True
    found = []
    for a in np.nonzero(there)[0]:
        if 3 * a > capacity:
            break
        b = np.arange(a, (capacity - a) // 2 + 1)
        b = b[there[b] & there[capacity - a - b]]
        found.append(np.stack([np.full(len(b), a), b, capacity - a - b], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def fit_counts(rows: np.ndarray, hist: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Non-negative repeat counts of the patterns that minimise the squared error to hist, by multiplicative updates."""
    want, size = hist.astype(float), len(hist)
    want[0] = 0
    used = rows > 0
    def fold(x):  # how often the patterns use each length
        return sum(np.bincount(rows[:, k], x * used[:, k], size) for k in range(3))

    def pull(y):
        return sum(y[rows[:, k]] * used[:, k] for k in range(3))

    x = np.full(len(rows), want.sum() / max(1, len(rows)) / 2)
    top = pull(want)
    for _ in range(rounds):
        x *= top / np.maximum(pull(fold(x)), 1e-12)
    return x


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int, bool]]:
    """Groups (lengths, repeats, fitted) that use up hist[length], each within the capacity len(hist) - 1.

    Of the plans with rounded patterns and the one without any, the first with the fewest sequences.
    """
    rows = patterns(hist)
    x = fit_counts(rows, hist)
    order = np.argsort(-x, kind="stable")
    best: list[tuple[tuple[int, ...], int, bool]] | None = None
    for least in ROUNDINGS:
        left, groups = hist.astype(np.int64).tolist(), []
        for k in order[x[order] >= least]:
            lengths = tuple(v for v in rows[k].tolist() if v)
            n = min(max(1, int(x[k] + 0.5)), *(left[v] // lengths.count(v) for v in lengths))
            if n > 0:
                groups.append((lengths, n, True))
                for v in lengths:
                    left[v] -= n
        groups += [(g, n, False) for g, n in best_fit(np.array(left, np.int64))]
        if best is None or sum(g[1] for g in groups) < sum(g[1] for g in best):
            best = groups
    return best or []


def best_fit(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram; groups of equally filled sequences move together."""
    capacity = len(hist) - 1
    free: list[list[list]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        n, room = int(hist[length]), length
        while n and room < capacity:
            while n and free[room]:
                lengths, count = free[room][-1]
                take = min(n, count)
                free[room][-1][1] -= take
                if take == count:
                    free[room].pop()
                free[room - length].append([(*lengths, length), take])
                n -= take
            room += 1
        while n:  # a new sequence takes one; those that can take several of this length do so at once
            per = min(n, capacity // length)
            take = n // per
            free[capacity - per * length].append([(length,) * per, take])
            n -= per * take
    return [(tuple(g), n) for groups in free for g, n in groups]


def runs_of(groups: list[tuple[tuple[int, ...], int, bool]]) -> dict[str, np.ndarray]:
    """For each length, in order of rank: from which rank on which sequences hold it, and where."""
    rows, base = [], 0
    for lengths, n, fitted in groups:
        at = 0
        for length in lengths:
            rows.append((length, n, base, at, fitted))
            at += length
        base += n
    a = np.array(rows, np.int64).reshape(-1, 5)
    a = a[np.argsort(a[:, 0], kind="stable")]
    ends = np.cumsum(a[:, 1])
    first = np.searchsorted(a[:, 0], a[:, 0], "left")
    starts = ends - a[:, 1]
    rank = starts - starts[first] if len(a) else a[:, 0]
    return {"key": a[:, 0] << 44 | rank, "rank": rank, "sequence": a[:, 2], "offset": a[:, 3], "fitted": a[:, 4] == 1}


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with doc_id, piece and length) and for each the sequence_id, the offset and whether a fitted pattern placed it."""
    spark = pieces.sparkSession
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most capacity rows
        hist[r["length"]] = r["n"]
    sent = spark.sparkContext.broadcast(runs_of(plan(hist)))
    salts = spark.createDataFrame([(k, math.ceil(math.sqrt(n) / 4)) for k, n in enumerate(hist.tolist()) if n], "length long, salts int")
    names = pieces.columns
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts")).cast("int"))
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    parts = parts.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(parts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = sent.value
        for b in batches:
            rank, length = b.column("rank").to_numpy(), b.column("length").to_numpy()
            k = np.searchsorted(runs["key"], length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(runs["sequence"][k] + rank - runs["rank"][k]), pa.array(runs["offset"][k]), pa.array(runs["fitted"][k])], [*names, "sequence_id", "offset", "fitted"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.select(*names).dtypes)
    return ranked.select(*names, "rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long, fitted boolean")


def best_fit_packing(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    with short_batches(docs.sparkSession):
        pieces = saved(token_pieces(docs, tokenizer, capacity), shared_dir(docs.sparkSession))
    return packed(pieces, capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
