"""Token-id files with keyed access: raw id payloads in shards, and a minimal perfect hash index over the document keys.

Documents are dealt by doc_id (then a hash of the text) to shards of about `shard_bytes` of text, in order; each shard is
encoded by one task and becomes one binary file, which Spark's own writer commits, so that a lost executor's file is
written again and half a file is never seen.  A shard file is

    ids      of its documents in ascending order, each closed by id 0; 2 bytes each, or 4 if an id needs them
    counts   of ids by document, 4 bytes each
    keys     doc_ids, 8 bytes each; the first `nulls` of them stand for null
    footer   bytes of an id, shard, nulls, documents, ids
    magic    SWTOKEN1

all little-endian.  The index has a row for every bucket of about `bucket_keys` keys: a minimal perfect hash that maps
each key to a slot, and by slot a stored fingerprint, the shard, the offset in it and the number of ids.  A key is found
in constant time, whatever the corpus holds: hash it to its bucket, to its slot, compare the fingerprint, read the slice.
A key that is not there fails at its fingerprint, but for one in 2**32.

The perfect hash has levels of bits: keys that are alone at their place of a level set its bit and stay, the others go on
to the next level, which has another hash; a key's slot is the number of bits before its own.  Keys whose 64-bit hashes
are equal could never part; they are listed after the slots and compared as they are.

Defined cases: a null or empty text is the end id alone; very long texts are encoded whole; a key is a doc_id with the
number (from 0) of the row among rows of that id, which are in order of a hash of their text, so repeated rows and ties
have keys of their own; null doc_ids come first and are keys like others; an empty table gives no rows; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from storyweft.llm.common import saved, shared_dir, short_batches, table
from storyweft.llm.packing import gathered

TOKENIZER, END, MAGIC = "byte_bpe_50k.json", 0, "SWTOKEN1"
FOOTER = "<IIQQQ"
ROWS = "shard int, at int, doc_id long, local long, offset long, n_tokens long, ids_crc32 long"
#: Pieces of text that a worker remembers, bytes of text that it encodes at once, and how many keys may be sent to all executors.
CACHE, PORTION, FEW_KEYS = 200_000, 2 << 20, 100_000
#: A mark that no text that is split holds, and what keeps a text from being split (see ByteEncoder).
MARK = "￿"
_SPACE = r"[\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WHOLE = rf"{_SPACE}{{3}}|{_SPACE}{{2}}\z|<\|"
#: A comma or full stop at the end of a word that does not follow a letter or a digit.
JOINED = r"(?:^|[^\p{L}\p{N}])[,.][ \n]"
#: ASCII marks that may follow letters; the tokenizer parts them from letters.
MARKS = ",.;:!?$%&*#()\"-"


def _listed(texts: pa.StringArray) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


class ByteEncoder:
    """Ids of texts by a byte-level tokenizer, as one array with the bounds of each text.

    The tokenizer starts a new token at the first of several blanks, and, of two blanks that a word follows, at the second
    one too.  So a text is cut before every space and line break, unless it has three blanks in a row, two at its end, or
    what could be a special token; such a text is encoded whole.  Commas and full stops after words are pieces, unless
    the text has one after something else.  Different pieces are encoded once and remembered.
    A new piece of a space, letters and MARKS is cut before the marks; those of letters alone are encoded together, where
    every token that starts with a space starts a piece.  If the counts differ, pieces are encoded one by one.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.starts[i] = token.startswith("Ġ")
        self.width = 2 if len(self.starts) <= 1 << 16 else 4
        self.hits, self.known = np.zeros(0, np.int32), {}
        self._forget()

    def _forget(self, least: int = 1 << 30) -> None:
        """Keeps the pieces that were met in at least so many portions."""
        kept = np.nonzero(self.hits >= least)[0] if least < 1 << 30 else np.zeros(0, np.int64)
        if len(kept) > CACHE // 2:
            kept = kept[:0]
        chosen = np.zeros(len(self.hits), bool)
        chosen[kept] = True
        pieces = list(compress(self.known, chosen.tolist())) if len(kept) else []
        ids, n = (gathered(self.ids, self.at[kept], self.n[kept]), self.n[kept]) if len(kept) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        self.known = dict(zip(pieces, range(len(pieces)), strict=True))
        self.ids, self.n, self.at, self.hits = ids, n, np.cumsum(n) - n, np.ones(len(n), np.int32)

    def _add(self, pieces: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.at = np.append(self.at, len(self.ids) + np.cumsum(n) - n)
        self.n, self.ids, self.hits = np.append(self.n, n), np.append(self.ids, ids), np.append(self.hits, np.zeros(len(n), np.int32))

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _each(), for words of a space and letters."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, "<u4")
        starts = np.nonzero(self.starts[ids])[0]
        return (ids, np.diff(starts, append=len(ids))) if len(starts) == len(words) and starts[0] == 0 else self._each(words)

    def _learn(self, pieces: list[str]) -> None:
        new = pa.array(pieces, pa.string())
        stems = pc.utf8_rtrim(new, MARKS)
        plain = pc.match_substring_regex(stems, r"^ \p{L}+$").to_numpy(zero_copy_only=False)
        odd, marked = np.nonzero(~plain)[0].tolist(), np.nonzero(plain)[0].tolist()
        if odd:
            self._add([pieces[k] for k in odd], *self._each([pieces[k] for k in odd]))
        stems = _listed(stems.filter(pa.array(plain)))
        fresh = [w for w in dict.fromkeys(stems) if w not in self.known]
        for k in range(0, len(fresh), 20_000):
            self._add(fresh[k : k + 20_000], *self._together(fresh[k : k + 20_000]))
        both = [(k, w) for k, w in zip(marked, stems, strict=True) if len(w) < len(pieces[k])]
        marks = [pieces[k][len(w) :] for k, w in both]
        fresh = [m for m in dict.fromkeys(marks) if m not in self.known]
        if fresh:
            self._add(fresh, *self._each(fresh))
        if both:  # a piece is a word and its marks
            parts = np.array([[self.known[w], self.known[m]] for (_, w), m in zip(both, marks, strict=True)])
            self._add([pieces[k] for k, _ in both], gathered(self.ids, self.at[parts].ravel(), self.n[parts].ravel()), self.n[parts].sum(1))

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of text k are ids[bounds[k] : bounds[k + 1]]."""
        texts = pc.fill_null(texts, "")
        if (odd := pc.match_substring(texts, MARK)).true_count:  # it cannot be split at the mark
            parts = [self(pa.array([t]))[0] if not o else self._each([t])[0] for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        marked = pc.replace_substring(pc.replace_substring(texts, " ", f"{MARK} "), "\n", f"{MARK}\n")
        apart = pc.replace_substring(pc.replace_substring(marked, f",{MARK}", f"{MARK},{MARK}"), f".{MARK}", f"{MARK}.{MARK}")
        marked = pc.if_else(pc.match_substring_regex(texts, JOINED), marked, apart)
        marked = pc.if_else(pc.match_substring_regex(texts, WHOLE), texts, marked)
        pieces = pc.split_pattern(marked, MARK)
        coded = pieces.flatten().dictionary_encode()
        if len(self.known) > CACHE:
            self._forget(2)
        listed = _listed(coded.dictionary)
        slot = np.array(list(map(self.known.get, listed, repeat(-1))), np.int64)
        if len(new := np.nonzero(slot < 0)[0]):
            unknown = [listed[k] for k in new.tolist()]
            self._learn(unknown)
            slot[new] = list(map(self.known.get, unknown))
        self.hits[slot] += 1
        slot = slot[coded.indices.to_numpy()]
        n = self.n[slot]
        ends = np.concatenate([[0], np.cumsum(n)])
        return gathered(self.ids, self.at[slot], n), ends[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]


@functools.lru_cache(1)
def encoder(tokenizer: str) -> ByteEncoder:
    """A worker's encoder, which its later tasks find again; tokenizer is a path or the name of a public file."""
    if "/" not in tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    return ByteEncoder(tokenizer)


def shard_file(keys: list[int | None], ids: list[np.ndarray], counts: list[int], width: int, shard: int) -> bytes:
    """A shard without its magic, which the writer adds."""
    nulls = sum(k is None for k in keys)
    payload = [i.astype(f"<u{width}").tobytes() for i in ids]
    tail = [np.array(counts, "<u4").tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(), struct.pack(FOOTER, width, shard, nulls, len(keys), sum(counts))]
    return b"".join(payload + tail)


def read_shard(raw: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """(shard, keys, counts, ids) of a shard file; the arrays are views of raw."""
    end, size = len(raw) - len(MAGIC), struct.calcsize(FOOTER)
    if raw[end:] != MAGIC.encode():
        raise ValueError("this is no shard file, or it is cut off")
    width, shard, nulls, n, tokens = struct.unpack_from(FOOTER, raw, end - size)
    keys = np.frombuffer(raw, "<i8", n, end - size - 8 * n)
    counts = np.frombuffer(raw, "<u4", n, end - size - 12 * n)
    return shard, [None] * nulls + keys[nulls:].tolist(), counts, np.frombuffer(raw, f"<u{width}", tokens)


def write_shards(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, shard_bytes: int = 12 << 20) -> None:
    """docs(doc_id, text) as shard files below path."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    dealt = rows.repartitionByRange(1 + size // shard_bytes, F.col("doc_id").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, shard = encoder(tokenizer), TaskContext.get().partitionId()
        keys, parts, counts, waiting = [], [], [], []

        def flush() -> None:
            ids, bounds = of(pa.concat_arrays(waiting))
            parts.append(np.insert(ids, bounds[1:], END).astype(f"<u{of.width}"))
            counts.extend((np.diff(bounds) + 1).tolist())
            waiting.clear()

        for b in batches:
            keys += b.column(0).to_pylist()
            waiting.append(b.column(2))
            if sum(t.nbytes for t in waiting) >= PORTION:
                flush()
        if waiting:
            flush()
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([shard_file(keys, parts, counts, of.width, shard)], pa.binary())], ["value"])

    files = dealt.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value"))
    with short_batches(docs.sparkSession, 100):
        files.write.option("lineSep", MAGIC).text(f"{path}/ids")


def shard_rows(spark: SparkSession, path: str) -> DataFrame:
    """Reads the shard files back, each once: a row (ROWS) for every document, in no order; local is its number among rows of its id in the shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
        for b in batches:
            for raw in b.column(0):
                shard, keys, counts, ids = read_shard(raw.as_py())
                n, local = len(keys), []
                for k in range(n):  # rows of an id are neighbours
                    local.append(local[-1] + 1 if k and keys[k] == keys[k - 1] else 0)
                ends = np.cumsum(counts, dtype=np.int64)
                starts = ends - counts
                sums = [zlib.crc32(ids[a:z].astype("<u4")) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [np.full(n, shard), np.arange(n), keys, local, starts, counts, sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in ROWS.split(", ")])

    files = spark.read.format("binaryFile").load(f"{path}/ids").where("length > 0").select("content")
    with short_batches(spark, 1):
        return saved(files.mapInArrow(read, ROWS), f"{path}/rows")


def with_places(rows: DataFrame) -> DataFrame:
    """Rows with copy, the number among all rows of their id, and base, the ids of all shards before.

    A shard's totals are one row, and only these rows meet in a window.
    """
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"), F.min_by(F.struct("doc_id"), "at").alias("first"), F.max_by(F.struct("doc_id"), "at").alias("last"), F.max_by(F.col("local") + 1, "at").alias("last_rows"))
    so_far = F.sum("last_rows").over(W.partitionBy("last").orderBy("shard"))
    order = W.partitionBy(F.lit(0)).orderBy("shard")
    goes_on = F.lag("last").over(order).eqNullSafe(F.col("first")) & F.lag("shard").over(order).isNotNull()
    base = F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = shards.withColumn("so_far", so_far).withColumn("carried", F.when(goes_on, F.lag("so_far").over(order)).otherwise(0)).withColumn("base", base)
    out = rows.join(shards.select("shard", "first", "carried", "base"), "shard")
    copy = F.col("local") + F.when(F.col("doc_id").eqNullSafe(F.col("first.doc_id")), F.col("carried")).otherwise(0)
    return out.select("shard", "doc_id", copy.alias("copy"), "offset", "n_tokens", "ids_crc32", "base")


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix that is one-to-one for each seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hashes(ids: np.ndarray, null: np.ndarray, copies: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of keys; different ids with copy 0 have different ones."""
    with np.errstate(over="ignore"):
        h = np.where(null, np.uint64(0xD1B54A32D192ED03), mixed(ids.astype(np.int64).view(np.uint64), seed))
        return np.where(copies == 0, h, mixed(h + copies.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D), seed + 1))


LEVELS, ROOM = 40, 2


class PerfectHash:
    """A minimal perfect hash of 64-bit hashes; those that occur twice are left to the caller (`rest`)."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits  # words of each level; all bits in 64-bit words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @classmethod
    def of(cls, hashes: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash, and which of the hashes have no slot."""
        left, sizes, levels = np.arange(len(hashes)), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            words = -(-ROOM * len(left) // 64)
            place = (mixed(hashes[left], level) % np.uint64(64 * words)).astype(np.int64)
            alone = np.bincount(place, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(words)
            left = left[~alone[place]]
        return cls(sizes, np.concatenate([np.zeros(0, "<u8"), *levels])), left

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """A slot for each hash, or -1; a hash that was not there may get any."""
        out, base, left = np.full(len(hashes), -1), 0, np.arange(len(hashes))
        for level, words in enumerate(self.sizes):
            place = (mixed(hashes[left], level) % np.uint64(64 * words)).astype(np.int64) + 64 * base
            word, bit = self.bits[place >> 6], (place & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            lower = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[here]] = (self.before[place >> 6] + lower)[here]
            left, base = left[~here], base + words
        return out


#: What the index keeps by slot: fingerprint, shard, offset and number of ids.
RECORD = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u4")])
LISTED = np.dtype([("id", "<i8"), ("null", "?"), ("copy", "<i8"), ("at", "<u4")])


def _keys(ids: pd.Series, copies: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    null = ids.isna().to_numpy()
    return ids.fillna(0).to_numpy().astype(np.int64), null, copies.to_numpy().astype(np.int64)


def index_bytes(rows: pd.DataFrame) -> bytes:
    """The index of a bucket's rows(doc_id, copy, shard, offset, n_tokens): sizes, bits, records by slot, keys without a slot."""
    ids, null, copies = _keys(rows["doc_id"], rows["copy"])
    hashes = key_hashes(ids, null, copies, 0)
    perfect, rest = PerfectHash.of(hashes)
    slot = perfect.slots(hashes)
    slot[rest] = len(ids) - len(rest) + np.arange(len(rest))
    records = np.zeros(len(ids), RECORD)
    records["print"][slot] = key_hashes(ids, null, copies, 7) >> np.uint64(32)
    for name, column in (("shard", "shard"), ("offset", "offset"), ("n", "n_tokens")):
        records[name][slot] = rows[column].to_numpy()
    listed = np.zeros(len(rest), LISTED)
    listed["id"], listed["null"], listed["copy"], listed["at"] = ids[rest], null[rest], copies[rest], slot[rest]
    head = struct.pack(f"<III{len(perfect.sizes)}I", len(perfect.sizes), len(ids), len(rest), *perfect.sizes)
    return head + perfect.bits.tobytes() + records.tobytes() + listed.tobytes()


def find(raw: bytes, ids: pd.Series, copies: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(which keys are in the bucket, their records)."""
    levels, n, n_rest = struct.unpack_from("<III", raw)
    sizes = list(struct.unpack_from(f"<{levels}I", raw, 12))
    at = 12 + 4 * levels
    perfect = PerfectHash(sizes, np.frombuffer(raw, "<u8", sum(sizes), at))
    records = np.frombuffer(raw, RECORD, n, at + 8 * sum(sizes))
    listed = np.frombuffer(raw, LISTED, n_rest, at + 8 * sum(sizes) + RECORD.itemsize * n)
    keys = _keys(ids, copies)
    slot = perfect.slots(key_hashes(*keys, 0))
    if n_rest:
        by_key = {(int(r["id"]), bool(r["null"]), int(r["copy"])): int(r["at"]) for r in listed}
        exact = np.array([by_key.get((int(i), bool(z), int(c)), -1) for i, z, c in zip(*keys, strict=True)])
        slot = np.where(exact >= 0, exact, slot)
    there = slot >= 0
    got = records[np.where(there, slot, 0)] if n else np.zeros(len(slot), RECORD)
    return there & (got["print"] == key_hashes(*keys, 7) >> np.uint64(32)), got


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)).cast("int").alias("bucket")


def write_index(rows: DataFrame, path: str, bucket_keys: int = 4096) -> None:
    """rows(doc_id, copy, shard, offset, n_tokens), a key each, as the index below path; keys are different, so buckets are even."""
    buckets = 1 + rows.count() // bucket_keys

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": part["bucket"].iloc[:1], "buckets": buckets, "mph": [index_bytes(part)]})

    keyed = rows.select(_bucket(buckets), "doc_id", "copy", "shard", "offset", "n_tokens")
    keyed.groupBy("bucket").applyInPandas(build, "bucket int, buckets int, mph binary").write.mode("overwrite").parquet(f"{path}/index")


def token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, shard_bytes: int = 12 << 20, bucket_keys: int = 4096) -> DataFrame:
    """Writes docs(doc_id, text) as shard files and index below path; gives what reading them back shows by document (see with_places)."""
    spark = docs.sparkSession
    write_shards(docs, path, tokenizer, shard_bytes)
    rows = saved(with_places(shard_rows(spark, path)), f"{path}/places")
    write_index(rows, path, bucket_keys)
    return rows


def locate(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """keys(doc_id, copy), different ones -> doc_id, copy, shard, offset, n_tokens of those that the index knows."""
    index = spark.read.parquet(f"{path}/index")
    one = index.select("buckets").first()
    keyed = keys.select(_bucket(one["buckets"] if one else 1), F.col("doc_id").cast("long").alias("doc_id"), F.col("copy").cast("long").alias("copy"))

    def look_up(asked: pd.DataFrame, bucket: pd.DataFrame) -> pd.DataFrame:
        if not len(bucket) or not len(asked):
            return pd.DataFrame({c: [] for c in ("doc_id", "copy", "shard", "offset", "n_tokens")})
        there, got = find(bucket["mph"].iloc[0], asked["doc_id"], asked["copy"])
        out = asked[there]
        got = got[there]
        return pd.DataFrame({"doc_id": out["doc_id"].astype("Int64"), "copy": out["copy"], "shard": got["shard"], "offset": got["offset"], "n_tokens": got["n"]})

    return keyed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(look_up, "doc_id long, copy long, shard int, offset long, n_tokens long")


def fetch(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """keys(doc_id, copy), different ones -> doc_id, copy and ids of those that are there: slices of the payloads, each file read once.

    The places asked for in a shard are one row; where keys are few these rows go to all executors, else shards are joined.
    """
    places = locate(spark, path, keys).groupBy("shard").agg(F.collect_list(F.struct("doc_id", "copy", "offset", "n_tokens")).alias("asked"))
    places = F.broadcast(places) if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS else places
    files = spark.read.format("binaryFile").load(f"{path}/ids").where("length > 0").select("content", F.substring_index(F.element_at(F.split("path", "/"), -1), "-", 2).alias("name"))
    named = files.withColumn("shard", F.regexp_extract("name", "([0-9]+)$", 1).cast("int"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                asked = b.column(1)[k].as_py()
                _, _, _, ids = read_shard(b.column(0)[k].as_py())
                columns = [[a[c] for a in asked] for c in ("doc_id", "copy")] + [[ids[a["offset"] : a["offset"] + a["n_tokens"]].astype(np.int32) for a in asked]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["doc_id", "copy", "ids"])

    return named.join(places, "shard").select("content", "asked").mapInArrow(cut, "doc_id long, copy long, ids array<int>")


def numbered_ids(docs: DataFrame, most: int = 1 << 16) -> DataFrame:
    """doc_id and copy of every row, from the counts by id; a count is dealt in stretches of `most`, so that a hot id is not one task's."""
    counts = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    parts = counts.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(most).cast("long"))).alias("lo")).repartition("doc_id", "lo")
    return parts.select("doc_id", F.explode(F.sequence("lo", F.least(F.col("lo") + most, F.col("n")) - 1)).alias("copy"))


def op11_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's key is looked up in the index; the place that it gives has to be one that the files show."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), shared_dir(spark)
    rows = token_files(docs, path)
    found = locate(spark, path, numbered_ids(docs)).withColumnRenamed("doc_id", "key")
    there = rows.select("shard", "offset", "n_tokens", "base", "ids_crc32")
    return found.join(there, ["shard", "offset", "n_tokens"]).select(F.col("key").alias("doc_id"), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "copy", "shard")
