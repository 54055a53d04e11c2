"""Suffix-array dedup of long repeated byte strings with a logarithmic family of indexes.

Suffixes are sampled so that every string of `least` bytes holds a sampled position that depends on its bytes alone
(the smallest hash among its grams of `GRAM` bytes).  The samples of a batch are dealt to shards by the 48-bit hash of
their leading gram and sorted there by (hash, document): an inverted index of hashed grams with the levels of a suffix
array family, in which no suffix is compared.  A new batch's entries are merge-scanned with those of every existing
level, and levels of equal rank are merged with it into the next rank in the same pass.  Entries whose gram occurs in
several documents are candidates.

Candidates are then verified: the `least`-byte strings around a candidate go to the shard of its gram and are compared
there by 64-bit hashes, each against the smallest doc_id that holds it.  What is left of a document is computed where
its text is.  Texts travel as zstd-compressed bytes.

Hot strings: within one block of texts a gram (or the bytes around it) that several documents share is settled on the
spot, and only its smallest document goes on, so a shard holds one entry per block and gram; its further positions
with equal bytes around them take that entry's result.  Exact copies of a text are settled by their hash and never
verified.  Shards grow in number with the text.

Defined cases: null texts are empty; a null doc_id counts as larger than any; texts under `least` bytes lose nothing;
strings that repeat only within one doc_id stay, also where rows repeat it; an empty table gives no rows; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from storyweft.llm.common import dropped, saved, shared_dir, short_batches, table

LEAST, GRAM, BLOCK = 50, 16, 3 << 20
NO_ID = (1 << 63) - 1
U = np.uint64


def _mix(x: np.ndarray, a: int, shift: int) -> np.ndarray:
    x = x * U(a)
    x ^= x >> U(shift)
    return x


def gram_hashes(b: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n bytes of b, n a power of two, by doubling."""
    h, w = _mix(b.astype(np.uint64) + U(1), 0x9E3779B97F4A7C15, 32), 1
    while w < n:
        h = _mix(h[:-w] * U(0xC2B2AE3D27D4EB4F) + h[w:], 0xD6E8FEB86659FD93, 31)
        w *= 2
    return h


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """gram_hashes() of whole rows, whose length is a power of two."""
    with np.errstate(over="ignore"):
        h = _mix(rows.astype(np.uint64) + U(1), 0x9E3779B97F4A7C15, 32)
        while h.shape[1] > 1:
            h = _mix(h[:, ::2] * U(0xC2B2AE3D27D4EB4F) + h[:, 1::2], 0xD6E8FEB86659FD93, 31)
    return h[:, 0]


def sampled(texts: list[bytes], least: int = LEAST, chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, position, gram) of the sampled suffixes; grams have 48 bits.  Windows are hashed `chunk` at a time."""
    texts_n = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(texts_n) - texts_n
    inside = np.zeros(len(b) + 1, np.int8)  # windows that lie in one text
    long = texts_n >= least
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, starts[long] + texts_n[long] - least + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for lo in range(0, len(b) - least + 1, chunk):
        at, key = _sampled(b[lo : lo + chunk + least - 1], inside[lo : lo + chunk], least)
        found.append((at + lo, key))
    at, key = (np.concatenate(c) for c in zip(*found, strict=True))
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    at, key = at[new], key[new]
    doc = np.searchsorted(starts, at, "right") - 1
    return doc, at - starts[doc], key


def _sampled(b: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = gram_hashes(b, GRAM)
        span = least - GRAM + 1
        low = (h & U(0xFFFFFFFFFFFF0000)) | (np.arange(len(h), dtype=np.uint64) & U(0xFFFF))
        w = 1
        while 2 * w <= span:
            low = np.minimum(low[:-w], low[w:])
            w *= 2
        low = np.minimum(low[: len(low) - (span - w)], low[span - w :])
        s = np.nonzero(inside[: len(low)])[0]
        at = s + (((low[s] & U(0xFFFF)).astype(np.int64) - s) & 0xFFFF)
        return at, _mix(h[at], 0xA0761D6478BD642F, 29) >> U(16)


def _shared(order_key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """order: sorts by (key, doc); first: marks a key's first entry in that order; several: marks entries of keys with several docs."""
    order = np.lexsort((doc, order_key))
    k, d = order_key[order], doc[order]
    first = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    start = np.nonzero(first)[0]
    end = np.append(start[1:], len(k)) - 1
    several = (d[end] != d[start])[group] if len(k) else first
    return order, first, several


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of at most about BLOCK bytes of text (a longer text alone)."""
    rows, size = [], 0
    for b in batches:
        for doc, text in zip(b.column("doc_id"), b.column("text"), strict=True):
            rows.append({"doc_id": doc.as_py(), "text": text.as_py()})
            size += len(rows[-1]["text"])
            if size >= BLOCK:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time."""
    for k in range(len(batch)):
        yield {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _by_doc(doc: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order].astype("<i4")
    cuts = np.nonzero(doc[1:] != doc[:-1])[0] + 1
    for d, p in zip(doc[np.concatenate([[0], cuts])] if len(doc) else [], np.split(pos, cuts), strict=False):
        yield int(d), p.tobytes()


RUN = "shard int, level int, kind int, doc long, grams binary, docs binary, at binary, known binary"


def suffix_blocks(docs: DataFrame, shards: int, least: int = LEAST) -> DataFrame:
    """docs(doc_id, text as bytes) -> blocks of sampled suffixes by shard (kind 0), and candidates that a block has settled (kind 1)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            ids = np.array([r["doc_id"] for r in rows], np.int64)
            d, at, key = sampled([r["text"] for r in rows], least)
            if not len(d):
                continue
            doc = ids[d]
            order, first, several = _shared(key, doc)
            doc, at, key = doc[order], at[order], key[order]
            out = [(int(i) % shards, -1, 1, i, None, None, p, None) for i, p in _by_doc(doc[several], at[several])]
            keep = ~several | first
            doc, at, key, known = doc[keep], at[keep].astype("<i4"), key[keep], several[keep]
            shard = (key % U(shards)).astype(np.int64)
            order = np.lexsort((at, doc, shard))
            doc, at, key, known, shard = doc[order], at[order], key[order], known[order], shard[order]
            cuts = np.nonzero(shard[1:] != shard[:-1])[0] + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                out.append((int(shard[lo]), -1, 0, None, _six(key[lo:hi]), doc[lo:hi].astype("<i8").tobytes(), at[lo:hi].tobytes(), np.packbits(known[lo:hi]).tobytes()))
            yield _batch(out, RUN_SCHEMA)

    return docs.mapInArrow(make, RUN)


RUN_SCHEMA = pa.schema([("shard", pa.int32()), ("level", pa.int32()), ("kind", pa.int32()), ("doc", pa.int64()), ("grams", pa.binary()), ("docs", pa.binary()), ("at", pa.binary()), ("known", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _six(key: np.ndarray) -> bytes:
    return key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _scan(merged: set[int], keep: bool):
    """Merge-scans a shard's runs; gives the run of the new batch with the merged levels, and the new candidates."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [tuple(r) for r in pdf[pdf["kind"] == 1].itertuples(index=False)]
        runs = pdf[pdf["kind"] == 0]
        shard = int(pdf["shard"].iloc[0])
        if len(runs):
            key = np.concatenate([_from_six(x) for x in runs["grams"]])
            doc = np.concatenate([np.frombuffer(x, "<i8") for x in runs["docs"]])
            at = np.concatenate([np.frombuffer(x, "<i4") for x in runs["at"]])
            known = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(d) // 8).astype(bool) for x, d in zip(runs["known"], runs["docs"], strict=True)])
            stays = np.concatenate([np.full(len(d) // 8, level == -1 or level in merged) for level, d in zip(runs["level"], runs["docs"], strict=True)])
            order, first, several = _shared(key, doc)
            key, doc, at, known, stays = key[order], doc[order], at[order], known[order], stays[order]
            start = np.nonzero(first)[0]
            several |= np.logical_or.reduceat(known, start)[np.cumsum(first) - 1]  # a gram that was in several documents before
            new = several & ~known
            stays &= ~several | first  # of such a gram one entry is enough from now on
            out += [(shard, -1, 1, i, None, None, p, None) for i, p in _by_doc(doc[new], at[new])]
            if keep:
                out.append((shard, -1, 0, None, _six(key[stays]), doc[stays].astype("<i8").tobytes(), at[stays].astype("<i4").tobytes(), np.packbits((known | several)[stays]).tobytes()))
        return pd.DataFrame(out, columns=list(pdf.columns))

    return scan


class SuffixIndexFamily:
    """Levels of sampled suffixes by hashed gram; level r holds 2**r batches.  add() indexes a batch and keeps its candidates."""

    def __init__(self, spark: SparkSession, shards: int, least: int = LEAST) -> None:
        self.spark, self.shards, self.least, self.work = spark, shards, least, f"{shared_dir(spark)}/family"
        self.levels: dict[int, int] = {}
        self.batches = 0

    def add(self, docs: DataFrame, last: bool = False) -> None:
        """docs(doc_id, text as bytes); last: no batch follows, so the new level need not be kept."""
        blocks = suffix_blocks(docs, self.shards, self.least)
        merged, rank = set(), 0
        while rank in self.levels:
            merged.add(rank)
            rank += 1
        for r, batch in self.levels.items():
            blocks = blocks.unionByName(self._rows().where((F.col("batch") == batch) & (F.col("kind") == 0)).withColumn("level", F.lit(r)).drop("batch"))
        with short_batches(self.spark):
            blocks.groupBy("shard").applyInPandas(_scan(merged, not last), RUN).write.partitionBy("kind").parquet(f"{self.work}/batch={self.batches}")
        for r in merged:
            dropped(self.spark, f"{self.work}/batch={self.levels.pop(r)}/kind=0")
        if not last:
            self.levels[rank] = self.batches
        self.batches += 1

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(f"{RUN}, batch int").parquet(self.work)

    def candidates(self) -> DataFrame:
        """doc, at: lists of the positions of a document's candidates."""
        return self._rows().where("kind = 1").groupBy("doc").agg(F.collect_list("at").alias("at"))


CONTEXT = "shard int, kind int, docs binary, hs binary, at binary, bounds binary, bytes binary, twins binary"
CONTEXT_SCHEMA = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("hs", pa.binary()), ("at", pa.binary()), ("bounds", pa.binary()), ("bytes", pa.binary()), ("twins", pa.binary())])
#: A further position of the smallest document with the bytes of entry `of`, whose mask it shares.
TWIN = np.dtype([("h", "<i8"), ("at", "<i4"), ("of", "<i4")])
MASKS = "doc_id long, h long, at binary, mask binary"


def _masks(doc: np.ndarray, h: np.ndarray, at: np.ndarray, mask: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((h, doc))
    doc, h, at, mask = doc[order], h[order], at[order].astype("<i4"), mask[order].astype("<u8")
    cuts = np.nonzero((doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))[0] + 1
    lo = np.concatenate([[0], cuts]) if len(doc) else cuts
    return pd.DataFrame({"doc_id": doc[lo], "h": h[lo], "at": [x.tobytes() for x in np.split(at, cuts)][: len(lo)], "mask": [x.tobytes() for x in np.split(mask, cuts)][: len(lo)]})


def _strings(ctx: np.ndarray, least: int) -> np.ndarray:
    """Hashes of the strings of `least` bytes of each row, the last that starts in it first."""
    with np.errstate(over="ignore"):
        h, w = _mix(ctx.astype(np.uint64) + U(1), 0x9E3779B97F4A7C15, 32), 1
        while 2 * w <= least:
            h = _mix(h[:, :-w] * U(0xC2B2AE3D27D4EB4F) + h[:, w:], 0xD6E8FEB86659FD93, 31)
            w *= 2
        if rest := least - w:
            h = _mix(h[:, : h.shape[1] - rest] * U(0xA0761D6478BD642F) + h[:, rest:], 0xE7037ED1A0B428DB, 29)
    return h[:, ::-1].copy()


def _by_gram(grams: np.ndarray, size: int = 1 << 14) -> Iterator[np.ndarray]:
    """Indices of rows in parts of about `size`, equal rows in one part."""
    key = row_hashes(grams)
    order = np.argsort(key, kind="stable")
    ends = np.append(np.nonzero(np.diff(key[order]))[0] + 1, len(order))
    at = 0
    while at < len(order):
        end = int(ends[np.searchsorted(ends, min(at + size, len(order)))])
        yield order[at:end]
        at = end


def _held_before(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Marks the strings (by hash) that a smaller document holds too."""
    out = np.zeros(len(value), bool)
    if len(value):
        order = np.argsort(value)
        v, d = value[order], doc[order]
        first = np.concatenate([[True], v[1:] != v[:-1]])
        out[order] = d > np.minimum.reduceat(d, np.nonzero(first)[0])[np.cumsum(first) - 1]
    return out


def _bits(rows: np.ndarray) -> np.ndarray:
    """Rows of at most 64 marks as numbers, the first mark being bit 0."""
    wide = np.zeros((len(rows), 64), bool)
    wide[:, : rows.shape[1]] = rows
    return np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel()


def repeated_strings(docs: DataFrame, candidates: DataFrame, shards: int, least: int = LEAST, flush: int = 1 << 16) -> DataFrame:
    """docs(doc_id, h, z), candidates(doc, at) -> doc_id, h, at, mask: bit j of a mask says that the string that starts j bytes before at also starts in a smaller document.  Positions with equal bytes are
    thinned within `flush` entries."""
    back, wide = least - GRAM, 2 * least - GRAM

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress

        def emit(rows):
            doc, h, at, lead, size, ctx = (np.concatenate(c) for c in zip(*rows, strict=True))
            with np.errstate(over="ignore"):
                gram = _mix(row_hashes(ctx[:, back : back + GRAM]), 0xA0761D6478BD642F, 29) >> U(16)
                whole = np.zeros(len(doc), np.uint64)
                for k in range(0, wide + (-wide) % 8, 8):
                    part = np.zeros((len(doc), 8), np.uint8)
                    part[:, : min(8, wide - k)] = ctx[:, k : k + 8]
                    whole = _mix(whole * U(0xC2B2AE3D27D4EB4F) + part.view("<u8").ravel(), 0xD6E8FEB86659FD93, 31)
                whole = _mix(whole + lead.astype(np.uint64) * U(256) + size.astype(np.uint64), 0x9E3779B97F4A7C15, 30)
            shard = (gram % U(shards)).astype(np.int64)
            order, first, _ = _shared(whole, doc)
            w, d = whole[order], doc[order]
            least_doc = d[np.maximum.accumulate(np.where(first, np.arange(len(d)), 0))]
            settled = order[d > least_doc]
            kept = order[first]
            turn = np.lexsort((at[kept], doc[kept], shard[kept]))
            again = (d == least_doc) & ~first
            twins = np.zeros(again.sum(), TWIN)
            twins["h"], twins["at"], twins["of"] = h[order[again]], at[order[again]], np.argsort(turn)[np.cumsum(first)[again] - 1]
            twins = twins[np.argsort(twins["of"], kind="stable")]
            kept = kept[turn]
            pack = zstandard.ZstdCompressor(level=3).compress
            out = []
            for kind, chosen in ((0, kept), (1, settled)):
                cuts, lo = np.nonzero(shard[chosen][1:] != shard[chosen][:-1])[0] + 1 if kind == 0 else [], 0
                for part in np.split(chosen, cuts) if len(chosen) else []:
                    bounds = np.stack([lead[part], size[part]], 1).astype(np.uint8)
                    mine = twins[slice(*np.searchsorted(twins["of"], [lo, lo + len(part)]))].copy() if kind == 0 else twins[:0]
                    mine["of"] -= lo
                    lo += len(part)
                    out.append((int(shard[part[0]]), kind, doc[part].astype("<i8").tobytes(), h[part].astype("<i8").tobytes(), at[part].astype("<i4").tobytes(), bounds.tobytes(), b"" if kind else pack(np.ascontiguousarray(ctx[part]).tobytes()), mine.tobytes()))
            return _batch(out, CONTEXT_SCHEMA)

        rows, n = [], 0
        for b in batches:
            for r in _rows(b):
                text = np.frombuffer(unpack(r["z"]), np.uint8)
                at = np.unique(np.concatenate([np.frombuffer(x, "<i4") for x in r["at"]])).astype(np.int64)
                at = at[at + GRAM <= len(text)]
                if not len(at) or len(text) < least:
                    continue
                padded = np.concatenate([np.zeros(back, np.uint8), text, np.zeros(wide, np.uint8)])
                for k in range(0, len(at), flush):
                    a = at[k : k + flush]
                    lead, size = np.minimum(a, back), np.minimum(len(text) - a, least)
                    rows.append((np.full(len(a), r["doc_id"], np.int64), np.full(len(a), r["h"], np.int64), a, lead, size, padded[a[:, None] + np.arange(wide)]))
                    n += len(a)
                    if n >= flush:
                        yield emit(rows)
                        rows, n = [], 0
        if rows:
            yield emit(rows)

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        done = []
        read = lambda rows, c, t: np.concatenate([np.frombuffer(x, t) for x in rows[c]])
        for kind, rows in pdf.groupby("kind"):
            doc, h, at, bounds = read(rows, "docs", "<i8"), read(rows, "hs", "<i8"), read(rows, "at", "<i4"), read(rows, "bounds", np.uint8).reshape(-1, 2).astype(np.int64)
            js = np.arange(back + 1)
            valid = (js <= bounds[:, :1]) & (js >= least - bounds[:, 1:])  # starts j before at and ends inside the text
            if kind == 1:
                mask = _bits(valid)
            else:
                unpack = zstandard.ZstdDecompressor().decompress
                ctx = np.concatenate([np.frombuffer(unpack(x), np.uint8).reshape(-1, wide) for x in rows["bytes"]])
                mask = np.zeros(len(doc), np.uint64)
                for part in _by_gram(ctx[:, back : back + GRAM]):
                    hits = np.zeros((len(part), back + 1), bool)
                    hits[valid[part]] = _held_before(_strings(ctx[part], least)[valid[part]], np.repeat(doc[part], valid[part].sum(1)))
                    mask[part] = _bits(hits)
                twins = [np.frombuffer(x, TWIN) for x in rows["twins"]]
                sizes = np.array([len(x) // 8 for x in rows["docs"]])
                of = np.concatenate([t["of"] + lo for t, lo in zip(twins, np.cumsum(sizes) - sizes, strict=True)])
                twins = np.concatenate(twins)
                doc, h, at, mask = np.append(doc, doc[of]), np.append(h, twins["h"]), np.append(at, twins["at"]), np.append(mask, mask[of])
            some = mask != 0
            done.append(_masks(doc[some], h[some], at[some], mask[some]))
        return pd.concat(done) if done else pd.DataFrame({"doc_id": [], "h": [], "at": [], "mask": []})

    asked = docs.join(candidates, docs["doc_id"] == candidates["doc"]).select("doc_id", "h", "z", "at")
    return asked.mapInArrow(contexts, CONTEXT).groupBy("shard").applyInPandas(verify, MASKS)


#: Size of the filter of document ids that is broadcast; where it fills up, it only lets more texts travel.
FILTER_BITS = 1 << 23
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def _filter_of(ids: DataFrame, name: str):
    """A broadcast of FILTER_BITS bits; bit pmod(xxhash64(id), FILTER_BITS) is set for every id."""
    x = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS)) + 1
    rows = ids.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()  # at most FILTER_BITS / 32768 rows of 4 KB
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        bits[4096 * (r["k"] - 1) : 4096 * r["k"]] = np.frombuffer(r["bits"], np.uint8)
    return ids.sparkSession.sparkContext.broadcast(bits)


def substring_dedup(docs: DataFrame, batches: int = 3, least: int = LEAST, shard_bytes: int = 16 << 20, flush: int = 1 << 16) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends: the removed runs of bytes."""
    if not GRAM <= least - 1 <= GRAM + 62:
        raise ValueError("least must be between GRAM + 1 and GRAM + 63")
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    seen = docs.agg(F.sum(F.length("text")).alias("n"), F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [0.5]).alias("cuts")).first()
    family = SuffixIndexFamily(spark, int(max(24, (seen["n"] or 0) // shard_bytes)), least)
    cuts = sorted({*(seen["cuts"] or [])} if batches > 1 else [])
    for k in range(len(cuts) + 1):
        part = docs
        if k:
            part = part.where(F.col("doc_id") > cuts[k - 1])
        if k < len(cuts):
            part = part.where(F.col("doc_id") <= cuts[k])
        family.add(part, last=k == len(cuts))
    keyed = docs.withColumn("h", F.xxhash64("text", F.length("text")))
    work = shared_dir(spark)
    firsts = saved(keyed.groupBy("h").agg(F.min("doc_id").alias("first")), f"{work}/firsts")

    keyed = keyed.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))

    def packed(bits):
        def pack_texts(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack, there = zstandard.ZstdCompressor(level=3).compress, np.unpackbits(bits.value, bitorder="little")
            for b in batches_:
                b = b.filter(pa.array(there[b.column("bit").to_numpy()] == 1))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array([pack(t.as_buffer()) for t in b.column("text")], pa.binary())], ["doc_id", "h", "z"])

        return keyed.mapInArrow(pack_texts, "doc_id long, h long, z binary")

    asked = family.candidates().join(firsts.select(F.col("first").alias("doc")).distinct(), "doc", "left_semi")
    asked = saved(asked, f"{work}/asked")
    with short_batches(spark):
        masks = saved(repeated_strings(packed(_filter_of(asked, "doc")), asked, 4 * family.shards, least, flush), f"{work}/masks")
    masks = masks.groupBy("doc_id", "h").agg(F.collect_list("at").alias("at"), F.collect_list("mask").alias("mask"))

    def whole(bits):
        def digest(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            there = np.unpackbits(bits.value, bitorder="little")
            for b in batches_:
                b = b.filter(pa.array(there[b.column("bit").to_numpy()] == 0))
                yield _batch([(None if i == NO_ID else i, len(t), 0, 0, hashlib.sha256(t).hexdigest(), [], []) for i, t in zip(b.column("doc_id").to_pylist(), (t.as_py() for t in b.column("text")), strict=True)], RESULT_SCHEMA)

        return keyed.mapInArrow(digest, RESULT)

    def cut(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches_:
            out = []
            for r in _rows(b):
                text = unpack(r["z"])
                gone = np.zeros(len(text) + 1, np.int32)
                if r["first"] is not None and r["first"] < r["doc_id"]:
                    if len(text) >= least:
                        gone[0] += 1
                        gone[-1] -= 1
                elif r["at"]:
                    at, mask = (np.concatenate([np.frombuffer(x, t) for x in r[c]]) for c, t in (("at", "<i4"), ("mask", "<u8")))
                    i, j = np.nonzero(np.unpackbits(np.ascontiguousarray(mask).view(np.uint8).reshape(-1, 8), axis=1, count=least - GRAM + 1, bitorder="little"))
                    starts = np.zeros(len(text) + 1, bool)
                    starts[at[i].astype(np.int64) - j] = True
                    gone += starts
                    gone[least:] -= starts[: len(gone) - least]
                covered = np.cumsum(gone[:-1]) > 0
                edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
                starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
                kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
                out.append((None if r["doc_id"] == NO_ID else r["doc_id"], len(text), int(covered.sum()), len(starts), hashlib.sha256(kept).hexdigest(), starts.tolist(), ends.tolist()))
            yield _batch(out, RESULT_SCHEMA)

    copied = keyed.select("doc_id", "h").join(firsts, "h").where("doc_id > first").select("doc_id", "h", "first").distinct()
    removed = saved(masks.join(copied, ["doc_id", "h"], "full_outer"), f"{work}/removed")
    bits = _filter_of(removed, "doc_id")
    changed = packed(bits).join(removed, ["doc_id", "h"], "left").select("doc_id", "h", "z", "at", "mask", "first").mapInArrow(cut, RESULT)
    return changed.unionByName(whole(bits))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
