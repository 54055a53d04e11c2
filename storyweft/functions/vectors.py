"""Cosine similarity of arrays, exact nearest neighbours in blocks, and an offline encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F


#: Microseconds.
DAY = 86_400_000_000
#: Stands for the story of an article without one.
NONE = np.iinfo(np.int64).min


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(queries: DataFrame, articles: DataFrame, m: int, days: float | None = None, block: int = 1024) -> DataFrame:
    """Each query's m most similar articles (J08: within `days` of it): query_id, article_id, sim; ties to the smaller id.

    queries and articles have id, published_at and embedding; rows without an embedding take no part, and vectors of
    different widths are never neighbours.
    """
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("sim").desc(), F.col("article_id")))
    found = _met(queries, articles.select("id", "published_at", "embedding"), m, days, block).drop("story_id")
    return found.withColumn("rn", best).where(F.col("rn") <= m).drop("rn")


def nearest_stories(queries: DataFrame, articles: DataFrame, links: DataFrame, m: int, days: float | None = None, block: int = 1024) -> DataFrame:
    """The stories of each query's nearest() articles: query_id, story_id (a whole number), and sim and article_id of the story's most similar one.

    links(article_id, story_id) may give an article several stories or none.
    """
    own = links.groupBy(F.col("article_id").alias("id")).agg(F.collect_set(F.col("story_id").cast("long")).alias("stories"))
    found = _met(queries, articles.select("id", "published_at", "embedding").join(own, "id", "left"), m, days, block)
    place = F.dense_rank().over(W.partitionBy("query_id").orderBy(F.col("sim").desc(), F.col("article_id")))
    found = found.withColumn("place", place).where((F.col("place") <= m) & F.col("story_id").isNotNull())
    per = found.groupBy("query_id", "story_id").agg(F.max("sim").alias("sim"), F.max_by("article_id", F.struct("sim", -F.col("article_id"))).alias("article_id"))
    return per.withColumn("story_id", F.col("story_id").cast(links.schema["story_id"].dataType))


def _met(queries: DataFrame, articles: DataFrame, m: int, days: float | None, block: int) -> DataFrame:
    """query_id, article_id, sim, story_id: rows that hold each query's m most similar articles, a row for each story of an article (null without one).

    Both sides are packed into blocks; a row of the join is two blocks.  Blocks of queries are dealt to groups that the
    blocks of articles are copied to, so all that a query may meet comes to one task, which keeps the block's best m while
    blocks of articles pass by.  With days, blocks hold one time bucket of that length, and a query meets its bucket and
    the two beside it.  A query that has met `all` of its articles (as it does, unless Spark splits a task) needs no
    others: where there are stories, only the best article of each is given.  Else all of the task's best m are given, so
    the caller's ranks are right in either case.  The rows given are as many as the result, however many blocks there are.
    """
    stories = "stories" in articles.columns
    groups = queries.sparkSession.sparkContext.defaultParallelism * (2 if days is None else 1)
    around = lambda x: x if days is None else x.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    q = _blocks(queries, days, max(64, min(block, 1 << 14, (1 << 20) // m)))
    q = q.join(around(_placed(articles, days)).groupBy("bucket", "width").agg(F.count("*").alias("all")), ["bucket", "width"])
    q = q.select("bucket", "width", "all", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("group"), F.col("ids").alias("q_ids"), F.col("ats").alias("q_ats"), F.col("m").alias("q"))
    a = around(_blocks(articles, days, max(4096, 4 * m))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    q_kind, a_kind = _kind(queries), _kind(articles)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, best = None, None
        for b in batches:
            for k in range(b.num_rows):
                ids, ats, q, seen, vec, counts, home = (b.column(c)[k].as_buffer() for c in ("q_ids", "q_ats", "q", "ids", "m", "counts", "homes"))
                width = b.column("width")[k].as_py()
                if best is None or of != ids.to_pybytes():
                    if best is not None:
                        yield from best.rows(stories)
                    of = ids.to_pybytes()
                    best = _Best(_array(ids, "<i8").copy(), _array(ats, "<i8").copy(), _unit(_array(q, q_kind), width), m, b.column("all")[k].as_py())
                best.add(_array(seen, "<i8"), _array(b.column("ats")[k].as_buffer(), "<i8"), _unit(_array(vec, a_kind), width), _array(counts, "<i4"), _array(home, "<i8"), days)
        if best is not None:
            yield from best.rows(stories)

    both = q.join(a.hint("merge"), ["bucket", "width", "group"]).select("width", "all", "q_ids", "q_ats", "q", "ids", "ats", "m", "counts", "homes")
    return both.mapInArrow(match, "query_id long, article_id long, sim double, story_id long")


class _Best:
    """The best m articles so far of each query of a block; an article with several stories has an entry for each."""

    def __init__(self, ids: np.ndarray, ats: np.ndarray, vectors: np.ndarray, m: int, every: int):
        self.ids, self.ats, self.vectors, self.m, self.left = ids, ats, vectors, m, every
        self.bar = np.full(len(ids), -np.inf)  # the similarity of the m-th best
        self.kept = (np.empty(0, np.int16), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
        self.parts, self.size, self.single = [], 0, True

    def add(self, ids, ats, vectors, counts, homes, days) -> None:
        sim = self.vectors @ vectors.T
        sim[self.ids[:, None] == ids] = -np.inf
        if days is not None:
            sim[np.abs(self.ats[:, None] - ats) > days * DAY] = -np.inf
        self.left -= len(ids)
        bar = self.bar
        if len(ids) > self.m and np.count_nonzero(sim >= bar[:, None]) > 2 * self.m * len(self.ids):
            bar = np.maximum(bar, -np.partition(-sim, self.m - 1, axis=1)[:, self.m - 1])
        i, j = np.nonzero((sim >= bar[:, None]) & np.isfinite(sim))
        rows = i.astype(np.int16), sim[i, j], ids[j]
        if len(homes) == len(ids):  # each has one
            home = homes[j]
        else:
            self.single = False
            n, start = counts[j], (np.cumsum(counts) - counts)[j]
            rows = tuple(np.repeat(x, n) for x in rows)
            home = homes[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        self.parts.append((*rows, home))
        self.size += len(home)
        if self.size > self.m * len(self.ids):
            self.cut()

    def cut(self) -> None:
        i, sim, ids, home = (np.concatenate(x) for x in zip(self.kept, *self.parts))
        self.parts, self.size = [], 0
        n = np.bincount(i, minlength=len(self.ids))
        if self.single and n.max() > self.m:
            order = np.argsort(i, kind="stable")
            dense = np.full((len(n), n.max()), -np.inf)
            dense[i[order], np.arange(len(i)) - (np.cumsum(n) - n)[i[order]]] = sim[order]
            self.bar = np.maximum(self.bar, -np.partition(-dense, self.m - 1, axis=1)[:, self.m - 1])
            top = sim >= self.bar[i]
            i, sim, ids, home = i[top], sim[top], ids[top], home[top]
        more = np.bincount(i, minlength=len(self.ids))[i] > self.m  # equal ones, or several stories
        some = np.flatnonzero(more)
        some = some[np.lexsort((ids[some], -sim[some], i[some]))]
        of, at, same = i[some], sim[some], ids[some]
        nth = np.cumsum(np.r_[True, (of[1:] != of[:-1]) | (at[1:] != at[:-1]) | (same[1:] != same[:-1])][: len(some)])
        nth = nth - nth[np.searchsorted(of, of, "left")]  # the number of better articles of the query
        self.bar[of[nth == self.m - 1]] = at[nth == self.m - 1]
        kept = np.r_[np.flatnonzero(~more), some[nth < self.m]]
        self.kept = (i[kept], sim[kept], ids[kept], home[kept])

    def rows(self, stories: bool) -> Iterator[pa.RecordBatch]:
        self.cut()
        i, sim, ids, home = self.kept
        if stories and self.left == 0 and len(i):
            known, code = np.unique(home, return_inverse=True)
            pairs, code = np.unique(i.astype(np.int64) * len(known) + code, return_inverse=True)
            most = np.full(len(pairs), -np.inf)
            np.maximum.at(most, code, sim)
            best = np.flatnonzero((sim == most[code]) & (home != NONE))
            best = best[np.lexsort((ids[best], code[best]))]
            best = best[np.r_[True, code[best][1:] != code[best][:-1]][: len(best)]]
            i, sim, ids, home = i[best], sim[best], ids[best], home[best]
        for lo in range(0, len(i), 1 << 17):
            at = slice(lo, lo + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[i[at]]), pa.array(ids[at]), pa.array(sim[at]), pa.array(home[at], mask=home[at] == NONE)], ["query_id", "article_id", "sim", "story_id"])


def _array(buffer: pa.Buffer, kind: str) -> np.ndarray:
    return np.frombuffer(buffer, kind) if buffer.size else np.empty(0, kind)


def _unit(values: np.ndarray, width: int) -> np.ndarray:
    e = values.astype("<f8").reshape(-1, width) if width else np.empty((1, 0))
    return e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)


def _kind(rows: DataFrame) -> str:
    """How blocks hold a component: as it comes."""
    return "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def _placed(rows: DataFrame, days: float | None) -> DataFrame:
    """Rows with an embedding (and, with days, a time): id, at, embedding, bucket, width, and stories where there are some."""
    at = F.unix_micros(F.col("published_at").cast("timestamp"))
    bucket = F.lit(0).cast("long") if days is None else F.floor(at / (days * DAY))
    return rows.where("embedding IS NOT NULL").select("id", F.coalesce(at, F.lit(0)).alias("at"), "embedding", bucket.alias("bucket"), F.size("embedding").alias("width"), *[c for c in rows.columns if c == "stories"]).where("bucket IS NOT NULL")


def _blocks(rows: DataFrame, days: float | None, size: int) -> DataFrame:
    """rows(id, published_at, embedding, perhaps stories) -> bucket, width, and of at most `size` of its rows ids, times, vectors, and the number and list of stories, as bytes."""
    kind = _kind(rows)
    rows = _placed(rows, days)
    if kind == "<f8":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    if days is not None:
        rows = rows.repartitionByRange("bucket", "id").sortWithinPartitions("bucket")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for (k, width), part in b.groupby(["bucket", "width"]):
                for lo in range(0, len(part), size if width else 1):
                    some = part.iloc[lo : lo + (size if width else 1)]
                    e = np.array(some["embedding"].tolist(), kind).reshape(len(some), -1)
                    homes = [x if x is not None and len(x) else [NONE] for x in some["stories"]] if "stories" in some else [[NONE]] * len(some)
                    counts, flat = np.array([len(x) for x in homes], "<i4"), np.concatenate([np.asarray(x, "<i8") for x in homes])
                    out.append((k, width, some["id"].to_numpy("<i8").tobytes(), some["at"].to_numpy("<i8").tobytes(), e.tobytes(), counts.tobytes(), flat.tobytes()))
            yield pd.DataFrame(out, columns=["bucket", "width", "ids", "ats", "m", "counts", "homes"])

    return rows.mapInPandas(pack, "bucket long, width int, ids binary, ats binary, m binary, counts binary, homes binary")


def hashed_encoder(width: int = 384) -> Callable[[list[list[str]]], np.ndarray]:
    """A deterministic stand-in for a sentence encoder: signed hashed counts of tokens, of unit length."""
    import zlib

    def encode(texts: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(texts), width), np.float32)
        for row, tokens in zip(out, texts, strict=True):
            for t in tokens:
                h = zlib.crc32(t.encode())
                row[h % width] += 1.0 if h >> 31 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embed(rows: DataFrame, tokens: Column, encoder: Callable[[list[list[str]]], np.ndarray] | None = None, batch: int = 32) -> DataFrame:
    """rows(id, ...) -> id, embedding of their tokens, encoded in batches."""
    encode = encoder or hashed_encoder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.iloc[lo : lo + batch]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": list(encode([list(t) for t in part["tokens"]]))})

    return rows.select("id", tokens.alias("tokens")).mapInPandas(run, "id long, embedding array<float>")
