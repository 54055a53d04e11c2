"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are dealt to `slices` lists; a candidate's score is the sum of its entries in the lists.
1. Every block of vectors gives each query's best k entries of every list.  Only the union of those entries is scored
   exactly; the k-th best of these scores is a cutoff that no answer can fall below.
2. The cutoffs go to every block.  An answer has an entry of at least cutoff / slices in some list (were all below, so
   would be their sum); blocks collect just those entries.
3. Their scores are resolved exactly, those under the cutoff are dropped, and a block gives its best k to the merge.

Vectors and queries are packed into blocks of `block` rows.  A row of the join is one block of queries with one block of
vectors: blocks of queries are copied to `groups` groups of blocks of vectors and meet them there, so nothing passes
through the driver and no task holds more than two blocks.  Scores are integers; they are computed in doubles where every sum
is below 2**53, else in 64-bit integers, else in Python integers, so they are exact (a score that is no 64-bit integer
is an error).

Defined cases: vectors that are null, or hold null or non-finite components, take no part, as queries or candidates;
vectors of different lengths score over the components both have; ties go to the smaller vec_id; repeated rows are
candidates each, and queries each; an empty table gives no rows; other columns are ignored.  A query's own row is left
out at the end: lists of k + 1 are merged, and one entry with the query's id and its score with itself goes, if there is
one.  Which of several such rows it stands for makes no difference to the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from storyweft.llm.common import saved, shared_dir, table

FOUND = "query_row long, query_id long, vec_id long, score long, own long"
#: The cutoff of a query with fewer than k candidates.
LEAST = -(1 << 62)


def matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        n = min(width, len(v))
        row[:n] = v[:n]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exactly."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.array(exact, np.int64) if exact.size else np.zeros(exact.shape, np.int64)


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: array of floor(scale * component); only vectors that take part."""
    sound = embeddings.where("embedding IS NOT NULL AND vec_id IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    return sound.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


BLOCKS = "first long, width int, ids array<long>, kind string, m binary"
BLOCKS_SCHEMA = pa.schema([("first", pa.int64()), ("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("kind", pa.string()), ("m", pa.binary())])


def blocked(vectors: DataFrame, rows: int) -> DataFrame:
    """vectors(vec_id, v) -> blocks of at most `rows` rows: a number of the first row, ids, and the matrix as bytes of its smallest sufficient kind, padded with zeros.

    Numbers are different for all rows of one run, so they hold once the blocks are saved.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo in range(0, len(b), rows):
                part = b.slice(lo, rows)
                lists = [x.values.to_numpy(zero_copy_only=False) for x in part.column(1)]
                m = matrix(lists, max(map(len, lists)))
                kind = next(t for t in ("<i2", "<i4", "<i8") if m.size == 0 or np.iinfo(t).min <= m.min() and m.max() <= np.iinfo(t).max)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([first], [m.shape[1]], [part.column(0).to_pylist()], [kind], [m.astype(kind).tobytes()]), BLOCKS_SCHEMA.types, strict=True)], schema=BLOCKS_SCHEMA)
                first += len(part)

    return vectors.select("vec_id", "v").mapInArrow(pack, BLOCKS)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(query rows with ids and scores with themselves, queries, vector ids, vectors, cutoffs) of each row, which is two blocks; with the components both have."""
    for b in batches:
        for k in range(len(b)):
            row = {name: column[k] for name, column in zip(b.schema.names, b.columns, strict=True)}
            n, width = [len(row[c]) for c in ("q_ids", "ids")], [row[c].as_py() for c in ("q_width", "width")]
            q, m = (np.frombuffer(row[c].as_buffer(), row[t].as_py()).reshape(h, w).astype(np.int64) for c, t, h, w in zip(("q", "m"), ("q_kind", "kind"), n, width, strict=True))
            asked = np.stack([row["q_first"].as_py() + np.arange(n[0]), row["q_ids"].values.to_numpy(), resolved(q, q)])
            q, m = q[:, : min(width)], m[:, : min(width)]
            yield asked, q, row["ids"].values.to_numpy(), m, row["cuts"].values.to_numpy() if "cuts" in row else None


def _lists(width: int, slices: int) -> list[slice]:
    bounds = np.linspace(0, width, min(slices, max(1, width)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def leading_entries(q: np.ndarray, m: np.ndarray, k: int, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: (query, vector) of each list's k largest entries, in row numbers; a list is one query's products over a slice."""
    some = np.zeros((len(q), len(m)), bool)
    n = min(k, len(m))
    for s in _lists(q.shape[1], slices):
        part = products(q[:, s], m[:, s]).astype(np.float64)  # only orders the entries
        np.put_along_axis(some, np.argpartition(-part, n - 1, axis=1)[:, :n], True, 1)
    return np.nonzero(some)


def sufficient_entries(q: np.ndarray, m: np.ndarray, cut: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 2: (query, vector) with an entry of cutoff / slices or more in some list."""
    lists = _lists(q.shape[1], slices)
    share = -((-cut) // len(lists))  # the least integer that is not under cutoff / slices
    some = np.zeros((len(q), len(m)), bool)
    for s in lists:
        some |= products(q[:, s], m[:, s]) >= share[:, None]
    return np.nonzero(some)


def _best(asked: np.ndarray, vec: np.ndarray, score: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> pa.RecordBatch:
    """Each query's k highest scores, ties to smaller ids."""
    order = np.lexsort((vec[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    top = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (asked[0, i[top]], asked[1, i[top]], vec[j[top]], score[top], asked[2, i[top]])], [c.split()[0] for c in FOUND.split(", ")])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, slices: int = 4, block: int = 2048) -> DataFrame:
    """vectors(vec_id, v), queries(vec_id, v), which are rows of vectors: integer vectors -> query_id, rank, vec_id, score."""
    k += 1  # a query's own row is among the vectors
    spark = vectors.sparkSession
    work = shared_dir(spark)
    of_vectors, of_queries = saved(blocked(vectors, block), f"{work}/vectors"), saved(blocked(queries, block), f"{work}/queries")
    n = of_vectors.count()
    groups = max(1, min(n, max(spark.sparkContext.defaultParallelism, n // 64)))
    each = of_vectors.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    asked = of_queries.select(F.col("first").alias("q_first"), F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("m").alias("q"))

    def meeting(asked: DataFrame) -> DataFrame:
        return each.join(asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), "group").drop("group", "first")

    def local_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, q, vec, m, _ in _met(batches):
            i, j = leading_entries(q, m, k, slices)
            yield _best(asked, vec, resolved(q[i], m[j]), i, j, k)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, q, vec, m, cut in _met(batches):
            i, j = sufficient_entries(q, m, cut, slices)
            score = np.concatenate([resolved(q[i[lo : lo + (1 << 16)]], m[j[lo : lo + (1 << 16)]]) for lo in range(0, max(1, len(i)), 1 << 16)])
            enough = score >= cut[i]
            yield _best(asked, vec, score[enough], i[enough], j[enough], k)

    order = W.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    cutoffs = meeting(asked).mapInArrow(local_lists, FOUND).withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("query_row", F.col("score").alias("cut"))
    places = asked.select("q_first", F.posexplode("q_ids").alias("at", "query_id")).select("q_first", "at", (F.col("q_first") + F.col("at")).alias("query_row"))
    cuts = places.join(cutoffs, "query_row", "left").groupBy("q_first").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("cut", F.lit(LEAST)).alias("cut")))).alias("c"))
    cuts = saved(cuts.select("q_first", F.col("c.cut").alias("cuts")), f"{work}/cutoffs")
    out = meeting(asked.join(cuts, "q_first")).mapInArrow(resolve, FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("rank"))).over(W.partitionBy("query_row"))
    out = out.withColumn("mine", F.coalesce(own, F.lit(k + 1))).where("rank <> mine").withColumn("rank", F.when(F.col("rank") > F.col("mine"), F.col("rank") - 1).otherwise(F.col("rank")))
    return out.where(F.col("rank") < k).select("query_id", "rank", "vec_id", "score")


def resolved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, exactly."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 63:
        return np.einsum("ij,ij->i", a, b)
    return np.array([sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for r, s in zip(a, b, strict=True)], np.int64)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
