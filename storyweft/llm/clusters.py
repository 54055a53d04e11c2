"""Exact integer k-means: blocked matrix products assign vectors, treeAggregate sums them.

Vectors are packed once into blocks of `block` rows, saved in the shared folder.  A round assigns each block to the
centroids by |x|^2 - 2 x.c + |c|^2, where x.c is one matrix product in doubles as long as no term can reach 2**53; beyond
that bound the same expression runs in 64-bit integers, and beyond 2**63 in Python's integers, so every distance is exact.
The sums and counts of a round are combined by RDD.treeAggregate: a partition sends `k` rows of sums, never vectors, and
the driver sees k rows.  Sums stay Python integers where they could leave 64 bits.

Defined cases: only vectors of exactly `width` components take part, none of them null or not finite (a null embedding
does not); a vector with a null vec_id takes part and hashes like an empty id; of equal hashes the vector that is smaller,
component by component, starts first; repeated rows are vectors each; with fewer vectors than k there are fewer centroids;
ties of distance go to the smaller number; an empty table gives no rows; columns other than vec_id and embedding are
ignored; a component, distance or inertia that is no 64-bit integer is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from storyweft.llm.common import saved, shared_dir, table
from storyweft.llm.topk import blocked

FOUND = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_vectors(embeddings: DataFrame, width: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, v: array of floor(scale * component); only vectors that take part."""
    sound = embeddings.where(f"size(embedding) = {width} AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    whole = lambda x: F.when(F.abs(x) < 2.0**63, F.floor(x)).otherwise(F.raise_error(F.lit("a component leaves 64 bits")).cast("long"))
    return sound.select("vec_id", F.transform("embedding", lambda x: whole(x.cast("double") * scale)).alias("v"))


def start_order(vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit("1:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x (64-bit integers) to all rows of c (integers), exactly; 64-bit or Python integers."""
    most = (int(np.abs(x).max(initial=0)) + max((abs(int(v)) for v in c.flat), default=0)) ** 2 * max(1, x.shape[1])
    kind = np.float64 if 4 * most < 1 << 53 else np.int64 if 4 * most < 1 << 63 else object
    a, b = x.astype(kind), c.astype(kind)
    out = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    return out if kind is object else out.astype(np.int64)


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of every row; argmin takes the first of equal ones."""
    d = distances(x, c)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def block_rows(kind: str, width: int, m: bytes) -> np.ndarray:
    return np.frombuffer(m, kind).reshape(-1, width).astype(np.int64)


def add_block(acc: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """acc (sums by centroid, counts, inertia by centroid) and the rows of x at their nearest centroids."""
    at, d = nearest_centroid(x, c)
    big = int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62 or d.dtype == object or int(d.max(initial=0)) * len(x) >= 1 << 62
    values, far = (x.astype(object), d.astype(object)) if big else (x, d)
    sums, counts, inertia = (a.copy() for a in acc)
    for k in np.unique(at):
        own = at == k
        sums[k] += np.array([int(v) for v in values[own].sum(0)], object)
        counts[k] += int(own.sum())
        inertia[k] += int(far[own].sum())
    return sums, counts, inertia


def gathered(blocks: DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, counts and inertia by centroid over all blocks, as Python integers, combined as a tree."""
    zero = np.zeros(c.shape, object), np.zeros(len(c), object), np.zeros(len(c), object)
    return blocks.select("kind", "width", "m").rdd.treeAggregate(zero, lambda acc, r: add_block(acc, block_rows(r["kind"], r["width"], r["m"]), c), lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)))


def moved(c: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The floors of the means; a centroid without vectors stays."""
    return np.array([[int(v) // n for v in s] if n else list(old) for old, s, n in zip(c, sums, counts, strict=True)], object).reshape(c.shape)


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, block: int = 4096, width: int = 64) -> DataFrame:
    """vectors(vec_id, v of width integers) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    first = vectors.orderBy(start_order(F.col("vec_id")), "v").limit(k).select("v").collect()  # k rows
    c = np.array([r["v"] for r in first], object).reshape(-1, width)
    if not len(c):
        return spark.createDataFrame([], FOUND)
    blocks = saved(blocked(vectors, block), f"{shared_dir(spark)}/vectors")
    for _ in range(rounds):
        sums, counts, _ = gathered(blocks, c)
        c = moved(c, sums, counts)
    inertia = [int(x) for x in gathered(blocks, c)[2]]
    digests = [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in c]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FOUND.split(", ")]
        for b in batches:
            for r in b.to_pylist():
                at, d = nearest_centroid(block_rows(r["kind"], r["width"], r["m"]), c)
                columns = [r["ids"], at, [int(x) for x in d], [inertia[k] for k in at], [sum(inertia)] * len(at), [digests[k] for k in at]]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

    return blocks.mapInArrow(assign, FOUND)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(whole_vectors(table(spark, sf_dir, "embeddings")))


def _assign_sql(k: int) -> str:
    """Assignment k (a) to the centroids before it, and the centroids after it (c)."""
    return f"""
p{k} AS (SELECT r, n, c, CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{k}),
a{k} AS (SELECT r, any_value(n) AS n, min(struct_pack(d := d, c := c)) AS b FROM p{k} GROUP BY r),
s{k} AS (SELECT b.c AS c, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM a{k} JOIN v USING (r), unnest(range(1, 65)) AS t(i) GROUP BY ALL),
c{k + 1} AS (SELECT c{k}.c AS c, coalesce(g.m, c{k}.m) AS m FROM c{k} LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM s{k} GROUP BY c) g ON g.c = c{k}.c),"""


OP13_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id AS n, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(n AS VARCHAR), '')), v) - 1 AS INT) AS c, v AS m FROM v QUALIFY c < 16),{"".join(map(_assign_sql, range(3)))}
p3 AS (SELECT r, n, c, CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c3),
a3 AS (SELECT r, any_value(n) AS n, min(struct_pack(d := d, c := c)) AS b FROM p3 GROUP BY r)
SELECT n AS vec_id, b.c AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.c = b.c
"""
