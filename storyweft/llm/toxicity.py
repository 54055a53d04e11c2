"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes of words, pairs of neighbours and pairs with one or two words between them, over the
whole text.  Training takes a sample of labelled rows whose expected size is train_rows, drawn by hash, so that the one
task that runs the sequential updates holds a bounded number of rows.  Per-coordinate rates and L1 leave few non-zero
weights; at most 2**BITS of them go to the driver and are broadcast.  Scoring reads every whole text in Arrow batches.

Defined cases: a row without a doc_id is scored like any other, is not learned from, and has a null held_out; null and
empty texts get the score of the intercept; very long texts are scored whole; labels that are
null are not learned from; of the labels of one doc_id the toxic one counts, and of its texts the least one is learned
from, so repeated rows do not enlarge the sample; a score of exactly 0.5 is predicted toxic; without any labelled row
every score is 0; repeated rows are scored each; an empty table gives no rows; other columns are ignored, and ids,
languages and sources are never features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from storyweft.llm.common import crc, held_out, table

BITS = 18
HALF = 1 << BITS - 1  # words below, pairs from here on
TOKEN = re.compile(r"\w+")
CACHE = 200_000
#: Odd multipliers that keep the kinds of pairs apart: neighbours, one word between, two words between.
MIX = [(np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)), (np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)), (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))]


def str_of(x: pa.Scalar) -> str | None:
    return x.as_py()


class Features:
    """Hashes words once; a text's features are array operations on its words' hashes."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, hashes = self.words, []
        if len(known) > CACHE:
            known.clear()
        for w in TOKEN.findall((text or "").lower()):
            h = known.get(w)
            if h is None:
                h = known[w] = crc(w) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
            hashes.append(h)
        h = np.array(hashes, np.uint64)
        with np.errstate(over="ignore"):
            grams = [h[:0]] + [(h[: -1 - gap] * a + h[1 + gap :] * b) for gap, (a, b) in enumerate(MIX) if len(h) > 1 + gap]
            single, pairs = (np.unique((m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(65 - BITS)).astype(np.int64) for m in (h, np.concatenate(grams)))
        return np.concatenate([single, pairs + HALF])


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = 6, alpha: float = 3.0, beta: float = 1.0, l1: float = 20.0, l2: float = 0.0, positive: float = 2.0, pair_value: float = 0.3) -> np.ndarray:
    """Weights by FTRL-proximal, times the value that a feature has where it occurs: 1, or pair_value for pairs.

    The last one is the intercept, which is not regularised.  Gradients of toxic rows count positive times.
    """
    value = np.ones((1 << BITS) + 1)
    value[HALF:-1] = pair_value
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    penalty = np.full((1 << BITS) + 1, l1)
    penalty[-1] = 0.0
    rows = [(np.append(x, 1 << BITS), y) for x, y in rows]
    for _ in range(epochs):
        for x, y in rows:
            zx, nx, v = z[x], n[x], value[x]
            w = np.where(np.abs(zx) <= penalty[x], 0.0, -(zx - np.sign(zx) * penalty[x]) / ((beta + np.sqrt(nx)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip((w * v).sum(), -35, 35))) - y) * (positive if y else 1.0) * v
            z[x] += g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha * w
            n[x] += g * g
    return value * np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((beta + np.sqrt(n)) / alpha + l2))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 8000) -> list[tuple[int, float]]:
    """Non-zero weights by feature, at most 2**BITS + 1 of them; rows that held_out() keeps are not seen."""
    known = labels.where("toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20))
    sample = known.where(draw < int((1 << 20) * min(1.0, train_rows / max(1, n)))).join(docs.select("doc_id", "text"), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Features()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [f(t).astype(np.int32) for t in b["text"]]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted(((crc(str(i)), int(i), int(y), np.asarray(x, np.int64)) for b in batches for i, y, x in zip(b["doc_id"], b["y"], b["x"], strict=True)), key=lambda r: (*r[:3], len(r[3]), r[3].tobytes()))
        if rows:
            w = ftrl([(x, y) for *_, y, x in rows])
            (i,) = np.nonzero(w)
            i = np.union1d(i, [1 << BITS])
            yield pd.DataFrame({"i": i, "w": w[i]})

    found = sample.mapInPandas(featurize, "doc_id long, y int, x array<int>").repartition(1).mapInPandas(learn, "i long, w double").collect()
    return [(r.i, r.w) for r in found]


def scored(docs: DataFrame, weights: list[tuple[int, float]]) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, f = np.zeros((1 << BITS) + 1), Features()
        for i, x in sent.value:
            w[i] = x
        for b in batches:
            if sent.value:
                s = np.array([w[f(t)].sum() + w[-1] for t in map(str_of, b.column("text"))], np.float64)
                s = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            else:
                s = np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text)."""
    out = scored(docs, train(docs, labels, train_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = 8000) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns."""
    weights = train(docs, labels, train_rows)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, f = np.zeros((1 << BITS) + 1), Features()
        for i, x in sent.value:
            w[i] = x
        for b in batches:
            clean = [not sent.value or w[f(t)].sum() + w[-1] < 0 for t in map(str_of, b.column(at))]
            yield b.filter(pa.array(clean, pa.bool_()))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # so that any column name will do
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
