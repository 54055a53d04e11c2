"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A word's subwords are itself and the 2- to 4-grams of the word between marks.  A text is the mean of the embeddings of
all its words' subwords; as the output layer is linear, scoring adds up a table of embedding times output per subword,
once per distinct word.  Training takes a sample of labelled documents of expected size train_rows, drawn by hash, one
row of each doc_id (the smallest text), in one task; a tenth of it, whatever its size, is set aside to fit the softmax temperature and the level below which a prediction counts as
rejected (column accepted): the lowest confidence at which at most 1 % of the rows above it are wrong.

Defined cases: a null text and a text without a letter are `und` with score 0; very long texts are read whole; of equally
likely languages the first by name is predicted; null languages and rows without a doc_id are not learned from, and a null doc_id
has a null held_out; without labelled rows everything is
`und`; repeated rows are predicted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from storyweft.llm.common import crc, held_out, table

BUCKETS, DIM, CACHE = 1 << 15, 16, 200_000
LETTERS = re.compile(r"[^\W\d_]+")


def subwords(word: str) -> np.ndarray:
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1)]
    return np.array([crc(g) % BUCKETS for g in grams], np.int64)


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


class Model:
    def __init__(self, langs: list[str], emb: np.ndarray, out: np.ndarray, bias: np.ndarray, temperature: float = 1.0, least: float = 0.0) -> None:
        self.langs, self.bias, self.temperature, self.least = langs, bias, temperature, least
        self.table = (emb @ out).astype(np.float64)
        self.known: dict[str, int] = {}
        self.sums = np.zeros((1024, len(langs) + 1))

    def logits(self, found: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        rows = []
        for w in found:
            r = known.get(w)
            if r is None:
                r = known[w] = len(known)
                if r == len(self.sums):
                    self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
                i = subwords(w)
                self.sums[r, :-1], self.sums[r, -1] = self.table[i].sum(0), len(i)
            rows.append(r)
        total = self.sums[rows].sum(0)
        return total[:-1] / total[-1] + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        found = words(text)
        if not self.langs or not found or not any(c.isalpha() for w in found for c in w):
            return "und", 0.0, False
        x = self.logits(found) / self.temperature
        p = np.exp(x - x.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] >= self.least)


def fit(rows: list[tuple[np.ndarray, str, list[str]]], epochs: int = 3, rate: float = 0.5, seed: int = 1) -> Model:
    """rows: subword counts as (index, count) columns, language, words; a tenth calibrates."""
    langs = sorted({r[1] for r in rows})
    rng = np.random.default_rng(seed)
    emb, out, bias = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs))
    aside, learned = rows[::10], [r for k, r in enumerate(rows) if k % 10]
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for k in rng.permutation(len(learned)):
            x, lang, _ = learned[k]
            index, share = x[0], x[1] / x[1].sum()
            mean = share @ emb[index]
            p = mean @ out + bias
            p = np.exp(p - p.max())
            p /= p.sum()
            p[langs.index(lang)] -= 1
            back = out @ p
            out -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            emb[index] -= step * np.minimum(1.0, share * len(index))[:, None] * back
    model = Model(langs, emb, out, bias)
    tested = [(model.logits(found), langs.index(lang)) for _, lang, found in aside]

    def chances(t: float) -> np.ndarray:
        e = np.array([x for x, _ in tested]) / t
        e = np.exp(e - e.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    truth = np.array([y for _, y in tested])
    model.temperature = min((2.0**k for k in np.arange(-4, 4.25, 0.25)), key=lambda t: -np.log(chances(t)[np.arange(len(truth)), truth] + 1e-12).mean())
    p = chances(model.temperature)
    order = np.argsort(-p.max(1))
    wrong = np.cumsum((p.argmax(1) != truth)[order]) / np.arange(1, len(order) + 1)
    fine = np.nonzero(wrong <= 0.01)[0]
    model.least = float(p.max(1)[order][fine[-1]]) if len(fine) else 1.0
    return model


def train(docs: DataFrame, train_rows: int = 6000) -> dict | None:
    """The model's arrays, of a size fixed by BUCKETS, DIM and the number of languages; rows that held_out() keeps are not seen."""
    known = docs.where("lang IS NOT NULL").where(~held_out(F.col("doc_id")))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1 << 20))
    sample = known.where(draw < int((1 << 20) * min(1.0, train_rows / max(1, n)))).groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("doc_id", "r.text", "r.lang")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, cache = [], {}
        for b in batches:
            for i, text, lang in zip(b["doc_id"], b["text"], b["lang"], strict=True):
                if found := words(text):
                    index, count = np.unique(np.concatenate([cache[w] if w in cache else cache.setdefault(w, subwords(w)) for w in found]), return_counts=True)
                    rows.append((crc(str(i)), int(i), lang, len(found), index, count, list(dict.fromkeys(found))))
        rows.sort(key=lambda r: r[:4])
        if rows:
            m = fit([((index, count.astype(np.float64)), lang, found) for _, _, lang, _, index, count, found in rows])
            yield pd.DataFrame({"langs": [m.langs], "sums": [m.table.ravel()], "bias": [m.bias], "temperature": [m.temperature], "least": [m.least]})

    found = sample.repartition(1).mapInPandas(learn, "langs array<string>, sums array<double>, bias array<double>, temperature double, least double").collect()
    return found[0].asDict() if found else None


def identified(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score, accepted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value or {"langs": [], "sums": [], "bias": [], "temperature": 1.0, "least": 0.0}
        langs = list(m["langs"])
        model = Model(langs, np.zeros((1, 1)), np.zeros((1, len(langs))), np.array(m["bias"]), m["temperature"], m["least"])
        model.table = np.array(m["sums"]).reshape(-1, max(1, len(langs)))
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, accepted boolean")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
