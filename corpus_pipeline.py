"""The training-data pipeline: stages over the documents table, each written as Parquet and read again by the next.

Every stage takes null texts and ids, repeated rows, very long texts, an empty table and further columns of any name; what
becomes of them is said with each stage, ties in the operator's own docstring.  All but the last return the columns of
their input.  As a stage's result is written before the next one runs, a stage begins by removing what the one before it
kept in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from storyweft.llm.common import saved, shared_dir, short_batches, table
from storyweft.llm.jaccard import one_of_each
from storyweft.llm.lines import line_deduplicated
from storyweft.llm.mixing import mixed_documents
from storyweft.llm.packing import best_fit_packing
from storyweft.llm.toxicity import without_toxic
from storyweft.sources.shared import noted_dirs, removed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders of the stage that ran last.
_kept: list[str] = []


def _clear(spark: SparkSession) -> None:
    while _kept:
        removed(spark, _kept.pop())


def in_order(stage: Stage) -> Stage:
    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clear(spark)
        with noted_dirs() as made:
            out = stage(spark, docs, sf_dir)
        _kept.extend(made)
        return out

    return begun


@in_order
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go.

    Whole texts go through Python here, so they are written while the session's Arrow batches are short.
    A null or empty text is judged by the intercept; every repeated row is judged alike; without labels all stay.
    """
    with short_batches(spark):
        return saved(without_toxic(docs, table(spark, sf_dir, "labels")), shared_dir(spark))


@in_order
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go, but for their first document; every document stays.

    A null text stays null; a text of dropped lines alone becomes empty; exact copies of a text count once.
    """
    return line_deduplicated(docs)


@in_order
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id (null last).

    Texts without a word are nobody's duplicates and all stay; different texts of one doc_id are judged apart.
    """
    return one_of_each(docs)


@in_order
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets; a document that is drawn twice comes twice.

    A null source is a source of its own; a document without a word has nothing to take and is not in the mix; the
    one document at which a source's last pass ends is cut at a word.
    """
    return mixed_documents(docs)


@in_order
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' token pieces in the training sequences.

    Every row is tokenised, a document that comes twice twice; longer texts than a sequence are cut into pieces.
    """
    return best_fit_packing(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("mixing", mixing), ("packing", packing)]

#: The classifier and the hash-seeded mix are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"{work}/{k}-{name}")
        if k:
            removed(spark, f"{work}/{k - 1}-{STAGES[k - 1][0]}")
    _clear(spark)
    return docs
