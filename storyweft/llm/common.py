"""Helpers shared by the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from storyweft.sources.shared import saved, shared_dir  # noqa: F401  shared with the operators of this package

#: White space that separates words in the contracts of these operators.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def short_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """While tables of long texts are written through Python, Arrow batches have few rows, so that a batch stays some MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a folder that saved() wrote, through the store's own file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for rows kept from training: crc32 of the id's decimal text is divisible by folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))
