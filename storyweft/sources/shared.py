"""Tables in the folder that the cluster shares: intermediate results that outlive the executors that made them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Lists that new folders are noted in; see noted_dirs().
_notes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.  Where none is set, a local master gets a temporary one, and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-storyweft-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/storyweft-{uuid.uuid4().hex}"
    for note in _notes:
        note.append(path)
    return path


@contextmanager
def noted_dirs() -> Iterator[list[str]]:
    """The folders that shared_dir() names meanwhile, for a caller who knows when their last reader is done and removes them."""
    note: list[str] = []
    _notes.append(note)
    try:
        yield note
    finally:
        _notes.remove(note)


def saved(df: DataFrame, path: str) -> DataFrame:
    """Cuts lineage: writes the rows as Parquet in the shared folder and reads them again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder that saved() wrote, through the store's own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
