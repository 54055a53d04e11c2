"""Tables without transactions: insert-ignore, upsert, keyed update, cache states, latest row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def first_of(batch: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of every non-empty key, in feed order."""
    rn = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return batch.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def insert_ignore(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """The rows of new whose key is not in old."""
    return new.join(old.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same keys."""
    return old.join(new, keys, "left_anti").unionByName(new)


def keyed_update(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The columns of changes, where they are not null, replace those of target."""
    changed = [c for c in changes.columns if c != key]
    out = target.alias("t").join(changes.alias("c"), key, "left")
    return out.select(*[F.coalesce(f"c.{c}", f"t.{c}").alias(c) if c in changed else (F.col(c) if c == key else F.col(f"t.{c}")) for c in target.columns])


def latest(rows: DataFrame, keys: list[str], at: str, *ties: Column) -> DataFrame:
    """The latest row of every key."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), *ties))
    return rows.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def cache_action(status: Column, updated_at: Column, now: Column, refresh_days: float = 2.0, retry_seconds: float = 90.0) -> Column:
    """What to do with a cached title: USE, USE_AND_REFRESH, SKIP or REFRESH."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(updated_at.cast("timestamp"))) / F.lit(1e6)
    return (
        F.when((status == "SUCCESS") & ~F.coalesce(age >= refresh_days * 86400, F.lit(False)), "USE")
        .when(status == "SUCCESS", "USE_AND_REFRESH")
        .when((status == "PENDING") & (age < retry_seconds), "SKIP")
        .otherwise("REFRESH")
    )


def prompt_titles(titles: Column, most: int = 6, length: int = 160, seed: int = 0) -> Column:
    """Squeezed, distinct regardless of case, cut titles, in the given order; of more than `most`, a sample.

    The sample is drawn by a seeded hash, so the same titles give the same prompt.
    """
    clean = F.filter(F.transform(titles, lambda t: F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, length)), lambda t: t != "")
    firsts = F.filter(clean, lambda t: t.isNotNull())
    once = F.filter(firsts, lambda t, i: F.array_position(F.transform(firsts, F.lower), F.lower(t)) == i + 1)
    drawn = lambda all_: F.slice(F.array_sort(F.transform(all_, lambda t: F.struct(F.xxhash64(F.lit(seed), t).alias("h"), t.alias("t")))), 1, most)
    sample = lambda all_: F.filter(all_, lambda t: F.exists(drawn(all_), lambda x: x["t"] == t))
    return F.get(F.transform(F.array(once), lambda all_: F.when(F.size(all_) <= most, all_).otherwise(sample(all_))), F.lit(0))


def with_column_if_missing(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Adds a null column where the table does not have it yet."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))
