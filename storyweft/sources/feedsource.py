"""S01, S05 as a Spark data source: `spark.read.format("storyweft_feeds")`, and the same as a stream.

Sources are a folder of feed files, or a JSON list of {"name", "url"}; a url is a path, a file: or a http(s): address.
Every source is a partition, so they are fetched side by side, and one that cannot be read or parsed is a row with an
error, not the end of the query.  A partition yields its entries, of RSS or Atom, in the order of the feed, at most `limit`;
a source without entries yields one row without a url, so that feed_health() sees each source.
"""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request
from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

NAME = "storyweft_feeds"
SCHEMA = "feed string, position int, title string, url string, summary string, published_at timestamp_ntz, broken boolean, http_status int, error string"
Entry = tuple


def when(text: str | None) -> datetime | None:
    """RFC 2822, else ISO 8601, in UTC without zone; else null."""
    for parse in (parsedate_to_datetime, lambda t: datetime.fromisoformat(t.strip())):
        try:
            at = parse(text or "")
        except (TypeError, ValueError, IndexError):
            continue
        return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at
    return None


def entries(raw: bytes, limit: int) -> Iterator[tuple[str | None, str | None, str, datetime | None, bool]]:
    """(title, url, summary, time, broken) of the items of an RSS feed or the entries of an Atom feed, whatever their namespace."""
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    found = [e for e in ElementTree.fromstring(raw).iter() if name(e) in ("item", "entry")]
    for e in found[:limit]:
        parts: dict[str, str] = {}
        links = []
        for c in e:
            if name(c) == "link":
                links.append((c.get("rel") in (None, "alternate"), (c.get("href") or c.text or "").strip()))
            elif (c.text or "").strip():
                parts.setdefault(name(c), "".join(c.itertext()).strip())
        url = next((u for alternate, u in links if alternate), links[0][1] if links else None)
        at = next((t for k in ("pubDate", "published", "updated") if (t := when(parts.get(k)))), None)
        yield parts.get("title"), url, next((parts[k] for k in ("description", "summary", "content") if k in parts), ""), at, "title" not in parts and not links


def fetched(url: str, seconds: float) -> tuple[bytes, int | None]:
    if url.startswith(("http://", "https://")):
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "storyweft"}), timeout=seconds) as r:  # noqa: S310
            return r.read(), r.status
    with open(url.removeprefix("file://"), "rb") as f:
        return f.read(), None


class FeedPartition(InputPartition):
    def __init__(self, feed: str, url: str) -> None:
        self.feed, self.url = feed, url


def sources_of(options: dict) -> list[FeedPartition]:
    if "sources" in options:
        return [FeedPartition(s.get("name") or s["url"], s["url"]) for s in json.loads(options["sources"])]
    if "path" not in options:
        raise ValueError(f"{NAME} needs path, a folder of feed files, or sources, a JSON list of name and url")
    top = options["path"].removeprefix("file://")
    names = sorted(n for n in os.listdir(top) if not n.startswith((".", "_"))) if os.path.isdir(top) else [""]
    return [FeedPartition(n or os.path.basename(top), os.path.join(top, n) if n else top) for n in names]


class FeedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.limit, self.seconds = dict(options), int(options.get("limit", 50)), float(options.get("timeout", 20))

    def partitions(self) -> list[FeedPartition]:
        return sources_of(self.options)

    def read(self, partition: FeedPartition) -> Iterator[Entry]:
        return self.rows(partition)[0]

    def rows(self, p: FeedPartition) -> tuple[Iterator[Entry], str]:
        """The rows of a source, and a digest of what was fetched."""
        status, digest = None, ""
        try:
            raw, status = fetched(p.url, self.seconds)
            digest = hashlib.sha256(raw).hexdigest()
            found = list(entries(raw, self.limit))
        except Exception as e:  # noqa: BLE001  whatever a source does wrong is an error of this source alone
            return iter([(p.feed, None, None, None, None, None, True, getattr(e, "code", status), f"{type(e).__name__}: {e}"[:500])]), digest
        out = [(p.feed, k + 1, title, url, summary, at, broken, status, None) for k, (title, url, summary, at, broken) in enumerate(found)]
        return iter(out or [(p.feed, None, None, None, None, None, False, status, None)]), digest


class FeedStreamReader(SimpleDataSourceStreamReader):
    """A poll is a batch.  The offset holds the digest of every source as it was read last, so that only changed ones come again.

    The reader keeps the rows of a poll until it is committed; a batch that has to be repeated after a restart is read
    from the sources as they are now, and entries that came before are left to new_entries().
    """

    def __init__(self, options: dict) -> None:
        self.reader = FeedReader(options)

    def initialOffset(self) -> dict:
        return {"seen": {}, "polls": 0}

    def read(self, start: dict) -> tuple[Iterator[Entry], dict]:
        seen, out = dict(start["seen"]), []
        for p in self.reader.partitions():
            rows, digest = self.reader.rows(p)
            if not digest or seen.get(p.feed) != digest:
                out += list(rows)
                seen[p.feed] = digest
        same = seen == start["seen"]
        return iter([] if same else out), start if same else {"seen": seen, "polls": start["polls"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[Entry]:
        changed = {f for f, digest in end["seen"].items() if start["seen"].get(f) != digest}
        return iter([r for p in self.reader.partitions() if p.feed in changed for r in self.reader.rows(p)[0]])

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def simpleStreamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)


def source_health(rows: DataFrame) -> DataFrame:
    """Per source, entries, broken ones, and a status: FAILED with its error, EMPTY, or OK."""
    per = rows.groupBy("feed").agg(F.count("position").alias("entries"), F.count_if(F.col("broken") & F.col("position").isNotNull()).alias("broken_entries"), F.max("http_status").alias("http_status"), F.max("error").alias("error"))
    failed = F.col("error").isNotNull() | (F.coalesce("http_status", F.lit(0)) >= 400)
    return per.withColumn("status", F.when(failed, "FAILED").when(F.col("entries") == 0, "EMPTY").otherwise("OK"))
