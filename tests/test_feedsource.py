import json
from datetime import datetime

import pytest

from storyweft.sources import feedsource as fs
from storyweft.sources.feeds import new_entries

RSS = """<rss version="2.0"><channel><title>c</title>
<item><title> One </title><link>http://x/1</link><description>first</description><pubDate>Tue, 02 Jan 2024 10:00:00 +0200</pubDate></item>
<item><title>Two &amp; more</title><link>http://x/2</link><pubDate>no time</pubDate></item>
<item><guid>3</guid></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>c</title><entry><title>A</title><link rel="self" href="http://y/self"/><link href="http://y/1"/>
<updated>2024-01-02T10:00:00Z</updated><summary type="html">s</summary></entry></feed>"""


@pytest.fixture
def feeds(spark, tmp_path):
    fs.register(spark)
    top = tmp_path / "feeds"
    top.mkdir()
    (top / "a.xml").write_text(RSS)
    (top / "b.xml").write_text("<rss><channel><item>")
    (top / "c.xml").write_text(ATOM)
    (top / "d.xml").write_text("<rss><channel></channel></rss>")
    return top


def test_one_broken_source_of_several(spark, feeds):
    df = spark.read.format(fs.NAME).load(str(feeds))
    assert df.rdd.getNumPartitions() == 4
    got = {(r.feed, r.position): r for r in df.collect()}
    assert set(got) == {("a.xml", 1), ("a.xml", 2), ("a.xml", 3), ("b.xml", None), ("c.xml", 1), ("d.xml", None)}
    one, two, atom = got["a.xml", 1], got["a.xml", 2], got["c.xml", 1]
    assert (one.title, one.url, one.summary, one.published_at) == ("One", "http://x/1", "first", datetime(2024, 1, 2, 8))
    assert (two.title, two.published_at, got["a.xml", 3].broken) == ("Two & more", None, True)
    assert (atom.url, atom.published_at, atom.summary) == ("http://y/1", datetime(2024, 1, 2, 10), "s")
    health = {r.feed: (r.entries, r.broken_entries, r.status) for r in fs.source_health(df).collect()}
    assert health == {"a.xml": (3, 1, "OK"), "b.xml": (0, 0, "FAILED"), "c.xml": (1, 0, "OK"), "d.xml": (0, 0, "EMPTY")}
    known = spark.createDataFrame([("http://x/2",)], "url string")
    assert sorted(r.url for r in new_entries(df.where("url IS NOT NULL"), known).collect()) == ["http://x/1", "http://y/1"]


def test_named_sources_and_limit(spark, feeds):
    named = json.dumps([{"name": "A", "url": f"file://{feeds}/a.xml"}, {"name": "gone", "url": f"{feeds}/none.xml"}])
    df = spark.read.format(fs.NAME).option("sources", named).option("limit", 2).load()
    assert sorted((r.feed, r.position or 0, bool(r.error)) for r in df.collect()) == [("A", 1, False), ("A", 2, False), ("gone", 0, True)]
    with pytest.raises(Exception, match="needs path"):
        spark.read.format(fs.NAME).load().count()


def test_a_stream_reads_what_changed(spark, feeds, tmp_path):
    seen = []

    def poll():
        seen.clear()
        q = spark.readStream.format(fs.NAME).load(str(feeds)).writeStream.option("checkpointLocation", f"{tmp_path}/c")
        q = q.foreachBatch(lambda df, n: seen.append((n, sorted((r.feed, r.position or 0) for r in df.collect())))).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return [x for _, rows in seen for x in rows]

    assert poll() == [("a.xml", 1), ("a.xml", 2), ("a.xml", 3), ("b.xml", 0), ("c.xml", 1), ("d.xml", 0)]
    assert poll() == []
    (feeds / "d.xml").write_text(RSS)
    assert poll() == [("d.xml", 1), ("d.xml", 2), ("d.xml", 3)]
