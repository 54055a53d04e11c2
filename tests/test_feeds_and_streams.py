from datetime import datetime

from pyspark.sql import functions as F

from storyweft.sources import feeds
from storyweft.streaming import ingest


def test_feed(spark, tmp_path):
    item = "<item><title>{}</title><link>{}</link><description>d</description><pubDate>Mon, 01 Jan 2024 10:00:00 {}</pubDate></item>"
    xml = "<rss><channel>" + item.format("A", "u1", "+0100") + item.format("B", "u1", "GMT") + item.format("C", "u2", "GMT") + "</channel></rss>"
    (tmp_path / "f.xml").write_text(xml)
    rows = feeds.read_feed(spark, str(tmp_path / "f.xml"))
    known = spark.createDataFrame([("u2",)], "url string")
    got = feeds.new_entries(rows, known).collect()
    assert [(r.title, r.url, r.published_at) for r in got] == [("A", "u1", datetime(2024, 1, 1, 9))]
    assert feeds.feed_health(rows).first().entries == 3


def test_stream_drops_repeats_and_goes_on_from_its_checkpoint(spark, tmp_path):
    src, seen = str(tmp_path / "src"), []
    spark.createDataFrame([("u1", datetime(2024, 1, 1)), ("u1", datetime(2024, 1, 1, 1)), ("u2", datetime(2024, 1, 1))], "url string, published_at timestamp_ntz").coalesce(1).write.parquet(src)
    rows = ingest.article_stream(spark, src, "url string, published_at timestamp_ntz")
    for _ in range(2):
        ingest.run_available(rows.select("url"), str(tmp_path / "cp"), lambda df, _: seen.extend(r.url for r in df.collect()))
    assert sorted(seen) == ["u1", "u2"]
    counted = ingest.windowed_counts(spark.read.parquet(src).withColumn("published_at", F.col("published_at").cast("timestamp")), "url", "published_at")
    assert sorted((r.url, r.n) for r in counted.collect()) == [("u1", 2), ("u2", 1)]


def test_entries_keep_the_order_of_each_of_several_files(spark, tmp_path):
    for f, n in (("a", 30), ("b", 70), ("c", 1)):
        items = "".join(f"<item><title>{f}{k}</title><link>http://{f}/{k}</link></item>" for k in range(n))
        (tmp_path / f"{f}.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    got = {}
    for r in feeds.read_feed(spark, str(tmp_path)).collect():
        got.setdefault(r.feed.rsplit("/", 1)[-1], {})[r.position] = r.title
    assert got == {f"{f}.xml": {k + 1: f"{f}{k}" for k in range(min(n, 50))} for f, n in (("a", 30), ("b", 70), ("c", 1))}


def test_long_urls_are_cut_after_the_first_dedup(spark):
    long = "http://x/" + "y" * 1200
    rows = [(long + "1", 1, "t" * 600, "s" * 3000), (long + "2", 2, "second", ""), (long + "1", 3, "again", ""), ("http://z", 4, "z", "")]
    entries = spark.createDataFrame(rows, "url string, position int, title string, summary string")
    none = spark.createDataFrame([], "url string")
    got = {r.url: (r.position, len(r.title), len(r.summary)) for r in feeds.new_entries(entries, none).collect()}
    assert got == {long[:1000]: (1, 500, 2000), "http://z": (4, 1, 0)}
    assert [r.url for r in feeds.new_entries(entries, spark.createDataFrame([(long[:1000],)], "url string")).collect()] == ["http://z"]
