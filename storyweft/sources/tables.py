"""Checked CSV input and output, JSON reports, named views, seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from storyweft.operators.evaluation import gap_hints_daily, top_events_params_daily


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A CSV file with a header that has the required columns."""
    header = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in required if c not in header]:
        raise ValueError(f"columns are missing: {missing}")
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, key: str, rows: int) -> None:
    """Writes df, which has to have `rows` rows and no key twice."""
    found = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys")).first()
    if (found["n"], found["keys"]) != (rows, rows):
        raise ValueError(f"{found['n']} rows with {found['keys']} keys, but {rows} were to come")
    df.write.option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def named_views(frames: dict[str, DataFrame]) -> None:
    """Registers frames under their names."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


#: The names and addresses of the sources that a new table starts with.
SOURCES = [
    ("BBC News", "http://feeds.bbci.co.uk/news/rss.xml"),
    ("BBC World", "http://feeds.bbci.co.uk/news/world/rss.xml"),
    ("CNN Top", "http://rss.cnn.com/rss/edition.rss"),
    ("CNN World", "http://rss.cnn.com/rss/edition_world.rss"),
    ("NPR News", "https://feeds.npr.org/1001/rss.xml"),
    ("NYTimes Home", "https://rss.nytimes.com/services/xml/rss/nyt/HomePage.xml"),
    ("NYTimes World", "https://rss.nytimes.com/services/xml/rss/nyt/World.xml"),
    ("NYTimes US", "https://rss.nytimes.com/services/xml/rss/nyt/US.xml"),
    ("NYTimes Business", "https://rss.nytimes.com/services/xml/rss/nyt/Business.xml"),
    ("NYTimes Technology", "https://rss.nytimes.com/services/xml/rss/nyt/Technology.xml"),
    ("The Guardian World", "https://www.theguardian.com/world/rss"),
    ("The Guardian US", "https://www.theguardian.com/us-news/rss"),
    ("Al Jazeera", "https://www.aljazeera.com/xml/rss/all.xml"),
    ("Deutsche Welle", "https://rss.dw.com/rdf/rss-en-all"),
    ("Sky News World", "https://feeds.skynews.com/feeds/rss/world.xml"),
    ("ABC News Top", "https://abcnews.go.com/abcnews/topstories"),
    ("NBC News Top", "https://feeds.nbcnews.com/nbcnews/public/news"),
    ("Fox News Latest", "https://feeds.foxnews.com/foxnews/latest"),
    ("NYTimes Politics", "https://rss.nytimes.com/services/xml/rss/nyt/Politics.xml"),
    ("Washington Post Politics", "https://feeds.washingtonpost.com/rss/politics"),
    ("CNN US", "http://rss.cnn.com/rss/cnn_us.rss"),
    ("DW World (EN)", "https://rss.dw.com/rdf/rss-en-world"),
    ("France24 EN", "https://www.france24.com/en/rss"),
    ("Japan Times", "https://www.japantimes.co.jp/feed/"),
    ("PBS NewsHour Headlines", "https://www.pbs.org/newshour/feeds/rss/headlines"),
    ("Vox", "https://www.vox.com/rss/index.xml"),
    ("The Conversation Global Atom", "https://theconversation.com/global/articles.atom"),
    ("WSJ World News", "https://feeds.a.dj.com/rss/RSSWorldNews.xml"),
    ("WSJ US Business", "https://feeds.a.dj.com/rss/WSJcomUSBusiness.xml"),
    ("CNBC Top News", "https://www.cnbc.com/id/100003114/device/rss/rss.html"),
    ("CNBC World News", "https://www.cnbc.com/id/100727362/device/rss/rss.html"),
    ("NBC News World", "https://feeds.nbcnews.com/nbcnews/public/world"),
    ("CBS News World", "https://www.cbsnews.com/latest/rss/world"),
    ("ABC News World", "https://abcnews.go.com/abcnews/internationalheadlines"),
    ("Korea Times", "https://www.koreatimes.co.kr/www/rss/rss.xml"),
    ("Channel NewsAsia", "https://www.channelnewsasia.com/rssfeeds/8396082"),
    ("SCMP Top News", "https://www.scmp.com/rss/91/feed"),
    ("Al Jazeera English", "https://www.aljazeera.com/xml/rss/all.xml"),
    ("The Straits Times", "https://www.straitstimes.com/news/world/rss.xml"),
    ("Hong Kong Free Press", "https://hongkongfp.com/feed/"),
    ("BBC Chinese", "https://feeds.bbci.co.uk/zhongwen/simp/rss.xml"),
    ("FT Chinese", "https://www.ftchinese.com/rss/feed"),
]


def seed_sources(spark: SparkSession) -> DataFrame:
    """The fixed sources; one address stands there twice."""
    return spark.createDataFrame(SOURCES, "name string, url string")


def daily_views(logs: DataFrame) -> None:
    """logs(created_at, eval_type, metrics, params as JSON) as the views vw_gap_hints_daily and vw_top_events_params_daily."""
    named_views({"vw_gap_hints_daily": gap_hints_daily(logs).orderBy(F.col("day").desc()), "vw_top_events_params_daily": top_events_params_daily(logs).orderBy(F.col("day").desc())})


def seeded(table: DataFrame, seeds: DataFrame, key: str = "url") -> DataFrame:
    """Table and the seeds that it lacks."""
    return table.unionByName(seeds.dropDuplicates([key]).join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def seed_story(articles: DataFrame, story_id: int, n: int = 3) -> DataFrame:
    """Links of a first story to the n articles with the largest ids."""
    return articles.orderBy(F.col("article_id").desc()).limit(n).select(F.lit(story_id).cast("long").alias("story_id"), "article_id")


def mock_candidates(spark: SparkSession) -> DataFrame:
    """A few candidate pairs for a dry run without tables, one for each path of the judgement's rules and its grey zone."""
    rows = [
        (1, 2, 0.81, 7.0, ["quake", "japan"], 2, 3.0, 0.6),
        (3, 4, 0.60, 5.0, ["budget", "senate"], 3, 30.0, 0.3),
        (5, 6, 0.50, 2.0, ["world"], 9, 60.0, 0.1),
        (7, 8, 0.30, 2.0, ["storm"], 9, 60.0, 0.3),
    ]
    return spark.createDataFrame(rows, "a long, b long, score double, weight double, evidence array<string>, df_min long, hours double, title_jaccard double")
