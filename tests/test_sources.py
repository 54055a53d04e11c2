from datetime import datetime

import pytest

from storyweft.operators import listing, merging
from storyweft.sources import tables


def test_csv_checks(spark, tmp_path):
    (tmp_path / "in.csv").write_text("query_article_id,true_story_id,note\n60,58,x\n32,58,\n")
    df = tables.read_csv(spark, f"{tmp_path}/in.csv", "query_article_id int, true_story_id int, note string", ["query_article_id", "true_story_id"])
    assert [tuple(r) for r in df.collect()] == [(60, 58, "x"), (32, 58, None)]
    with pytest.raises(ValueError):
        tables.read_csv(spark, f"{tmp_path}/in.csv", "a int", ["absent"])
    tables.write_csv(df, f"{tmp_path}/out", "query_article_id", 2)
    for key, rows in (("true_story_id", 2), ("query_article_id", 3)):
        with pytest.raises(ValueError):
            tables.write_csv(df, f"{tmp_path}/bad", key, rows)
    tables.write_report(df, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 2
    tables.named_views({"labels_view": df})
    assert spark.sql("SELECT count(*) FROM labels_view").first()[0] == 2


def test_seeds(spark):
    old = spark.createDataFrame([("A", "u1")], "name string, url string")
    new = spark.createDataFrame([("A2", "u1"), ("B", "u2")], "name string, url string")
    assert sorted(r.url for r in tables.seeded(old, new).collect()) == ["u1", "u2"]
    a = spark.createDataFrame([(i,) for i in range(5)], "article_id long")
    assert sorted(r.article_id for r in tables.seed_story(a, 1).collect()) == [2, 3, 4]


def test_lists(spark):
    stories = spark.createDataFrame([(1,), (2,)], "story_id long")
    links = spark.createDataFrame([(1, 10), (1, 11)], "story_id long, article_id long")
    assert [(r.story_id, r.articles_count) for r in listing.list_stories(stories, links).collect()] == [(2, 0), (1, 2)]
    cache = spark.createDataFrame([(1, "ERROR", None, "e", datetime(2024, 1, 1)), (1, "SUCCESS", "{}", None, datetime(2024, 1, 2))], "story_id long, status string, output_json string, error string, updated_at timestamp_ntz")
    assert {r.story_id: r.status for r in listing.latest_output(stories, cache).collect()} == {1: "SUCCESS", 2: "MISSING"}


def test_pairs_by_title_where_signatures_do_not_meet(spark):
    rows = [(1, "quake in japan", datetime(2024, 1, 1), ["a"]), (2, "quake hits japan", datetime(2024, 1, 2), ["b"]), (3, "quake in japan", datetime(2024, 2, 1), ["c"]), (4, "budget", datetime(2024, 1, 2), [])]
    df = spark.createDataFrame(rows, "story_id long, title string, ts timestamp_ntz, signature array<string>")
    got = merging.merge_candidates(df).collect()
    assert [(r.a, r.b, r.df_min) for r in got] == [(2, 1, None)]
    assert merging.merge_candidates(df, fallback=False).count() == 0
