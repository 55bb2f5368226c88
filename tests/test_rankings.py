import datetime as dt

import pytest
from pyspark.sql import functions as F

from civicpulse.operators.news import dedupe_articles
from civicpulse.operators.posts import only_wanted, top_posts
from civicpulse.operators.topk import keep_last, preview, top_queries, top_regions

POSTS = (
    "topic string, created_at timestamp, day date, month string, author string, text string, "
    "likes long, reposts long, replies long"
)


def post(day, author, likes, topic="HS2", month="December 2025"):
    at = dt.datetime(2025, 12, day, 9, 30)
    return (topic, at, at.date(), month, author, "text", likes, 0, 0)


def test_posts_of_the_day_then_of_the_month(rows):
    posts = rows.make(POSTS, post(1, "a", 5), post(1, "b", 9), post(2, "c", 7), post(3, "x", 1, topic="S"))
    requests = rows.make("topic string, day date", ("HS2", dt.date(2025, 12, 1)), ("HS2", dt.date(2025, 12, 9)),
                         ("HS2", dt.date(2025, 11, 9)), ("HS2", dt.date(2025, 12, 1)))
    found = top_posts(requests, posts, n=2)
    assert rows.get(found, "day", "rank", "author", "match_level", "posted") == [
        (dt.date(2025, 12, 1), 1, "b", "day", "2025-12-01 09:30"),
        (dt.date(2025, 12, 1), 2, "a", "day", "2025-12-01 09:30"),
        (dt.date(2025, 12, 9), 1, "b", "month", "2025-12-01 09:30"),
        (dt.date(2025, 12, 9), 2, "c", "month", "2025-12-02 09:30"),
    ]


def test_the_month_label_need_not_be_that_of_the_day(rows):
    posts = rows.make(POSTS, post(1, "a", 5, month="November 2025"), post(2, "b", 1), post(1, "c", 4))
    requests = rows.make("topic string, day date", ("HS2", dt.date(2025, 11, 20)), ("HS2", dt.date(2025, 12, 1)))
    assert rows.get(top_posts(requests, posts), "day", "author", "match_level") == [
        (dt.date(2025, 11, 20), "a", "month"), (dt.date(2025, 12, 1), "a", "day"), (dt.date(2025, 12, 1), "c", "day")
    ]


def test_equal_likes_are_ordered_and_missing_likes_come_last(rows):
    posts = rows.make(POSTS, post(1, "b", 5), post(1, "a", 5), post(1, "c", None))
    requests = rows.make("topic string, day date", ("HS2", dt.date(2025, 12, 1)))
    assert rows.get(top_posts(requests, posts), "rank", "author") == [(1, "a"), (2, "b"), (3, "c")]


def test_top_regions_per_topic(rows):
    interest = rows.make("topic string, region string, interest long",
                         ("t", "b", 5), ("t", "a", 5), ("t", "c", 9), ("u", "a", 1))
    assert rows.get(top_regions(interest, n=2), "topic", "rank", "region") == [("t", 1, "c"), ("t", 2, "a"), ("u", 1, "a")]
    assert rows.get(top_regions(interest.filter("false"))) == []


def test_top_queries_per_kind(rows):
    queries = rows.make("topic string, kind string, query string, value long",
                        ("t", "top", "x", 3), ("t", "top", "y", 8), ("t", "rising", "z", 1))
    assert rows.get(top_queries(queries, n=1), "kind", "query") == [("rising", "z"), ("top", "y")]


def test_preview(rows):
    assert rows.get(preview(rows.make("a int", (3,), (1,), (2,)), ["a"], 2)) == [(1,), (2,)]


ARTICLES = "url string, title string, search_query string, pos long"


def test_first_article_in_query_order(rows):
    articles = rows.make(ARTICLES, ("u", "late", "A", 0), ("u", "first", "Z", 1), ("u", "second", "Z", 2),
                         (None, "n2", "A", 5), (None, "n1", "A", 4), ("v", "alone", "B", 0))
    unique = dedupe_articles(articles, ["Z", "A"])
    assert rows.get(unique, "url", "title") == [("u", "first"), ("v", "alone"), (None, "n1")]
    assert rows.get(dedupe_articles(unique, ["Z", "A"])) == rows.get(unique)


def test_keep_last(rows):
    df = rows.make("k string, pos int, v string", ("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"))
    assert rows.get(keep_last(df, ["k"], ["pos"]), "k", "v") == [("a", "y"), ("b", "z")]


def test_one_key_with_most_rows(spark):
    hot = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("url"),
        F.lit("t").alias("title"), F.lit("q").alias("search_query"), F.col("id").alias("pos"),
    )
    unique = dedupe_articles(hot.repartition(16))
    assert unique.count() == 6_667 + 1
    assert unique.filter("url = 'hot'").first().pos == 1


def test_requests_prune_the_scan_and_nothing_else(spark, tmp_path):
    days = F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 400).cast("int"))
    stored = spark.range(8000).select(
        F.concat(F.lit("t"), F.col("id") % 7).alias("topic"), days.cast("timestamp").alias("created_at"), days.alias("day"),
        F.date_format(days, "MMMM yyyy").alias("month"), F.concat(F.lit("a"), "id").alias("author"), F.lit("x").alias("text"),
        (F.col("id") % 50).alias("likes"), F.lit(0).alias("reposts"), F.lit(0).alias("replies"),
    ).where("NOT (topic = 't3' AND day = '2025-03-05')")
    stored.sortWithinPartitions("day").write.option("parquet.block.size", 20_000).parquet(str(tmp_path / "posts"))
    posts = spark.read.parquet(str(tmp_path / "posts"))
    day = spark.createDataFrame([("t3", dt.date(2025, 3, 5)), ("t4", dt.date(2025, 3, 5)), (None, None)], "topic string, day date")
    found = top_posts(day, posts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Or(And(GreaterThanOrEqual(day,2025-03-05),LessThanOrEqual(day,2025-03-05))" in plan
    levels = {(r.topic, r.match_level) for r in found.collect()}
    assert levels == {("t3", "month"), ("t4", "day")}
    near = only_wanted(posts, day).select("topic", "month").distinct().collect()
    assert {(r.topic, r.month) for r in near} == {("t3", "March 2025"), ("t4", "March 2025")}


@pytest.mark.parametrize("count", [0, 1, 40, 3000])
def test_any_number_of_requests(spark, count):
    """The wanted posts are all among those let through, however full the bitmaps are."""
    posts = spark.range(20_000).select(
        F.concat(F.lit("t"), F.col("id") % 997).alias("topic"), F.date_from_unix_date((F.col("id") % 700).cast("int")).alias("day")
    ).withColumn("month", F.date_format("day", "MMMM yyyy"))
    wanted = posts.select("topic", "day").distinct().orderBy(F.xxhash64("topic", "day")).limit(count)
    by_day = posts.join(wanted, ["topic", "day"], "left_semi")
    by_month = posts.join(wanted.select("topic", F.date_format("day", "MMMM yyyy").alias("month")).distinct(), ["topic", "month"], "left_semi")
    let_through = only_wanted(posts, wanted)
    assert by_day.unionByName(by_month).distinct().exceptAll(let_through.select("topic", "day", "month").distinct()).isEmpty()
    assert let_through.count() <= (20_000 if count > 1 else 100 * count)
