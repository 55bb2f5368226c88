"""Properties that hold for any input, over the smallest tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from civicpulse.operators import frames, geo, regions, reshape, rollup, topk
from civicpulse.operators.news import dedupe_articles
from civicpulse.operators.series import series_summary, trend_direction
from civicpulse.plans import standins
from civicpulse.sources.boundaries import with_polygons

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trends(spark):
    return standins.trend_long(spark, SF_DIR)


def test_melt_has_a_row_per_region(spark):
    wide = standins.table(spark, SF_DIR, "lineitem")
    long = reshape.melt_regions(wide, ["l_tax", "l_discount"], ["l_orderkey", "l_linenumber"])
    assert long.count() == 2 * wide.count()


def test_frame_weights_span_0_to_100(spark, trends):
    places = geo.centroids(with_polygons(standins.features(spark, SF_DIR)))
    points = frames.heat_points(trends, places, standins.map_codes(spark))
    spans = points.groupBy("topic_name", "week").agg(
        F.min("weight").alias("low"), F.max("weight").alias("high"), F.count("*").alias("n")
    )
    assert spans.filter("low <> 0 or high not in (0, 100) or (n = 1 and high <> 0)").count() == 0
    assert spans.filter("high = 100").count() > 0
    assert points.count() == points.select("topic_name", "week", "region_code").distinct().count()


def test_months_sum_to_all_days(spark):
    counts = standins.topic_series(spark, SF_DIR)
    months = rollup.monthly_rollup(counts)
    assert months.agg(F.sum("total")).first()[0] == counts.agg(F.sum("value")).first()[0]


def test_a_topic_that_is_not_listed_is_an_error(spark):
    months = rollup.monthly_rollup(standins.topic_series(spark, SF_DIR))
    with pytest.raises(Exception, match="topic is not listed"):
        rollup.monthly_wide(months, ["click"]).collect()


def test_dedupe_keeps_each_url_once_and_is_idempotent(spark, rows):
    articles = standins.articles(spark, SF_DIR)
    unique = dedupe_articles(articles)
    assert unique.count() == articles.select("url").distinct().count() < articles.count()
    assert rows.get(dedupe_articles(unique.repartition(5))) == rows.get(unique)


def test_top_n_has_at_most_n_rows_per_key(spark):
    interest = standins.region_interest(spark, SF_DIR)
    sizes = topk.top_regions(interest, 3).groupBy("topic").count()
    assert [r[0] for r in sizes.select("count").distinct().collect()] == [3]
    assert topk.top_regions(interest, 10_000).count() == interest.count()


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_results_do_not_depend_on_partitions(spark, rows, trends, partitions):
    shuffled = trends.repartition(partitions, F.rand(seed=partitions))
    for how in ("mean", "sum", "latest"):
        assert rows.get(regions.region_values(shuffled, how)) == rows.get(regions.region_values(trends, how))
    series = standins.topic_series(spark, SF_DIR)
    parted = series.repartition(partitions, F.rand(seed=partitions))
    for summarise in (series_summary, trend_direction):
        assert rows.get(summarise(parted)) == rows.get(summarise(series))


def test_summary_and_direction_equal_pandas(spark):
    series = standins.topic_series(spark, SF_DIR)
    summary = {r.topic: r for r in series_summary(series).collect()}
    directions = {r.topic: r.trend for r in trend_direction(series).collect()}
    for topic, group in series.toPandas().groupby("topic"):
        values = group.set_index("date")["value"].sort_index()
        newest = values.tail(8)
        now, before = newest.tail(4).mean(), newest.head(4).mean()
        word = "Increasing" if now > before else "Decreasing" if now < before else "Stable"
        row = summary[topic]
        assert (row.average_interest, row.peak_interest, row.peak_date, row.current_interest) == (
            round(values.mean(), 2), values.max(), values.idxmax(), values.iloc[-1]
        )
        assert directions[topic].endswith(word)


def test_weekly_heat_values_equal_pandas(spark, trends):
    table = trends.select("topic_name", "region", "date", F.col("interest_value").cast("double")).toPandas()
    table["week"] = pd.to_datetime(table["date"]).dt.to_period("W").dt.start_time.dt.date
    expected = table.groupby(["topic_name", "week", "region"])["interest_value"].mean()
    weekly = frames._weekly_by_code(trends, regions.region_code_table(spark, {r: r for r in table["region"].unique()}))
    found = weekly.toPandas().set_index(["topic_name", "week", "region_code"])["interest_value"]
    assert len(found) == len(expected)
    assert (found.sort_index().to_numpy() == pytest.approx(expected.sort_index().to_numpy()))
