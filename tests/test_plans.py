"""Properties of the physical plans that hold at any size of the data."""

import pytest
from pyspark.sql import functions as F

from civicpulse.operators import news, regions, series, topk
from civicpulse.plans import reports, standins
from civicpulse.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_unkeyed_window(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    windows = [line for line in plan.splitlines() if "+- Window [" in line or ":- Window [" in line]
    assert not any("], []" in line or "windowspecdefinition(specifiedwindowframe" in line for line in windows)


@pytest.mark.parametrize("name", ["dedupe_articles", "top_regions", "top_queries", "top_posts", "trend_direction", "centroids", "attach_summaries", "news_digest"])
def test_rankings_are_limited_before_the_shuffle(spark, name):
    assert "row_number(), " in plan_of(QUERIES[name](spark, SF_DIR)) and "Partial" in plan_of(QUERIES[name](spark, SF_DIR))


def test_posts_are_scanned_once_besides_the_requests(spark):
    plan = plan_of(QUERIES["top_posts"](spark, SF_DIR))
    assert plan.count("FileScan parquet [event_id") == 1


def test_selection_reaches_the_scan(spark):
    plan = plan_of(QUERIES["select_topic_day"](spark, SF_DIR))
    scan = next(line for line in plan.splitlines() if "o_orderdate" in line and "FileScan" in line)
    assert "GreaterThanOrEqual(o_orderdate" in scan
    assert "TakeOrderedAndProject" in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(QUERIES["region_values_mean"](spark, SF_DIR))
    scans = " ".join(line.split("Batched")[0] for line in plan.splitlines() if "FileScan" in line)
    assert "o_totalprice" in scans and "c_nationkey" in scans
    assert "o_orderstatus" not in scans and "c_name" not in scans and "c_acctbal" not in scans


@pytest.mark.parametrize("name", [
    "region_values_latest", "series_summary", "series_summary_by_region", "annotate_events", "timeline", "mapped_values",
])
def test_aggregates_need_no_sort(spark, name):
    assert "SortAggregate" not in plan_of(QUERIES[name](spark, SF_DIR))


@pytest.mark.parametrize("name", ["choropleth", "choropleth_by_name", "choropleth_selected"])
def test_maps_are_joins_from_the_shapes(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert not any(word in plan for word in ("Limit", "scalar", "collect_list", "Generate"))
    assert "LeftOuter" in plan or "RightOuter" in plan


def test_a_map_grows_with_its_values_not_with_their_product(spark):
    trends, shapes = standins.trend_long(spark, SF_DIR), standins.map_shapes(spark, SF_DIR)
    values = regions.mapped_values(trends, standins.map_codes(spark))
    drawn = reports.region_map(trends, shapes, standins.map_codes(spark))
    assert drawn.count() <= values.count() + shapes.count()


def test_pages_are_pruned_before_they_are_sorted(spark):
    pages = standins.table(spark, SF_DIR, "pages")
    plan = plan_of(reports.article_text(standins.page_articles(spark, SF_DIR), pages))
    assert "LeftSemi" in plan and plan.index("Window") < plan.index("LeftSemi")


def test_a_stored_series_is_scanned_twice_at_most(spark, tmp_path):
    """A timeline reads its points, and the statistics once for all marks; a report likewise."""
    standins.topic_series(spark, SF_DIR).write.parquet(str(tmp_path / "series"))
    stored = spark.read.parquet(str(tmp_path / "series"))
    timeline = series.timeline_table(stored)
    report = reports.topic_report(stored, standins.region_interest(spark, SF_DIR), standins.related_queries(spark, SF_DIR))
    for df in (timeline, report):
        df.collect()
        final = plan_of(df).split("Initial Plan")[0]
        assert 1 <= sum("FileScan" in line and "[topic" in line and "date" in line for line in final.splitlines()) <= 2
    assert "ReusedExchange" in plan_of(timeline).split("Initial Plan")[0]


def test_date_catalog_reads_its_table_once(spark):
    catalog = QUERIES["catalog_dates"](spark, SF_DIR)
    catalog.collect()
    assert plan_of(catalog).split("Initial Plan")[0].count("ReusedExchange [date") == 1


def test_page_text_is_worked_out_once(spark):
    pages = standins.table(spark, SF_DIR, "pages")
    texts = reports.article_text(standins.page_articles(spark, SF_DIR), pages)
    for df in (QUERIES["html_text"](spark, SF_DIR), texts, news.summary_requests(texts)):
        assert plan_of(df).count("html_to_text(") == 1


def test_small_literal_tables_are_broadcast(spark):
    assert "BroadcastHashJoin" in plan_of(QUERIES["region_lookup"](spark, SF_DIR))


def test_preview_is_a_top_k(spark):
    df = topk.preview(standins.table(spark, SF_DIR, "orders"), ["o_orderkey"])
    assert "TakeOrderedAndProject" in plan_of(df)


def test_a_hot_key_is_split_where_rows_are_joined(spark):
    """Four fifths of the orders by one customer, too many customers to broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    orders = standins.table(spark, "/root/testdata/sf0.01", "orders")
    hot = F.when(F.col("o_orderkey") % 5 > 0, F.lit(7)).otherwise(F.col("o_custkey"))
    skewed = orders.withColumn("o_custkey", hot).repartition(8)
    expected = skewed.count()
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        trends = standins.trend_long(spark, "/root/testdata/sf0.01", skewed)
        means = regions.region_values(trends, "sum")
        means.collect()
        assert "skew=true" in plan_of(means)
        assert trends.count() == expected
    finally:
        for name in settings:
            spark.conf.unset(name)
