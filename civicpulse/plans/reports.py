"""The three whole reports: a topic report, a region map and a news digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse.functions.fixed_values import NO_DATA
from civicpulse.functions.labels import geography_label
from civicpulse.operators.news import attach_summaries, dedupe_articles, extract_text
from civicpulse.operators.regions import choropleth_table, mapped_values, region_values, select_trends
from civicpulse.operators.series import series_summary, trend_direction
from civicpulse.operators.topk import keep_first, top_queries, top_regions


def topic_report(
    series: DataFrame,
    region_interest: DataFrame,
    related_queries: DataFrame,
    geo: str = "GB",
    requested: DataFrame | None = None,
) -> DataFrame:
    """One row per topic: statistics, trend, top regions, top and rising related queries.

    ``requested`` (with a ``topic`` column) selects the topics; one without a series gets a row
    with an error message.
    """
    trend = trend_direction(series).select("topic", "trend")
    report = series_summary(series).join(trend, "topic")
    if requested is not None:
        report = requested.select("topic").distinct().join(report, "topic", "left")
    # The lists are short: each holds the rows of one top-n ranking.
    regions = top_regions(region_interest).groupBy("topic").agg(
        _ranked_list("region", "interest").alias("top_regions")
    )
    queries = top_queries(related_queries).groupBy("topic").agg(
        _ranked_list("query", "value", kind="top").alias("top_queries"),
        _ranked_list("query", "value", kind="rising").alias("rising_queries"),
    )
    message = F.concat(F.lit(NO_DATA[0]), F.col("topic"), F.lit(NO_DATA[1]))
    return (
        report.join(regions, "topic", "left")
        .join(queries, "topic", "left")
        .withColumn("geography", geography_label(F.lit(geo)))
        .withColumn("error", F.when(F.col("trend").isNull(), message))
    )


def _ranked_list(*columns: str, kind: str | None = None) -> Column:
    row = F.struct("rank", *columns)
    return F.sort_array(F.collect_list(row if kind is None else F.when(F.col("kind") == kind, row)))


def region_map(
    trends: DataFrame, shapes: DataFrame, codes: DataFrame, how: str = "mean"
) -> DataFrame:
    """Each map shape with the values of its region, a row per topic and day that has one."""
    return choropleth_table(shapes, mapped_values(trends, codes, how))


def selected_map(
    trends: DataFrame, shapes: DataFrame, codes: DataFrame, topic: str, day: str, how: str = "mean"
) -> DataFrame:
    """Every map shape for one topic and day, filled by code, with the tooltip's value by name.

    A shape stays blank where its region has no row, also when all regions are unknown. Whether
    the selection has rows at all is for ``coverage`` to tell.
    """
    chosen = select_trends(trends, topic, day)
    named = region_values(chosen, how, keys=()).withColumnRenamed("region", "region_name")
    return choropleth_table(shapes, mapped_values(chosen, codes, how, keys=()), keys=(), tips=named)


def article_text(articles: DataFrame, pages: DataFrame, queries: list[str] | None = None) -> DataFrame:
    """(url, headline, content, error) of each distinct article, from the pages fetched.

    Of several pages of one URL the one with the smallest hash counts.
    """
    unique = dedupe_articles(articles, queries or ())
    # Pages that no article asks for go before any page is sorted; a hash decides before the text.
    wanted = pages.select("url", "html").join(unique.select("url"), "url", "left_semi")
    once = keep_first(wanted, ["url"], [F.xxhash64("html"), F.col("html")])
    found = unique.select("url", F.col("title").alias("headline")).join(once, "url", "left")
    return extract_text(found)


def news_digest(texts: DataFrame, responses: DataFrame) -> DataFrame:
    """(url, content, headline, summary) from article texts and the responses to their requests.

    Texts are taken as a table, so that a stored one is not extracted again.
    """
    return attach_summaries(texts, responses).select("url", "content", "headline", "summary")
