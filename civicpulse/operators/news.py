"""Articles: dedupe, page text, summary requests and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse.functions.html import html_to_text
from civicpulse.functions.text import (
    drop_prefix,
    has_text,
    response_text,
    summary_body,
    summary_prompt,
)
from civicpulse.operators.topk import keep_first


def dedupe_articles(
    articles: DataFrame, queries: Sequence[str] = (), position: Sequence[str] = ("pos",)
) -> DataFrame:
    """The first article of each URL, in the order of the queries, then of the results.

    Queries that are not listed come last, by name. Articles without URL count as one.
    """
    order = [_query_rank(queries), F.col("search_query"), *[F.col(c) for c in position]]
    return keep_first(articles, ["url"], order)


def _query_rank(queries: Sequence[str]) -> Column:
    listed = F.array_position(F.array(*[F.lit(q) for q in queries]), F.col("search_query"))
    return F.when(listed > 0, listed).otherwise(len(queries) + 1) if queries else F.lit(0)


def extract_text(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by its visible text ``content`` and an ``error`` for unreadable pages."""
    return pages.withColumn("parsed", html_to_text("html")).select(
        *[c for c in pages.columns if c != "html"], "parsed.content", "parsed.error"
    )


def summary_requests(articles: DataFrame) -> DataFrame:
    """(url, body) of a summary request for each article with text."""
    return articles.filter(has_text(F.col("content"))).select(
        "url", summary_body(summary_prompt(F.col("content"))).alias("body")
    )


def clean_summaries(responses: DataFrame) -> DataFrame:
    """(url, summary) from response bodies, without the opening phrase."""
    return responses.select("url", drop_prefix(response_text(F.col("body"))).alias("summary"))


def attach_summaries(articles: DataFrame, responses: DataFrame) -> DataFrame:
    """Add the summary of each article; NULL where there is none.

    Responses are matched by URL, and the first by body counts should one be there twice.
    """
    once = keep_first(responses.select("url", "body"), ["url"], [F.col("body")])
    return articles.join(clean_summaries(once), "url", "left")
