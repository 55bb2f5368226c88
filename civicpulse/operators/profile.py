"""Dataset profile, selection catalogues and coverage of requested topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse.operators.regions import region_lookup


def _per_pair(trends: DataFrame) -> DataFrame:
    return trends.groupBy("topic_name", "region").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count("*").alias("n_rows"),
    )


def profile_trends(trends: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: date range, distinct regions and topics, number of rows.

    ``approximate`` estimates the distinct numbers, for tables with very many regions or topics.
    """
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    # Distinct values are counted over (topic, region) pairs, not over the rows.
    return _per_pair(trends).agg(
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        distinct("region").alias("n_regions"),
        distinct("topic_name").alias("n_topics"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
    )


def region_pairs(trends: DataFrame) -> DataFrame:
    """The distinct (region, region_name) pairs."""
    return trends.select("region", "region_name").distinct()


def topic_catalog(trends: DataFrame) -> DataFrame:
    """The distinct topics in order, each with its date range."""
    return (
        trends.groupBy("topic_name")
        .agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
        .orderBy("topic_name")
    )


def date_catalog(trends: DataFrame) -> DataFrame:
    """The distinct dates in order, with their rows; the most recent is the default selection."""
    n_rows = F.col("n_rows")
    dates = trends.groupBy("date").agg(F.count("*").alias("n_rows"))
    # Asking for days with rows, which all have, keeps the count: both uses then share one pass.
    newest = dates.agg(F.max(F.when(n_rows > 0, F.col("date")))).scalar()
    return dates.withColumn("is_default", F.col("date") == newest).orderBy("date")


def coverage(trends: DataFrame, requested: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows found per requested topic, and rows whose region is on no map.

    ``requested`` has a ``topic_name`` column; a topic without rows is flagged ``no_data``.
    """
    pairs = region_lookup(_per_pair(trends), codes)
    unmapped = F.when(F.col("region_code").isNull(), F.col("n_rows"))
    found = pairs.groupBy("topic_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum(unmapped).alias("n_unmapped")
    )
    n_rows, n_unmapped = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_rows", "n_unmapped"))
    return requested.select("topic_name").distinct().join(found, "topic_name", "left").select(
        "topic_name", n_rows.alias("n_rows"), n_unmapped.alias("n_unmapped"),
        (n_rows == 0).alias("no_data"),
    )
