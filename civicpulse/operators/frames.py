"""Series and heat-map frames placed at region centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicpulse.functions.dates import iso_date, week_end, week_start
from civicpulse.functions.numbers import round_one
from civicpulse.operators.regions import region_map_values
from civicpulse.operators.series import fill_weeks


def _weekly_by_code(trends: DataFrame, codes: DataFrame) -> DataFrame:
    """Mean interest per (topic, region code, Monday).

    Rows are reduced per region before the code is looked up, and combined per code after it,
    as a region may appear both under its name and under its code.
    """
    value = F.col("interest_value")
    monday = week_start(F.col("date")).alias("week")
    per_region = trends.groupBy("topic_name", "region", monday).agg(
        F.sum(value).alias("total"), F.count(value).alias("n")
    )
    mean = F.try_divide(F.sum("total").cast("double"), F.sum("n").cast("double"))
    return (
        region_map_values(per_region, codes)
        .groupBy("topic_name", "region_code", "week")
        .agg(mean.alias("interest_value"))
    )


def sparkline_series(trends: DataFrame, centroids: DataFrame, codes: DataFrame) -> DataFrame:
    """Gapless weekly means per topic and region with a centroid.

    ``week_end`` is the Sunday; ``latest`` is the last weekly mean there is, to one place.
    """
    keys = ["topic_name", "region_code"]
    weekly = _weekly_by_code(trends, codes).withColumn("week_end", week_end(F.col("week")))
    whole = Window.partitionBy(*keys).orderBy("week_end").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    latest = F.last("interest_value", ignorenulls=True).over(whole)
    series = fill_weeks(weekly.drop("week").withColumn("latest", latest), keys)
    return series.join(centroids, "region_code").select(
        *keys, "lat", "lon", "week_end", "interest_value", round_one(F.col("latest")).alias("latest")
    )


def heat_points(trends: DataFrame, centroids: DataFrame, codes: DataFrame) -> DataFrame:
    """Points of weekly heat-map frames, one per topic, week (Monday) and region.

    The weight is scaled to 0-100 within the frame, and 0 where all its values are equal.
    """
    placed = _weekly_by_code(trends, codes).join(centroids, "region_code")
    # A frame holds one row per region at most: the raw rows were reduced above.
    frame = Window.partitionBy("topic_name", "week")
    value = F.col("interest_value")
    low, high = F.min(value).over(frame), F.max(value).over(frame)
    scaled = F.col("low_to_value") / F.col("low_to_high") * 100.0
    return placed.withColumns({"low_to_value": value - low, "low_to_high": high - low}).select(
        "topic_name", "week", iso_date(F.col("week")).alias("label"), "region_code", "lat", "lon",
        F.when(F.col("low_to_high") > 0, scaled).otherwise(0.0).alias("weight"),
    )


def heat_frames(points: DataFrame) -> DataFrame:
    """One row per topic and week: its label and its points in region order.

    A frame's array has a point per region with a centroid at most, so it grows with the table of
    centroids, not with the trends.
    """
    point = F.struct("region_code", "lat", "lon", "weight")
    return points.groupBy("topic_name", "week", "label").agg(
        F.sort_array(F.collect_list(point)).alias("points")
    )
