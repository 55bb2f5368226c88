"""Summaries of interest series: statistics, direction, timeline rows, weekly means.

A series table has one row per topic and date; with other ``keys``, one per combination of them
and date. Every step over a whole topic is an aggregate or
a per-key limit, so a topic with most of the rows is reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicpulse.functions.dates import long_date, week_end
from civicpulse.functions.fixed_values import (
    REFERENCE_EVENTS,
    TREND_DOWN,
    TREND_FLAT,
    TREND_POINTS,
    TREND_UNKNOWN,
    TREND_UP,
)
from civicpulse.functions.numbers import mean_of, packed, round_to, sortable
from civicpulse.operators.topk import top_n


def series_statistics(series: DataFrame, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """Unrounded statistics per topic: first and last date, mean, first peak, last value.

    Of values that share the last date the largest counts. One hash aggregate does it: a task sends one
    row per topic, whatever the values are, as value and date are ordered by a single packed number.
    """
    value, date = F.col("value"), F.col("date")
    ordered = series.withColumn("_order", sortable(value, series.schema["value"].dataType))
    order, day = F.col("_order"), F.unix_date(date)
    earliest = packed(order, F.coalesce(F.lit(2**31) - day.cast("long"), F.lit(0)), 33)
    above_none = order.cast("decimal(20,0)") + F.lit(Decimal(2**63))
    latest = packed(day, F.coalesce(above_none, F.lit(Decimal(0))), 64)
    return ordered.groupBy(*keys).agg(
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        mean_of(value).alias("average"),
        F.max(value).cast("double").alias("peak"),
        F.max_by(date, earliest).alias("peak_date"),
        F.max_by(value, latest).cast("double").alias("current"),
    )


def series_summary(series: DataFrame, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """Rounded mean, peak, date of the first peak, and current value per topic."""
    return series_statistics(series, keys).select(
        *keys,
        round_to(F.col("average"), 2).alias("average_interest"),
        F.col("peak").try_cast("long").alias("peak_interest"),
        "peak_date",
        long_date(F.col("peak_date")).alias("peak_date_label"),
        F.col("current").try_cast("long").alias("current_interest"),
    )


def trend_direction(series: DataFrame, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """Compare the mean of the newest four points of a topic with the four before."""
    order = [F.col("date").desc(), F.col("value").desc()]
    newest = top_n(series, keys, order, 2 * TREND_POINTS)
    recent = F.col("rank") <= TREND_POINTS
    means = newest.groupBy(*keys).agg(
        F.count("*").alias("points"),
        mean_of(F.when(recent, F.col("value"))).alias("recent_average"),
        mean_of(F.when(~recent, F.col("value"))).alias("previous_average"),
    )
    now, before = F.col("recent_average"), F.col("previous_average")
    trend = (
        F.when(F.col("points") < 2 * TREND_POINTS, TREND_UNKNOWN)
        .when(now > before, TREND_UP)
        .when(now < before, TREND_DOWN)
        .otherwise(TREND_FLAT)
    )
    return means.withColumn("trend", trend)


def annotate_events(
    statistics: DataFrame, events: Sequence[tuple[str, str]] = REFERENCE_EVENTS
) -> DataFrame:
    """(topic, event, event_date) for each event within the dates of a topic, ends included."""
    return statistics.select("topic", F.explode(_events_between(events)).alias("event")).select(
        "topic", F.col("event.label").alias("event"), F.col("event.date").alias("event_date")
    )


def _events_between(events: Sequence[tuple[str, str]]) -> Column:
    # The list is part of the plan, which spares a join on a range.
    listed = F.array(
        *[F.struct(F.lit(e).alias("label"), F.lit(d).cast("date").alias("date")) for e, d in events]
    )
    return F.filter(listed, lambda e: e["date"].between(F.col("first_date"), F.col("last_date")))


def timeline_table(
    series: DataFrame, events: Sequence[tuple[str, str]] = REFERENCE_EVENTS
) -> DataFrame:
    """Rows of a timeline per topic: its points, its first peak and the events within it.

    Each row carries the average of its topic, the height of the reference line.
    """
    statistics = series_statistics(series.filter(F.col("topic").isNotNull()))
    none = F.lit(None)
    # Peak and events come from one row per topic.
    peak = F.struct(
        F.lit("peak").alias("kind"), F.col("peak_date").alias("date"),
        F.col("peak").alias("value"), F.lit("Peak").alias("label"),
    )
    marked = F.transform(
        _events_between(events),
        lambda e: F.struct(
            F.lit("event").alias("kind"), e["date"].alias("date"),
            none.cast("double").alias("value"), e["label"].alias("label"),
        ),
    )
    marks = statistics.select("topic", "average", F.inline(F.concat(F.array(peak), marked)))
    # The average is read off the marks too, so both uses share one pass for the statistics.
    averages = marks.filter(F.col("kind") == "peak").select("topic", "average")
    points = series.join(averages, "topic").select(
        "topic", F.lit("interest").alias("kind"), "date", F.col("value").cast("double"),
        none.cast("string").alias("label"), "average",
    )
    return points.unionByName(marks.filter(F.col("date").isNotNull()))


def weekly_series(
    trends: DataFrame, keys: Sequence[str] = ("topic_name", "region"), dense: bool = True
) -> DataFrame:
    """Mean interest per week, labelled by the Sunday that ends it.

    With ``dense``, a week without rows between two weeks with rows is there with a NULL value.
    """
    value = mean_of(F.col("interest_value")).alias("interest_value")
    weekly = trends.groupBy(*keys, week_end(F.col("date")).alias("week_end")).agg(value)
    return fill_weeks(weekly, keys) if dense else weekly


def fill_weeks(weekly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the missing weeks of each key.

    A row is followed by the weeks up to its successor: a window over weekly rows, which are few
    per key, and no join with a calendar.
    """
    following = F.lead("week_end").over(Window.partitionBy(*keys).orderBy("week_end"))
    last = F.coalesce(F.date_sub(following, 7), F.col("week_end"))
    weeks = F.sequence(F.col("week_end"), last, F.expr("interval 7 days"))
    others = [c for c in weekly.columns if c not in (*keys, "week_end", "interest_value")]
    return weekly.withColumn("weeks", weeks).select(
        *keys, *others, F.posexplode("weeks").alias("gap", "week_end"), "interest_value"
    ).withColumn(
        "interest_value", F.when(F.col("gap") == 0, F.col("interest_value"))
    ).drop("gap")
