"""The most liked posts for requested topics and days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicpulse.functions.dates import iso_minute, month_label
from civicpulse.functions.fixed_values import TOP_POSTS
from civicpulse.operators.topk import top_n


#: Bits of the bitmaps that Spark's bitmap functions make.
BITS = 32_768


def top_posts(requests: DataFrame, posts: DataFrame, n: int = TOP_POSTS) -> DataFrame:
    """The n most liked posts for each requested (topic, day).

    Where the day has no post of the topic, the posts of the month labelled ``December 2025``
    are taken instead; ``match_level`` tells which. A request without either has no rows.
    """
    order = [F.col("likes").desc(), *[F.col(c) for c in ("created_at", "author", "text")]]
    # Posts are ranked per day and per month, not per request, so the join sees n rows per key.
    # Both rankings start from the n best of each day and month: posts are read once.
    wanted = requests.select("topic", "day").distinct()
    best = top_n(only_wanted(posts, wanted), ["topic", "day", "month"], order, n).drop("rank")
    periods = _by_period(best, F.col("month")).drop("day")
    ranked = top_n(periods, ["topic", "match_level", "period"], order, n)

    keyed = _by_period(wanted, month_label(F.col("day")))
    found = keyed.join(ranked, ["topic", "match_level", "period"]).drop("period")
    # At most 2n rows per request: those of the day come before those of the month.
    closest = F.min("match_level").over(Window.partitionBy("topic", "day"))
    return (
        found.withColumn("closest", closest)
        .filter(F.col("match_level") == F.col("closest"))
        .drop("closest")
        .withColumn("posted", iso_minute(F.col("created_at")))
    )


def only_wanted(posts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The posts that can answer a wanted (topic, day), by its day or its month, and perhaps a few others.

    The bounds of days and months reach the scan, so a request for one day reads that day and its month. Then
    a bitmap of the wanted pairs is looked up per post; posts are neither joined nor shuffled for it. Bounds
    and bitmaps are worked out beforehand: the same 8 KB for any number of requests. None leave no posts.
    """
    month = month_label(F.col("day"))
    found = wanted.select("topic", "day", month.alias("month")).agg(
        F.min("day").alias("first"), F.max("day").alias("last"), F.min("month").alias("low"), F.max("month").alias("high"),
        F.bitmap_construct_agg(_place("topic", "day")).alias("days"),
        F.bitmap_construct_agg(_place("topic", "month")).alias("months"),
    ).first()
    near = F.col("day").between(F.lit(found.first), F.lit(found.last)) | F.col("month").between(F.lit(found.low), F.lit(found.high))
    known = _is_set(found.days, _place("topic", "day")) | _is_set(found.months, _place("topic", "month"))
    return posts.filter(near).filter(known)


def _place(*columns: str) -> Column:
    """The bit of a key in a bitmap of Spark's size."""
    return F.pmod(F.xxhash64(*columns), F.lit(BITS))


def _is_set(bitmap: bytes, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.lit(bitmap), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def _by_period(df: DataFrame, month: Column) -> DataFrame:
    """Every row twice: under its day and under its month."""
    levels = [
        F.struct(F.lit(level).alias("match_level"), period.alias("period"))
        for level, period in (("day", F.col("day").cast("string")), ("month", month))
    ]
    return df.select("*", F.inline(F.array(*levels)))
