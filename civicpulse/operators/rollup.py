"""Monthly totals of daily counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse.functions.dates import month_key


def monthly_rollup(counts: DataFrame) -> DataFrame:
    """Total per topic and month (``2025-01``) of a (topic, date, value) table."""
    return counts.groupBy("topic", month_key(F.col("date")).alias("month")).agg(
        F.sum("value").cast("long").alias("total")
    )


def only_listed(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """The same rows; one with a value that is not listed fails the query, as a pivot would lose it."""
    value = F.col(column)
    unlisted = F.raise_error(F.concat(F.lit(f"{column} is not listed: "), value))
    return df.withColumn(column, F.when(value.isNull() | value.isin(list(values)), value).otherwise(unlisted))


def monthly_wide(rollup: DataFrame, topics: Sequence[str]) -> DataFrame:
    """One row per month and one column per listed topic; a topic that is not listed is an error."""
    return only_listed(rollup, "topic", topics).groupBy("month").pivot("topic", list(topics)).agg(F.sum("total"))
