"""Keep-first rules and top-n rankings.

Each one is a ``row_number`` filter, which Spark turns into a per-key limit on both sides of the
shuffle: a task sends at most n rows of a key, however many copies of it there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicpulse.functions.fixed_values import PREVIEW_ROWS, TOP_QUERIES, TOP_REGIONS


def top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first n rows of every key in the given order, numbered from 1."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
    return ranked.withColumn(rank, F.col(rank).cast("long"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order. NULL is a key like any other."""
    return top_n(df, keys, order, 1, "_row").drop("_row")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in the order of the given columns."""
    return keep_first(df, keys, [F.col(c).desc() for c in order])


def top_regions(region_interest: DataFrame, n: int = TOP_REGIONS) -> DataFrame:
    """The n regions with the highest interest per topic; names break ties."""
    order = [F.col("interest").desc(), F.col("region")]
    return top_n(region_interest, ["topic"], order, n)


def top_queries(related_queries: DataFrame, n: int = TOP_QUERIES) -> DataFrame:
    """The n highest related queries per topic and kind (top or rising)."""
    order = [F.col("value").desc(), F.col("query")]
    return top_n(related_queries, ["topic", "kind"], order, n)


def preview(df: DataFrame, order: Sequence[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """The first n rows in the order of the given columns."""
    return df.orderBy(*order).limit(n)
