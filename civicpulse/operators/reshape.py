"""Wide to long, and union of tables with different columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse.functions.fixed_values import REGION_COLUMNS


def melt_regions(
    wide: DataFrame,
    regions: Sequence[str] = REGION_COLUMNS,
    ids: Sequence[str] = ("date", "topic_name"),
    region_column: str = "region",
    value_column: str = "interest_value",
) -> DataFrame:
    """One row per id and region; empty cells are kept as NULL."""
    return wide.unpivot(list(ids), list(regions), region_column, value_column)


def topic_series(wide: DataFrame, date_column: str = "date") -> DataFrame:
    """A table with one value column per topic to (topic, date, value).

    The flag column of a part-filled last period is dropped; its row stays.
    """
    full = wide.drop("isPartial")
    topics = [c for c in full.columns if c != date_column]
    return full.unpivot([date_column], topics, "topic", "value").select(
        "topic", F.col(date_column).alias("date"), "value"
    )


def union_sources(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, matched by column name; a column a table lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
