"""Search-interest tables and daily counts from CSV files.

Columns are named by the header, cells are read as text and cast leniently afterwards. Files read
together must share one header: each is checked, so none is misread. Files with different headers
are read apart and put together with ``union_sources``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from civicpulse.functions.fixed_values import REGION_COLUMNS
from civicpulse.functions.numbers import to_number
from civicpulse.operators.quality import lenient_cast, missing_cells, normalise_trends, require_columns
from civicpulse.operators.reshape import melt_regions, topic_series
from civicpulse.session import literal_table
from civicpulse.sources.files import file_name, file_names

Paths = str | list[str]


def _csv(spark: SparkSession) -> DataFrameReader:
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return reader.option("escape", '"')


def read_trend_dir(
    spark: SparkSession,
    path: Paths,
    topics: dict[str, str],
    regions: Sequence[str] = REGION_COLUMNS,
) -> DataFrame:
    """Wide trend files (a date and one column per region), each tagged with its topic.

    Other columns are left out. ``topics`` maps file names to topics; a file it does not list is an error.
    """
    raw = require_columns(_csv(spark).csv(path), ["date", *regions])
    unknown = sorted(file_names(raw) - set(topics))
    if unknown:
        raise ValueError(f"no topic for files: {unknown}")
    names = literal_table(spark, sorted(topics.items()), ["file_name", "topic_name"])
    tagged = raw.select("*", file_name()).join(names, "file_name", "left")
    # No row may get lost, should a file be added after the check.
    no_topic = F.raise_error(F.concat(F.lit("no topic for file: "), F.col("file_name")))
    return tagged.select(
        F.col("date").try_cast("date").alias("date"),
        F.coalesce("topic_name", no_topic).alias("topic_name"),
        *[to_number(F.col(f"`{r}`")).alias(r) for r in regions],
    )


def merge_trend_dir(
    spark: SparkSession,
    path: Paths,
    topics: dict[str, str],
    regions: Sequence[str] = REGION_COLUMNS,
) -> DataFrame:
    """A directory of wide trend files to one long trend table."""
    long = melt_regions(read_trend_dir(spark, path, topics, regions), regions)
    return lenient_cast(long.withColumn("region_name", F.col("region")))


def read_trend_long(spark: SparkSession, path: Paths, clamp: bool = False) -> DataFrame:
    """Long trend files under either set of column names, cast and cleaned."""
    return normalise_trends(missing_cells(_csv(spark).csv(path)), clamp=clamp)


def read_counts(spark: SparkSession, path: Paths) -> DataFrame:
    """Daily counts, one column per topic, to (topic, date, value)."""
    long = topic_series(_csv(spark).csv(path))
    return long.select(
        "topic", F.col("date").try_cast("date").alias("date"), to_number(F.col("value")).alias("value")
    )
