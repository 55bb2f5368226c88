"""Social posts from CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse.functions.dates import parse_utc, utc_day
from civicpulse.functions.numbers import to_number
from civicpulse.operators.quality import require_columns
from civicpulse.sources.large_csv import read_large_csv

POST_COLUMNS = [
    "topic", "created_at", "month", "author", "text", "likes", "reposts", "replies",
]


def read_posts(
    spark: SparkSession, path: str | list[str], multi_line: bool = True, large_files: bool = False
) -> DataFrame:
    """Posts with a readable time, and the UTC day of each.

    Post texts contain line breaks, so a file is read by one task unless ``multi_line`` is off.
    ``large_files`` reads each file by a task per block, at the price of two more passes over it.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    whole = reader.option("multiLine", multi_line).option("escape", '"')
    raw = read_large_csv(spark, path) if large_files else whole.csv(path)
    created = parse_utc(F.col("created_at"))
    counts = {c: to_number(F.col(c)).try_cast("long") for c in ("likes", "reposts", "replies")}
    return (
        require_columns(raw, POST_COLUMNS)
        .withColumns({"created_at": created, **counts})
        .dropna(subset=["created_at"])
        .withColumn("day", utc_day(F.col("created_at")))
    )
