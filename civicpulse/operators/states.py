"""Weekly and monthly means and totals that grow by loads, and profiles that are merged from sketches.

What is stored per key and period is a state, (total, count, rows), that two loads' states add up to. A
table of states has a folder per period, so a load rewrites the periods it has rows in and no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse.functions.dates import month_first, month_key, week_end
from civicpulse.operators.series import fill_weeks

#: States are sums of these.
_SUMS = ("total", "n_values", "n_rows")

#: How many registers the sketches of a profile have, as a power of two: 4,096, an error of about 1.6 %.
SKETCH_BITS = 12


def weekly_states(trends: DataFrame, keys: Sequence[str] = ("topic_name", "region")) -> DataFrame:
    """States per key and week, the week named by the Sunday that ends it."""
    return _states(trends, keys, week_end(F.col("date")), F.col("interest_value"))


def monthly_states(counts: DataFrame, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """States per key and month, the month named by its first day."""
    return _states(counts, keys, month_first(F.col("date")), F.col("value"))


def _states(df: DataFrame, keys: Sequence[str], period: Column, value: Column) -> DataFrame:
    return df.groupBy(*keys, period.alias("period")).agg(
        F.sum(value).alias("total"), F.count(value).alias("n_values"), F.count("*").alias("n_rows")
    )


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One state per key and period out of those of any loads."""
    merged = states.groupBy(*keys, "period").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return merged.where("n_rows > 0")


def add_load(spark: SparkSession, path: str, load: str, states: DataFrame) -> list:
    """Add a load's states to the table at ``path``, made by the first load; returns the periods rewritten.

    A load that is already there is replaced, so a run that broke off can be repeated. Rewritten are the
    periods that the load has rows in, now or before; their number is bounded by the calendar.
    """
    keys = [c for c in states.columns if c not in ("period", *_SUMS)]
    new = states.withColumn("load", F.lit(load)).checkpoint()
    touched = new.select("period").distinct()
    if _exists(spark, path):
        stored = spark.read.schema(new.schema).parquet(path)
        touched = touched.union(stored.where(F.col("load") == load).select("period").distinct()).distinct()
    periods = [r.period for r in touched.collect()]
    if _exists(spark, path):
        named = F.col("period").isin([p for p in periods if p is not None])
        here = named | F.col("period").isNull() if None in periods else named
        own = F.col("load") == load
        kept = [F.when(~own, F.col(c)).otherwise(F.lit(0)).cast(new.schema[c].dataType).alias(c) for c in _SUMS]
        rest = stored.where(here).select(*keys, "period", *kept, "load")
        both = rest.union(new.select(*rest.columns)).groupBy(*keys, "period", "load")
        sums = [F.sum(c).cast(new.schema[c].dataType).alias(c) for c in _SUMS]
        # Read before its folders are replaced.
        new = both.agg(*sums).checkpoint()
    writer = new.hint("rebalance", "period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("period").parquet(path)
    return periods


def read_states(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The merged states of a table."""
    stored = spark.read.parquet(path)
    return merge_states(stored.withColumn("period", F.col("period").cast("date")), keys)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def weekly_from_states(states: DataFrame, keys: Sequence[str] = ("topic_name", "region"), dense: bool = True) -> DataFrame:
    """What ``weekly_series`` gives for all rows that the states were made of."""
    mean = F.try_divide(F.col("total").cast("double"), F.col("n_values").cast("double"))
    weekly = states.select(*keys, F.col("period").alias("week_end"), mean.alias("interest_value"))
    return fill_weeks(weekly, keys) if dense else weekly


def monthly_from_states(states: DataFrame, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """What ``monthly_rollup`` gives for all rows that the states were made of."""
    return states.select(*keys, month_key(F.col("period")).alias("month"), F.col("total").cast("long").alias("total"))


def profile_sketch(trends: DataFrame) -> DataFrame:
    """One row to store per load: date range, rows, and sketches of the regions and topics."""
    return trends.agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.hll_sketch_agg(F.col("region").cast("string"), SKETCH_BITS).alias("regions"),
        F.hll_sketch_agg(F.col("topic_name").cast("string"), SKETCH_BITS).alias("topics"),
        F.count("*").alias("n_rows"),
    )


def profile_from_sketches(sketches: DataFrame) -> DataFrame:
    """``profile_trends`` of all loads from a row of each; the distinct numbers are estimates.

    Two loads that share regions or topics count them once. Small numbers come out exact.
    """

    def distinct(name: str) -> Column:
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(name)), F.lit(0)).cast("long")

    return sketches.agg(
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        distinct("regions").alias("n_regions"),
        distinct("topics").alias("n_topics"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
    )
