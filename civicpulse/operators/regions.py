"""Interest per region, region codes, and binding of values to map shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse.functions.fixed_values import REGION_CODES
from civicpulse.functions.labels import tooltip
from civicpulse.functions.numbers import mean_of
from civicpulse.session import literal_table

def select_trends(trends: DataFrame, topic: str, day: str) -> DataFrame:
    """The rows of one topic and one calendar day."""
    return trends.filter((F.col("topic_name") == topic) & (F.col("date") == F.lit(day).cast("date")))


def region_values(
    trends: DataFrame,
    how: str = "mean",
    keys: Sequence[str] = ("topic_name", "date"),
    tie: str | None = None,
) -> DataFrame:
    """One interest value per region for every combination of the keys.

    ``how`` is ``mean``, ``sum`` or ``latest``. For ``latest`` leave the date out of the keys to
    get the newest day of each region. Of several rows on that day the one with the highest
    ``tie`` counts (a column without repeats within a day, such as a row id); without ``tie`` it
    is the largest value.
    """
    value = F.col("interest_value")
    if how == "mean":
        return _per_region(trends, keys, mean_of(value))
    if how == "sum":
        return _per_region(trends, keys, F.sum(value).cast("double"))
    if how != "latest":
        raise ValueError(f"how must be mean, sum or latest, not {how!r}")
    # Days first: both steps aggregate fixed-width values, so neither needs a sort.
    newest = F.max_by("interest_value", tie) if tie else F.max("interest_value")
    daily = _per_region(trends, [*[k for k in keys if k != "date"], "date"], newest.cast("double"))
    if "date" in keys:
        return daily
    return daily.groupBy(*keys, "region").agg(
        F.max("date").alias("date"), F.max_by("interest_value", "date").alias("interest_value")
    )


def _per_region(trends: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    return trends.groupBy(*keys, "region").agg(value.alias("interest_value"))


def region_code_table(
    spark: SparkSession, codes: dict[str, str] = REGION_CODES
) -> DataFrame:
    """(region, region_code) from a mapping of names to codes."""
    return literal_table(spark, sorted(codes.items()), ["region", "region_code"])


def region_lookup(values: DataFrame, codes: DataFrame) -> DataFrame:
    """Add ``region_code``: the code of a region name, a code as it is, else NULL."""
    named = codes.select("region", "region_code")
    as_is = codes.select(F.col("region_code").alias("region"), "region_code")
    return values.join(named.union(as_is).distinct(), "region", "left")


def region_map_values(values: DataFrame, codes: DataFrame) -> DataFrame:
    """Values that can be drawn on a map: regions without a code are dropped.

    A region that ``values`` holds under its name and under its code keeps both rows;
    ``mapped_values`` combines them.
    """
    return region_lookup(values, codes).filter(F.col("region_code").isNotNull())


def mapped_values(
    trends: DataFrame,
    codes: DataFrame,
    how: str = "mean",
    keys: Sequence[str] = ("topic_name", "date"),
    tie: str | None = None,
) -> DataFrame:
    """``region_values`` per region code, however a row names its region.

    Rows are reduced per region text before the code is looked up, and what is left is combined
    per code. Regions without a code are dropped.
    """
    value = F.col("interest_value")
    if how in ("mean", "sum"):
        parts = trends.groupBy(*keys, "region").agg(F.sum(value).alias("total"), F.count(value).alias("n"))
        total, n = F.sum("total").cast("double"), F.sum("n").cast("double")
        whole = F.try_divide(total, n) if how == "mean" else total
        return region_map_values(parts, codes).groupBy(*keys, "region_code").agg(whole.alias("interest_value"))
    if how != "latest":
        raise ValueError(f"how must be mean, sum or latest, not {how!r}")
    days = [*[k for k in keys if k != "date"], "date"]
    order = F.col(tie) if tie else value
    parts = trends.groupBy(*days, "region").agg(F.max_by(value, order).alias("newest"), F.max(order).alias("order"))
    daily = region_map_values(parts, codes).groupBy(*days, "region_code").agg(
        F.max_by("newest", "order").cast("double").alias("interest_value")
    )
    if "date" in keys:
        return daily
    return daily.groupBy(*keys, "region_code").agg(
        F.max("date").alias("date"), F.max_by("interest_value", "date").alias("interest_value")
    )


def choropleth_table(
    shapes: DataFrame,
    values: DataFrame,
    on: str = "region_code",
    keys: Sequence[str] = ("topic_name", "date"),
    tips: DataFrame | None = None,
) -> DataFrame:
    """Map shapes with their values and tooltips: ``shapes`` LEFT JOIN ``values``.

    ``values`` has one row per region for each combination of the keys. ``on`` binds them to shapes
    by ``region_code`` or by ``region_name``. A shape has a row for each combination that fills it,
    and one row with NULL keys and value if none does. For one selection, filter its values and
    pass no keys: every shape then has one row. Values without a shape are left out.

    ``tips`` (keys, ``region_name``, ``interest_value``) gives the tooltip's value by name, where
    that differs from the value that fills the shape.
    """
    dims = shapes.select("region_code", "region_name")
    value = F.col("interest_value").cast("double").alias("interest_value")
    table = dims.join(values.select(on, *keys, value), on, "left")
    shown = F.col("interest_value")
    if tips is not None:
        tip = F.col("interest_value").cast("double").alias("tip")
        named = tips.select(F.col("region_name").alias("tip_name"), *[F.col(k).alias(f"tip_{k}") for k in keys], tip)
        match = F.col("region_name") == F.col("tip_name")
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"tip_{k}"))
        table, shown = table.join(named, match, "left"), F.col("tip")
    # A shape without a name or code binds to nothing, but is drawn all the same.
    name, code = F.coalesce("region_name", F.lit("")), F.coalesce("region_code", F.lit(""))
    return table.select(
        *keys, code.alias("region_code"), name.alias("region_name"), "interest_value",
        tooltip(name, code, shown).alias("tooltip"),
    )
