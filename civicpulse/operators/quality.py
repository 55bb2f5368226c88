"""Column names, required columns, lenient casts and dropping of incomplete rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from civicpulse.functions.fixed_values import MISSING_MARKERS, TREND_ALIASES, TREND_COLUMNS
from civicpulse.functions.numbers import clamp as clamp_value
from civicpulse.functions.numbers import nan_to_null, to_number


def apply_aliases(df: DataFrame, aliases: dict[str, str] = TREND_ALIASES) -> DataFrame:
    """Rename the aliases that are present; a table with both names is refused."""
    present = {old: new for old, new in aliases.items() if old in df.columns}
    clashes = sorted(new for new in present.values() if new in df.columns)
    if clashes:
        raise ValueError(f"columns present under two names: {clashes}")
    return df.withColumnsRenamed(present)


def default_region_name(df: DataFrame) -> DataFrame:
    """Use the region itself as its name when the table has no names."""
    if "region_name" in df.columns or "region" not in df.columns:
        return df
    return df.withColumn("region_name", F.col("region"))


def require_columns(df: DataFrame, names: Iterable[str] = TREND_COLUMNS) -> DataFrame:
    """The same table, or a ValueError that lists the missing columns in order."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def missing_cells(df: DataFrame) -> DataFrame:
    """NULL for text that stands for a missing cell, as cells of a CSV file may have it.

    Only for tables read from such files: in a typed table ``NA`` is a name like any other.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(MISSING_MARKERS), F.col(f"`{c}`")) for c in texts})


def lenient_cast(df: DataFrame, clamp: bool = False) -> DataFrame:
    """Cast a long trend table and drop rows without date, value, region or topic.

    Text that is no ISO date or no number counts as missing. ``clamp`` also limits the value to
    the 0-100 scale.
    """
    given = F.col("interest_value")
    is_text = isinstance(df.schema["interest_value"].dataType, StringType)
    value = to_number(given) if is_text else nan_to_null(given.cast("double"))
    return df.withColumns(
        {
            "date": F.col("date").try_cast("date"),
            "interest_value": clamp_value(value) if clamp else value,
            "region": F.col("region").cast("string"),
            "topic_name": F.col("topic_name").cast("string"),
            "region_name": F.col("region_name").cast("string"),
        }
    ).dropna(subset=["date", "interest_value", "region", "topic_name"])


def normalise_trends(df: DataFrame, clamp: bool = False) -> DataFrame:
    """Any long trend table, under either set of names, to the standard columns and types."""
    named = default_region_name(apply_aliases(df))
    return lenient_cast(require_columns(named), clamp=clamp)
