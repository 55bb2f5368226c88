"""Label column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicpulse.functions.numbers import round_one
from civicpulse.functions.text import empty_to_null


def first_non_empty(*texts: Column) -> Column:
    """The first text that is neither NULL nor empty."""
    return F.coalesce(*[empty_to_null(t) for t in texts])


def tooltip(name: Column, code: Column, value: Column) -> Column:
    """``England (E92000001) — 12.3``; the value is left blank when missing."""
    # A decimal prints plainly at any size, where a double turns to exponents.
    shown = round_one(value).try_cast("decimal(38,1)").cast("string")
    blank = F.lit("")
    return F.concat(
        F.coalesce(name, blank), F.lit(" ("), F.coalesce(code, blank), F.lit(") — "),
        F.coalesce(shown, blank),
    )


def geography_label(geo: Column) -> Column:
    return F.when(geo == "GB", F.lit("United Kingdom")).otherwise(geo)
