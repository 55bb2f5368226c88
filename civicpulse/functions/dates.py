"""Date column expressions. All of them expect the session time zone to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_utc(text: Column) -> Column:
    """ISO text, with ``Z``, an offset or nothing, to a timestamp; NULL if unreadable."""
    return text.try_cast("timestamp")


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)


def week_start(day: Column) -> Column:
    """The Monday on or before a day."""
    return F.trunc(day, "week")


def week_end(day: Column) -> Column:
    """The Sunday on or after a day."""
    return F.date_add(F.trunc(day, "week"), 6)


def month_key(day: Column) -> Column:
    """``2025-01``."""
    return F.date_format(day, "yyyy-MM")


def month_label(day: Column) -> Column:
    """``January 2025``."""
    return F.date_format(day, "MMMM yyyy")


def month_number(label: Column) -> Column:
    """Month number from a label such as ``December 2025`` or ``december``; NULL if unknown."""
    name = F.element_at(F.split(F.trim(label), r"\s+"), 1)
    return F.month(F.try_to_timestamp(F.initcap(name), F.lit("MMMM")))


def month_first(day: Column) -> Column:
    return F.trunc(day, "month")


def month_next(day: Column) -> Column:
    """First day of the following month: with ``month_first`` the half-open month bounds."""
    return F.add_months(F.trunc(day, "month"), 1)


def long_date(day: Column) -> Column:
    """``04 July 2024``."""
    return F.date_format(day, "dd MMMM yyyy")


def iso_date(day: Column) -> Column:
    """``2024-07-04``."""
    return F.date_format(day, "yyyy-MM-dd")


def iso_minute(ts: Column) -> Column:
    """``2024-07-04 09:30``."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm")
