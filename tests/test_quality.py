import datetime as dt

import pytest
from pyspark.sql import functions as F

from civicpulse.functions.numbers import clamp, round_one, round_to, to_number
from civicpulse.operators.quality import (
    missing_cells,
    apply_aliases,
    lenient_cast,
    normalise_trends,
    require_columns,
)
from civicpulse.operators.reshape import melt_regions, topic_series, union_sources

LONG = "date string, topic_name string, region string, region_name string, interest_value string"


def test_aliases_and_default_name(rows):
    raw = rows.make("date string, Program string, region string, value string",
                    ("2025-01-01", "HS2", "Wales", "7"))
    assert rows.get(normalise_trends(raw), "date", "topic_name", "region", "region_name", "interest_value") == [
        (dt.date(2025, 1, 1), "HS2", "Wales", "Wales", 7.0)
    ]


def test_alias_beside_its_target_is_refused(rows):
    raw = rows.make("value string, interest_value string", ("1", "2"))
    with pytest.raises(ValueError, match="interest_value"):
        apply_aliases(raw)


def test_missing_columns_are_listed_in_order(rows):
    with pytest.raises(ValueError, match=r"\['interest_value', 'region_name', 'topic_name'\]"):
        require_columns(rows.make("date string, region string", ("a", "b")))


def test_unreadable_cells_drop_the_row(rows):
    good = ("2025-01-01", "HS2", "Wales", "Wales", "1")
    bad = [
        ("bad", "HS2", "Wales", "Wales", "1"),
        ("2025-02-30", "HS2", "Wales", "Wales", "1"),
        ("2025-01-01", "HS2", "Wales", "Wales", "x"),
        ("2025-01-01", "HS2", "Wales", "Wales", "NaN"),
        ("2025-01-01", "HS2", None, "Wales", "1"),
        (None, "HS2", "Wales", "Wales", "1"),
    ]
    assert len(rows.get(lenient_cast(rows.make(LONG, good, *bad)))) == 1


def test_missing_markers_count_in_cells_of_files_only(rows):
    named = rows.make(LONG, ("2025-01-01", "NA", "None", "null", "1"))
    assert rows.get(lenient_cast(named), "topic_name", "region", "region_name") == [("NA", "None", "null")]
    assert rows.get(lenient_cast(missing_cells(named))) == []


def test_typed_columns_are_taken_as_they_are(rows):
    typed = rows.make("date date, topic_name string, region string, region_name string, interest_value double",
                      (dt.date(2025, 1, 1), "HS2", "Wales", "Wales", 1e10),
                      (dt.date(2025, 1, 1), "HS2", "Wales", "Wales", float("nan")))
    assert rows.get(lenient_cast(typed), "date", "interest_value") == [(dt.date(2025, 1, 1), 1e10)]


def test_a_missing_region_name_keeps_the_row(rows):
    assert len(rows.get(lenient_cast(rows.make(LONG, ("2025-01-01", "HS2", "Wales", None, "1"))))) == 1


@pytest.mark.parametrize(
    ("text", "number"),
    [("12", 12.0), (" 1.5 ", 1.5), ("1e3", 1000.0), ("1d", None), ("2.f", None), ("", None), ("nan", None)],
)
def test_to_number(spark, text, number):
    assert spark.range(1).select(to_number(F.lit(text))).first()[0] == number


def test_clamp(rows):
    df = rows.make("v double", (-1.0,), (50.0,), (101.0,), (None,))
    assert [r[0] for r in df.select(clamp(F.col("v"))).collect()] == [0.0, 50.0, 100.0, None]


@pytest.mark.parametrize(("value", "places", "rounded"), [(0.25, 1, 0.2), (2.5, 0, 2.0), (6.604, 2, 6.6), (0.75, 1, 0.8)])
def test_round_to_even(spark, value, places, rounded):
    assert spark.range(1).select(round_to(F.lit(value), places)).first()[0] == rounded


def test_round_one_equals_python(spark):
    numbers = [n / 20 for n in range(-400, 4000)] + [n / 7 for n in range(300)] + [1e15 + 0.25, 1e-9, 5e-324, 1e300]
    df = spark.createDataFrame([(n,) for n in numbers], "v double")
    rounded = [r[0] for r in df.select(round_one(F.col("v"))).collect()]
    assert rounded == [round(n, 1) for n in numbers]


def test_melt_keeps_empty_cells(rows):
    wide = rows.make("date string, topic_name string, England int, Wales double",
                     ("d1", "HS2", 5, None), ("d2", "HS2", 4, 1.5))
    long = melt_regions(wide, ["England", "Wales"])
    assert rows.get(long) == [
        ("d1", "HS2", "England", 5.0), ("d1", "HS2", "Wales", None),
        ("d2", "HS2", "England", 4.0), ("d2", "HS2", "Wales", 1.5),
    ]


def test_partial_flag_is_dropped_but_not_its_row(rows):
    wide = rows.make("date string, HS2 int, isPartial boolean", ("d1", 5, False), ("d2", 4, True))
    assert rows.get(topic_series(wide)) == [("HS2", "d1", 5), ("HS2", "d2", 4)]


def test_union_fills_missing_columns(rows):
    union = union_sources(rows.make("a int, b int", (1, 2)), rows.make("b int, c int", (3, 4)))
    assert rows.get(union) == [(1, 2, None), (None, 3, 4)]
