import datetime as dt

import pytest

from civicpulse.operators.frames import heat_frames, heat_points, sparkline_series
from civicpulse.operators.profile import coverage, date_catalog, profile_trends, topic_catalog
from civicpulse.operators.regions import (
    choropleth_table,
    mapped_values,
    region_code_table,
    region_lookup,
    region_map_values,
    region_values,
    select_trends,
)
from civicpulse.plans.reports import selected_map

D1, D2 = dt.date(2025, 1, 1), dt.date(2025, 1, 8)
TRENDS = "topic_name string, date date, region string, interest_value double, row_id long"


@pytest.fixture
def trends(rows):
    return rows.make(
        TRENDS,
        ("HS2", D1, "England", 10.0, 1), ("HS2", D1, "England", 4.0, 2), ("HS2", D1, "Wales", 2.0, 3),
        ("HS2", D2, "England", 3.0, 5), ("HS2", D2, "England", 8.0, 4), ("S", D1, "Narnia", 1.0, 6),
    )


def test_mean_sum_latest(rows, trends):
    day = select_trends(trends, "HS2", "2025-01-01")
    assert rows.get(region_values(day, "mean"), "region", "interest_value") == [("England", 7.0), ("Wales", 2.0)]
    assert rows.get(region_values(day, "sum"), "region", "interest_value") == [("England", 14.0), ("Wales", 2.0)]
    assert rows.get(region_values(day, "latest"), "region", "interest_value") == [("England", 10.0), ("Wales", 2.0)]
    with pytest.raises(ValueError):
        region_values(day, "median")


def test_latest_over_a_range(rows, trends):
    latest = region_values(trends, "latest", keys=["topic_name"], tie="row_id")
    assert rows.get(latest, "topic_name", "region", "date", "interest_value") == [
        ("HS2", "England", D2, 3.0), ("HS2", "Wales", D1, 2.0), ("S", "Narnia", D1, 1.0)
    ]


def test_results_do_not_depend_on_partitions(rows, trends):
    for how in ("mean", "sum", "latest"):
        assert rows.get(region_values(trends, how)) == rows.get(region_values(trends.repartition(7), how))


def test_codes_of_names_and_of_codes(spark, rows):
    values = rows.make("region string", ("Wales",), ("W92000004",), ("Narnia",))
    codes = region_code_table(spark)
    assert rows.get(region_lookup(values, codes), "region", "region_code") == [
        ("Narnia", None), ("W92000004", "W92000004"), ("Wales", "W92000004")
    ]
    assert region_map_values(values, codes).count() == 2


SHAPES = "region_code string, region_name string"
UK = [("E92000001", "England"), ("W92000004", "Wales"), ("S92000003", "Scotland")]


def test_shapes_with_their_values(spark, rows, trends):
    values = region_map_values(region_values(trends), region_code_table(spark))
    table = rows.get(choropleth_table(rows.make(SHAPES, *UK), values), "topic_name", "date", "region_name", "tooltip")
    assert table == [
        ("HS2", D1, "England", "England (E92000001) — 7.0"), ("HS2", D1, "Wales", "Wales (W92000004) — 2.0"),
        ("HS2", D2, "England", "England (E92000001) — 5.5"), (None, None, "Scotland", "Scotland (S92000003) — "),
    ]


@pytest.mark.parametrize("topic, day, filled", [("HS2", "2025-01-01", [7.0, None, 2.0]), ("S", "2025-01-08", [None] * 3)])
def test_a_selection_has_every_shape(spark, rows, trends, topic, day, filled):
    drawn = selected_map(trends, rows.make(SHAPES, *UK), region_code_table(spark), topic, day)
    assert [r[0] for r in rows.get(drawn.orderBy("region_name"), "interest_value")] == sorted(filled, key=repr)
    assert [r.interest_value for r in drawn.orderBy("region_name").collect()] == filled


def test_fill_by_code_and_tooltip_by_name(spark, rows):
    trends = rows.make(TRENDS, ("t", D1, "E92000001", 1.0, 1), ("t", D1, "England", 3.0, 2), ("t", D1, "Narnia", 9.0, 3))
    shapes = rows.make(SHAPES, ("E92000001", "England"), ("N", "Narnia"))
    drawn = selected_map(trends, shapes, region_code_table(spark), "t", "2025-01-01")
    assert rows.get(drawn, "region_name", "interest_value", "tooltip") == [
        ("England", 2.0, "England (E92000001) — 3.0"), ("Narnia", None, "Narnia (N) — 9.0")
    ]


def test_nameless_shapes_are_drawn_too(spark, rows, trends):
    shapes = rows.make(SHAPES, ("E92000001", "England"), ("X1", None), (None, None))
    values = region_values(select_trends(trends, "HS2", "2025-01-01")).withColumnRenamed("region", "region_name")
    assert rows.get(choropleth_table(shapes, values, on="region_name", keys=()), "tooltip", "interest_value") == [
        (" () — ", None), (" (X1) — ", None), ("England (E92000001) — 7.0", 7.0)
    ]


def test_one_row_per_code_however_it_is_named(spark, rows):
    trends = rows.make(TRENDS, ("t", D1, "England", 1.0, 1), ("t", D1, "E92000001", 3.0, 2), ("t", D1, "E92000001", 5.0, 3),
                       ("t", D2, "England", 4.0, 4), ("t", D2, "E92000001", 2.0, 5), ("t", D2, "Narnia", 9.0, 6))
    codes = region_code_table(spark)
    assert rows.get(mapped_values(trends, codes, "mean"), "date", "interest_value") == [(D1, 3.0), (D2, 3.0)]
    assert rows.get(mapped_values(trends, codes, "sum"), "date", "interest_value") == [(D1, 9.0), (D2, 6.0)]
    latest = mapped_values(trends, codes, "latest", keys=["topic_name"], tie="row_id")
    assert rows.get(latest, "region_code", "date", "interest_value") == [("E92000001", D2, 2.0)]
    assert rows.get(mapped_values(trends, codes, "latest"), "date", "interest_value") == [(D1, 5.0), (D2, 4.0)]
    with pytest.raises(ValueError):
        mapped_values(trends, codes, "median")


CENTROIDS = [("E92000001", 52.0, -1.0), ("W92000004", 52.3, -3.7), ("S92000003", 56.8, -4.2)]


def test_heat_frames_scale_each_week(spark, rows, trends):
    places = rows.make("region_code string, lat double, lon double", *CENTROIDS)
    points = heat_points(trends, places, region_code_table(spark))
    monday1, monday2 = dt.date(2024, 12, 30), dt.date(2025, 1, 6)
    assert rows.get(points, "week", "region_code", "weight") == [
        (monday1, "E92000001", 100.0), (monday1, "W92000004", 0.0),
        (monday2, "E92000001", 0.0),  # one region alone: nothing to scale
    ]
    frames = heat_frames(points).orderBy("week").collect()
    assert [(f.label, [tuple(p) for p in f.points]) for f in frames] == [
        ("2024-12-30", [("E92000001", 52.0, -1.0, 100.0), ("W92000004", 52.3, -3.7, 0.0)]),
        ("2025-01-06", [("E92000001", 52.0, -1.0, 0.0)]),
    ]


def test_name_and_code_of_a_region_are_one_point(spark, rows):
    trends = rows.make(TRENDS, ("t", D1, "Wales", 1.0, 1), ("t", D1, "W92000004", 4.0, 2),
                       ("t", D1, "W92000004", 4.0, 3), ("t", D1, "England", 0.0, 4))
    places = rows.make("region_code string, lat double, lon double", *CENTROIDS)
    series = sparkline_series(trends, places, region_code_table(spark))
    assert rows.get(series, "region_code", "interest_value") == [("E92000001", 0.0), ("W92000004", 3.0)]


def test_sparkline_gaps_and_latest(spark, rows):
    days = [dt.date(2025, 1, 1), dt.date(2025, 1, 29)]
    trends = rows.make(TRENDS, ("t", days[0], "Wales", 1.0, 1), ("t", days[1], "Wales", 2.25, 2),
                       ("t", days[0], "Narnia", 1.0, 3))
    places = rows.make("region_code string, lat double, lon double", *CENTROIDS)
    series = sparkline_series(trends, places, region_code_table(spark))
    assert rows.get(series, "week_end", "interest_value", "latest") == [
        (dt.date(2025, 1, 12), None, 2.2), (dt.date(2025, 1, 19), None, 2.2),
        (dt.date(2025, 1, 26), None, 2.2), (dt.date(2025, 1, 5), 1.0, 2.2), (dt.date(2025, 2, 2), 2.25, 2.2),
    ]


def test_profile_catalogues_coverage(spark, rows, trends):
    assert rows.get(profile_trends(trends)) == [(D1, D2, 3, 2, 6)]
    assert rows.get(profile_trends(trends, approximate=True)) == [(D1, D2, 3, 2, 6)]
    assert rows.get(profile_trends(trends.filter("false"))) == [(None, None, 0, 0, 0)]
    assert [r[0] for r in topic_catalog(trends).collect()] == ["HS2", "S"]
    assert [tuple(r) for r in date_catalog(trends).collect()] == [(D1, 4, False), (D2, 2, True)]
    requested = rows.make("topic_name string", ("HS2",), ("S",), ("absent",))
    assert rows.get(coverage(trends, requested, region_code_table(spark))) == [
        ("HS2", 5, 0, False), ("S", 1, 1, False), ("absent", 0, 0, True)
    ]
