import json

import pytest

from civicpulse.operators.geo import centroids, region_dimension
from civicpulse.sources.boundaries import read_boundaries


def feature(properties, kind, coordinates):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


@pytest.fixture
def read(spark, tmp_path):
    def write_and_read(*features):
        path = tmp_path / "shapes.geojson"
        path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
        return read_boundaries(spark, str(path))

    return write_and_read


SQUARE = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]


def test_polygon_is_the_mean_of_all_written_vertices(rows, read):
    shapes = read(feature({"CTRY24CD": "E1", "CTRY24NM": "England"}, "Polygon", [SQUARE, [[9, 9]]]))
    assert rows.get(shapes, "region_code", "region_name") == [("E1", "England")]
    assert rows.get(centroids(shapes)) == [("E1", 0.8, 0.8)]  # the closing vertex counts twice


def test_multipolygon_takes_the_longest_outer_ring_and_the_first_of_equals(rows, read):
    longest = [[10, 50]] * 6
    two = read(
        feature({"CTRY24CD": "A"}, "MultiPolygon", [[SQUARE], [longest]]),
        feature({"CTRY24CD": "B"}, "MultiPolygon", [[[[1, 2]] * 5], [[[3, 4]] * 5]]),
    )
    assert rows.get(centroids(two)) == [("A", 50.0, 10.0), ("B", 2.0, 1.0)]


def test_unreadable_points_are_skipped_but_count_for_the_length(rows, read):
    ring = [[1, 2], None, [5], ["x", 1], [None, 3], 7, ["3", 4]]
    shapes = read(
        feature({"CTRY24CD": "A"}, "MultiPolygon", [[ring], [[[9, 9]] * 6]]),
        # The longest ring has no usable point, so the other one is taken.
        feature({"CTRY24CD": "B"}, "MultiPolygon", [[[None] * 9], [[[9, 8]] * 2]]),
    )
    assert rows.get(centroids(shapes)) == [("A", 3.0, 2.0), ("B", 8.0, 9.0)]


def test_features_without_a_place_are_left_out(rows, read):
    shapes = read(
        feature({"CTRY24CD": "P"}, "Point", [1, 2]),
        feature({"CTRY24CD": "E"}, "Polygon", []),
        feature({"CTRY24CD": "M"}, "MultiPolygon", [[]]),
        feature({"CTRY24CD": "N"}, "Polygon", [[None, [1]]]),
        feature({"OTHER": "X"}, "Polygon", [SQUARE]),
        {"type": "Feature", "properties": {"CTRY24CD": "G"}, "geometry": None},
    )
    assert shapes.count() == 6
    assert rows.get(centroids(shapes)) == []


def test_a_later_usable_feature_of_a_code_wins(rows, read):
    shapes = read(
        feature({"CTRY24CD": "A"}, "Polygon", [[[1, 1]]]),
        feature({"CTRY24CD": "A"}, "Polygon", [[[2, 2]]]),
        feature({"CTRY24CD": "A"}, "Polygon", [[None]]),
    )
    assert rows.get(centroids(shapes)) == [("A", 2.0, 2.0)]


def test_region_properties_stand_in_for_empty_country_ones(rows, read):
    shapes = read(
        feature({"CTRY24CD": "", "RGN24CD": "E12000001", "RGN24NM": "North East"}, "Polygon", [SQUARE]),
        feature({"CTRY24CD": "W9", "CTRY24NM": "Wales"}, "Polygon", [SQUARE]),
        feature({"RGN24CD": "E12000001", "RGN24NM": "North-East"}, "Polygon", [SQUARE]),
    )
    assert rows.get(shapes, "region_code")[0] == ("E12000001",)
    assert rows.get(region_dimension(shapes)) == [("E12000001", "North-East")]
    assert [r[0] for r in rows.get(centroids(shapes))] == ["E12000001", "W9"]
