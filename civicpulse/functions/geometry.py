"""Geometry column expressions over GeoJSON coordinates.

A geometry is an array of polygons, a polygon an array of rings, a ring an array of
``[lon, lat]`` points; a plain polygon is held as a one-polygon geometry. Points that cannot
be read are NULL, so a ring keeps its written length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicpulse.functions.numbers import is_finite


def read_polygons(kind: Column, coordinates: Column) -> Column:
    """Coordinates text of a Polygon or MultiPolygon to polygons; NULL for other types."""
    # Rings stay text at first: each is then parsed on its own.
    polygon = "array<string>"
    rings = F.when(kind == "Polygon", F.array(F.from_json(coordinates, polygon))).when(
        kind == "MultiPolygon", F.from_json(coordinates, f"array<{polygon}>")
    )
    return F.transform(rings, lambda polygon: F.transform(polygon, _read_ring))


def _read_ring(text: Column) -> Column:
    whole = F.from_json(text, "array<array<string>>")
    # A point that is no array voids the whole ring, so such a ring is parsed point by point.
    by_point = F.transform(
        F.from_json(text, "array<string>"), lambda point: F.from_json(point, "array<string>")
    )
    return F.transform(
        F.coalesce(whole, by_point),
        lambda point: F.transform(point, lambda number: number.try_cast("double")),
    )


def ring_centroid(ring: Column) -> Column:
    """Mean of the readable vertices as ``(lat, lon)``; NULL when there is none."""
    start = F.struct(
        F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")
    )

    def add(total: Column, point: Column) -> Column:
        lon, lat = F.get(point, F.lit(0)), F.get(point, F.lit(1))
        added = F.struct(
            (total["n"] + 1).alias("n"),
            (total["lat"] + lat).alias("lat"),
            (total["lon"] + lon).alias("lon"),
        )
        return F.when(is_finite(lon) & is_finite(lat), added).otherwise(total)

    def finish(total: Column) -> Column:
        lat, lon = total["lat"] / total["n"], total["lon"] / total["n"]
        mean = F.struct(lat.alias("lat"), lon.alias("lon"))
        return F.when((total["n"] > 0) & is_finite(total["lat"]) & is_finite(total["lon"]), mean)

    return F.aggregate(ring, start, add, finish)


def geometry_centroid(polygons: Column) -> Column:
    """Centroid of the outer ring with the most written points; the first wins a tie."""
    candidates = F.transform(
        polygons,
        lambda polygon, position: F.struct(
            F.size(F.get(polygon, F.lit(0))).alias("points"),
            (-position).alias("earliest"),
            ring_centroid(F.get(polygon, F.lit(0))).alias("centroid"),
        ),
    )
    usable = F.filter(candidates, lambda c: c["centroid"].isNotNull())
    # array_max of an empty array is NULL.
    return F.array_max(usable)["centroid"]
