"""Region boundaries from GeoJSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse.functions.fixed_values import CODE_PROPERTIES, NAME_PROPERTIES
from civicpulse.functions.geometry import read_polygons
from civicpulse.functions.labels import first_non_empty
from civicpulse.sources.files import file_name
from civicpulse.sources.large_geojson import read_large_features

# Coordinates stay text until the geometry type is known: their depth depends on it.
FEATURE_COLLECTION = (
    "features array<struct<properties: map<string,string>, "
    "geometry: struct<type: string, coordinates: string>>>"
)


def read_boundaries(
    spark: SparkSession, path: str | list[str], multi_line: bool = True, large_files: bool = False
) -> DataFrame:
    """One row per feature: its place in the file, properties, code, name and polygons.

    With ``multi_line`` off, every line of a file is a feature collection of its own. ``large_files`` reads
    each file, one collection, by a task per block and never holds more than a feature.
    """
    if large_files:
        return with_polygons(read_large_features(spark, path))
    raw = spark.read.schema(FEATURE_COLLECTION).option("multiLine", multi_line).json(path)
    features = raw.select(
        file_name(),
        F.posexplode("features").alias("feature_pos", "feature"),
    )
    return with_polygons(
        features.select("file_name", "feature_pos", "feature.properties", "feature.geometry")
    )


def with_polygons(features: DataFrame) -> DataFrame:
    """Add code, name and polygons to rows of properties and geometry."""
    properties = F.col("properties")
    return features.withColumns(
        {
            "region_code": first_non_empty(*[properties[p] for p in CODE_PROPERTIES]),
            "region_name": first_non_empty(*[properties[p] for p in NAME_PROPERTIES]),
            "polygons": read_polygons(F.col("geometry.type"), F.col("geometry.coordinates")),
        }
    ).drop("geometry")
