"""Region dimension and centroid table from boundary features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse.functions.geometry import geometry_centroid
from civicpulse.operators.topk import keep_last

# What orders the features of a boundary table: a later feature overrides an earlier one.
FEATURE_ORDER = ("file_name", "feature_pos")


def region_dimension(
    boundaries: DataFrame,
    code_property: str = "RGN24CD",
    name_property: str = "RGN24NM",
    order: Sequence[str] = FEATURE_ORDER,
) -> DataFrame:
    """(region_code, region_name) of the features that carry the code property."""
    named = boundaries.select(
        F.col("properties")[code_property].alias("region_code"),
        F.col("properties")[name_property].alias("region_name"),
        *order,
    ).filter(F.col("region_code") != "")
    return keep_last(named, ["region_code"], order).drop(*order)


def centroids(boundaries: DataFrame, order: Sequence[str] = FEATURE_ORDER) -> DataFrame:
    """(region_code, lat, lon) of the features that have a code and a usable outer ring."""
    found = F.array_compact(F.array(geometry_centroid(F.col("polygons"))))
    # inline drops features without centroid, and works each one out once; a filter on the
    # centroid would be pushed below it and work it out again.
    located = boundaries.filter(F.col("region_code") != "").select(
        "region_code", *order, F.inline(found)
    )
    return keep_last(located, ["region_code"], order).drop(*order)
