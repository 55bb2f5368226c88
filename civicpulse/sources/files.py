"""Names of the files rows come from."""

from __future__ import annotations

from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_name() -> Column:
    """The name of the file of a row, as it is on disk (Spark holds it URL-encoded)."""
    encoded = F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(encoded).alias("file_name")


def file_names(df: DataFrame) -> set[str]:
    """Names of all files of a table, from the listing Spark already holds."""
    return {unquote(PurePosixPath(f).name) for f in df.inputFiles()}
