"""Parliamentary speeches from XML files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from civicpulse.operators.speeches import parse_speeches
from civicpulse.sources.files import file_name
from civicpulse.sources.large_xml import read_large_speeches


def read_speeches(spark: SparkSession, path: str | list[str], large_files: bool = False) -> DataFrame:
    """Speeches of the ``*.xml`` files of a folder; files are whole documents, one per row.

    ``large_files`` reads them as streams, each parsed once: files above 2 GB need it.
    """
    if large_files:
        return read_large_speeches(spark, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    return parse_speeches(files.select(file_name(), "content"))
