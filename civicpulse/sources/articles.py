"""News search responses landed as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse.sources.files import file_name

RESPONSE = (
    "search_query string, articles array<struct<source: struct<id: string, name: string>, "
    "author: string, title: string, description: string, url: string, urlToImage: string, "
    "publishedAt: string, content: string>>"
)


def read_articles(
    spark: SparkSession, path: str | list[str], multi_line: bool = True
) -> DataFrame:
    """One row per article of each response, with its search query and its position.

    The query is a field of the response or a ``search_query=...`` folder. A response without
    articles gives no rows. With ``multi_line`` off, every line of a file is one response.
    """
    responses = spark.read.schema(RESPONSE).option("multiLine", multi_line).json(path)
    return responses.select(
        "search_query",
        file_name(),
        F.posexplode("articles").alias("pos", "article"),
    ).select("search_query", "file_name", "pos", "article.*")
