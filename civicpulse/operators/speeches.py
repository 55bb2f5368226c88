"""Speech documents to rows, and attributes to columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from xml.etree.ElementTree import ParseError

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse.functions.xml import iter_speeches

SPEECH_SCHEMA = (
    "file_name string, ordinal long, attributes map<string,string>, data string, error string"
)
_COLUMNS = ["file_name", "ordinal", "attributes", "data", "error"]
_ROWS_PER_BATCH = 5_000


def parse_speeches(documents: DataFrame) -> DataFrame:
    """Rows of speeches from (file_name, content), content being XML as text or binary.

    A document that is not well formed gives one row with the error and nothing else.
    """
    return documents.select("file_name", F.col("content").cast("binary")).mapInPandas(
        _parse_batches, SPEECH_SCHEMA
    )


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for batch in batches:
        for name, content in zip(batch["file_name"], batch["content"]):
            for row in _parse_document(name, content):
                rows.append(row)
                if len(rows) == _ROWS_PER_BATCH:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=_COLUMNS)


def _parse_document(name: str, content: bytes | None) -> Iterator[tuple]:
    """The rows of a document as they are parsed; a first pass tells whether it is well formed."""
    if content is None:
        return
    try:
        for _ in iter_speeches(content):
            pass
    except ParseError as error:
        yield name, None, None, None, str(error)
        return
    for speech in iter_speeches(content):
        yield name, *speech, None


def attribute_names(speeches: DataFrame) -> DataFrame:
    """The attribute names that occur, as a table with the column ``key``."""
    return speeches.select(F.explode(F.map_keys("attributes")).alias("key")).distinct()


def promote_attributes(speeches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One column per attribute listed, NULL where a speech lacks it.

    ``attribute_names`` tells which there are.
    """
    others = [c for c in speeches.columns if c != "attributes"]
    clashes = sorted(set(keys) & set(others))
    if clashes:
        raise ValueError(f"attributes named like columns: {clashes}")
    return speeches.select(*others, *[F.col("attributes")[k].alias(k) for k in keys])


def promote_all_attributes(speeches: DataFrame) -> DataFrame:
    """``promote_attributes`` for every attribute that occurs, by name.

    The names become columns of the plan, so they are collected: they are tag vocabulary, not data.
    """
    return promote_attributes(speeches, sorted(r.key for r in attribute_names(speeches).collect()))
