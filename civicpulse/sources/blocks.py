"""Records out of files that are split at any byte, found block by block in parallel.

A file is read as pieces between separators, so Spark splits it into blocks like any text. Whether a
separator ends a record depends on what came before in the file: on open quotes or brackets. So three
passes go over the blocks, none of which moves a text that lies in one block:

1. every block is summed up as a map from the state before it to the state after it,
2. the maps of a file, a few numbers per block, are composed in order into the state each block starts in,
3. every block is cut into records, knowing its state; only records that cross blocks are put together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse.sources.files import file_name

#: A record or a part of it: its number in the file, its text, whether it begins and ends in the block.
Part = tuple[int, str, bool, bool]

#: Cut parts that are handed on together, and the characters they may have together.
ROWS, CHARS = 5_000, 4 << 20


class Scan(Protocol):
    """How records of a format are told apart; states and summaries are made of lists, numbers and texts."""

    #: What stands between pieces, what joins the parts of a record, and the state a file starts in.
    separator: str
    glue: str
    begin: Any

    def columns(self) -> dict[str, Column]:
        """Columns made of ``value`` that the other methods look at."""

    def summary(self, batches: Iterator[pa.RecordBatch]) -> Any:
        """A map of states for one block."""

    def after(self, state: Any, summary: Any) -> Any:
        """The state after a block."""

    def cut(self, state: Any, batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
        """The records, or parts of records, of one block."""


def pieces(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """The pieces of files with the block they are in and their order in it.

    ``folder`` holds the values of ``name=value`` folders as JSON.
    """
    text = spark.read.option("lineSep", separator).text(path)
    folders = [c for c in text.columns if c != "value"]
    return text.select(
        F.col("_metadata.file_path").alias("file"), file_name(),
        (F.to_json(F.struct(*folders)) if folders else F.lit("{}")).alias("folder"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value",
    )


def in_blocks(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Batches in order, cut and grouped where one of the key columns changes."""

    def slices() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            changed = np.zeros(batch.num_rows, bool)
            for key in keys:
                values = batch.column(key).to_numpy(zero_copy_only=False)
                changed[1:] |= values[1:] != values[:-1]
            bounds = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
            for low, high in zip(bounds, bounds[1:]):
                yield tuple(batch.column(k)[low].as_py() for k in keys), batch.slice(low, high - low)

    for key, parts in groupby(slices(), key=lambda part: part[0]):
        yield key, (batch for _, batch in parts)


def _starts(rows: DataFrame, scan: Scan) -> DataFrame:
    """``file``, ``block`` and the ``state`` in which the block starts."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), parts in in_blocks(batches, "file", "block"):
            summary = json.dumps(scan.summary(parts))
            yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "summary": [summary]})

    def composed(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        states, state, blocks = [], scan.begin, blocks.sort_values("block")
        for summary in blocks["summary"]:
            states.append(json.dumps(state))
            state = scan.after(state, json.loads(summary))
        return pd.DataFrame({"file": blocks["file"], "block": blocks["block"], "state": states})

    summaries = rows.select("file", "block", *scan.columns()).mapInArrow(summed, "file string, block long, summary string")
    return summaries.groupBy("file").applyInPandas(composed, "file string, block long, state string")


def records(spark: SparkSession, path: str | list[str], scan: Scan) -> DataFrame:
    """Every record of the files: ``file``, ``file_name``, ``folder``, its number ``pos`` in the file, and ``text``.

    Blocks are as large as ``spark.sql.files.maxPartitionBytes`` says; the records are the same for any
    size. A task holds one batch of pieces and the record it is in; a record may be longer than a block.
    """
    rows = pieces(spark, path, scan.separator).withColumns(scan.columns())
    known = rows.join(_starts(rows, scan), ["file", "block"]).sortWithinPartitions("file", "block", "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, name, folder, block, state), parts in in_blocks(batches, "file", "file_name", "folder", "block", "state"):
            held, size = [], 0

            def handed() -> pa.RecordBatch:
                pos, texts, begins, ends = zip(*held)
                whole = {"file": [file] * len(held), "file_name": [name] * len(held), "folder": [folder] * len(held)}
                whole |= {"block": [block] * len(held), "pos": pos, "text": texts, "begins": begins, "ends": ends}
                return pa.RecordBatch.from_pydict(whole)

            for part in scan.cut(json.loads(state), parts):
                held.append(part)
                size += len(part[1])
                if len(held) == ROWS or size > CHARS:
                    yield handed()
                    held, size = [], 0
            if held:
                yield handed()

    schema = "file string, file_name string, folder string, block long, pos long, text string, begins boolean, ends boolean"
    parts = known.mapInArrow(cut, schema)
    names = ["file", "file_name", "folder", "pos"]
    whole = parts.where("begins AND ends").select(*names, "text")
    crossing = parts.where("NOT (begins AND ends)").groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    return whole.union(crossing.select(*names, F.array_join("parts.text", scan.glue)))


def folder_columns(spark: SparkSession, path: str | list[str]) -> list[tuple[str, str]]:
    """Names and types of the columns that ``name=value`` folders give."""
    return [(f.name, f.dataType.simpleString()) for f in spark.read.text(path).schema if f.name != "value"]


def unfolded(df: DataFrame, columns: list[tuple[str, str]]) -> list[Column]:
    """The columns held in ``folder``."""
    if not columns:
        return []
    held = F.from_json("folder", ", ".join(f"`{name}` {kind}" for name, kind in columns))
    return [held[name].alias(name) for name, _ in columns]
