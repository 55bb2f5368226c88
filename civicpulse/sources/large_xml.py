"""Speech files of any size: each is parsed once, as a stream, and its rows count once the file has proved whole."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from xml.etree.ElementTree import ParseError, XMLPullParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse.operators.speeches import SPEECH_SCHEMA
from civicpulse.sources.blocks import in_blocks
from civicpulse.sources.files import file_name

#: Rows of a file that are handed on together.
ROWS = 5_000

_STAGED = f"file string, {SPEECH_SCHEMA}"
_CELLS = [pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]
_NAMES = ["file", *(field.split()[0] for field in SPEECH_SCHEMA.replace("<string,string>", "").split(", "))]


class SpeechParser:
    """Speeches out of a document that is fed in parts; what a part completes comes out with it.

    Elements outside of speeches go when they end, so what is held is the open elements and one outermost
    speech. A speech carries the attributes of the root, overlaid with its own, and the text that opens its
    first child; an outer speech comes after the ones nested in it.
    """

    def __init__(self, tag: str = "speech"):
        self.tag, self.parser = tag, XMLPullParser(events=("start", "end"))
        self.open: list = []
        self.started: list[int] = []
        self.count, self.shared = 0, {}

    def feed(self, part: bytes) -> Iterator[tuple]:
        self.parser.feed(part)
        return self._events()

    def close(self) -> Iterator[tuple]:
        self.parser.close()
        return self._events()

    def _events(self) -> Iterator[tuple]:
        for event, element in self.parser.read_events():
            if event == "start":
                if not self.open:
                    self.shared = dict(element.attrib)
                self.open.append(element)
                if element.tag == self.tag:
                    self.started.append(self.count)
                    self.count += 1
                continue
            self.open.pop()
            if element.tag == self.tag:
                attributes = {k: v for k, v in (self.shared | element.attrib).items() if k != "data"}
                yield self.started.pop(), attributes, element[0].text if len(element) else None
            if not self.started and self.open:
                self.open[-1].remove(element)


def _speeches(parts: Iterator[bytes]) -> Iterator[tuple]:
    """(ordinal, attributes, data, error) of one document; the last row has the error, if there is one."""
    parser = SpeechParser()
    try:
        for part in parts:
            for speech in parser.feed(part):
                yield *speech, None
        for speech in parser.close():
            yield *speech, None
    except ParseError as error:
        yield None, None, None, str(error)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the documents whose pieces come in order, each document's after the other."""

    def documents() -> Iterator[tuple]:
        for (file, name, size), parts in in_blocks(batches, "file", "file_name", "file_size"):
            for speech in _speeches(_joined(parts, size)):
                yield file, name, *speech

    for _, rows in groupby(enumerate(documents()), key=lambda row: row[0] // ROWS):
        cells = zip(*(row for _, row in rows))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, _CELLS)], _NAMES)


def _joined(parts: Iterator[pa.RecordBatch], size: int) -> Iterator[bytes]:
    """The bytes of a file out of its pieces, the separators put back between them, and at the end if it was there."""
    read = 0
    for batch in parts:
        held = b">".join([*([b""] if read else []), *batch.column("piece").to_pylist()])
        read += len(held)
        yield held
    if read < size:
        yield b">"


def read_large_speeches(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """What ``read_speeches`` gives, of files of any size: a document is a stream, never one value.

    A file in one block is parsed where it is read; the pieces of a larger one are brought to one task in
    order, through Spark's sort, which spills. Rows are staged as they are parsed, and a row with an error
    takes back those of its file.
    """
    text = spark.read.option("lineSep", ">").option("pathGlobFilter", "*.xml").text(path)
    pieces = text.select(
        F.col("_metadata.file_path").alias("file"), file_name(), F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
        (F.col("_metadata.file_block_length") == F.col("_metadata.file_size")).alias("is_whole"), F.col("value").cast("binary").alias("piece"),
    )
    small = pieces.where("is_whole").mapInArrow(_parsed, _STAGED)
    ordered = pieces.where("NOT is_whole").repartition("file").sortWithinPartitions("file", "block", "row")
    large = ordered.mapInArrow(_parsed, _STAGED)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    empty = listed.where("length = 0").select(file_name(), F.lit("no element found: line 1, column 0").alias("error"))
    staged = small.union(large).checkpoint()
    failed = staged.where("error IS NOT NULL")
    good = staged.join(failed.select("file"), "file", "left_anti")
    return good.union(failed).drop("file").unionByName(empty, allowMissingColumns=True)
