"""GeoJSON feature collections of any size, each read by many tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse.sources.blocks import Part, records

FEATURE = "properties map<string,string>, geometry struct<type: string, coordinates: string>"

_STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
_FEATURES = re.compile("\x01\\s*:\\s*\\[")
_FLAT = re.compile("\\[[^][{}\x02]*\\]")
_MARKS = re.compile("[][{},\x02]|null")
_PLACES = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"(?:\s*:\s*\[)?|[][{}]', re.DOTALL)

#: What is open in front of an element of the features: the document, and the array of that name.
ELEMENT = "of"

_OPENING = {"{": "o", "[": "a", "\x02": "f"}


def marks(piece: str, inside: bool) -> tuple[bool, list[str]]:
    """Whether a piece ends inside a string, and its brackets, commas and nulls outside of strings.

    Lists of numbers that a piece closes itself are left out, so coordinates cost no step each. The
    bracket that opens ``"features": [`` is a mark of its own.
    """
    if inside:
        rest = _REST.match(piece)
        if rest is None:
            return True, []
        piece = piece[rest.end() :]
    piece = _STRING.sub("", piece.replace('"features"', "\x01"))
    quote = piece.find('"')
    if quote >= 0:
        piece = piece[:quote]
    piece, before = _FEATURES.sub("\x02", piece), None
    while piece != before:
        before, piece = piece, _FLAT.sub("", piece)
    return quote >= 0, _MARKS.findall(piece)


class FeatureScan:
    """Pieces end in a closing brace, which every feature does.

    A state is whether a string is open, what brackets are (o object, a array, f the array of features),
    and how many features were separated before.
    """

    separator, glue = "}", ""
    begin = [False, "", 0]

    def columns(self) -> dict[str, Column]:
        return {"value": F.concat("value", F.lit("}"))}

    def summary(self, batches: Iterator[pa.RecordBatch]) -> list:
        """For a start outside and inside of a string: the end, the brackets closed and left open, and commas.

        Commas are counted per bracket that was open before, and per level of arrays of features opened here.
        """
        sums = [[inside, 0, [], {}, {}] for inside in (False, True)]
        for batch in batches:
            for piece in batch.column("value").to_pylist():
                for own in sums:
                    own[0], found = marks(piece, own[0])
                    opened = own[2]
                    for mark in found:
                        if mark in _OPENING:
                            opened.append(_OPENING[mark])
                        elif mark in "]}":
                            if opened:
                                opened.pop()
                            else:
                                own[1] += 1
                        elif mark == "," and not opened:
                            own[3][own[1]] = own[3].get(own[1], 0) + 1
                        elif mark == "," and opened[-1] == "f":
                            level = len(opened) - own[1]
                            own[4][level] = own[4].get(level, 0) + 1
        return [[own[0], own[1], "".join(own[2]), own[3], own[4]] for own in sums]

    def after(self, state: list, summary: list) -> list:
        inside, frames, count = state
        ends, closed, opened, commas, own = summary[inside]
        if frames[:2] == ELEMENT:
            count += commas.get(str(len(frames) - 2), 0)
        count += own.get(str(2 - len(frames)), 0)
        return [ends, frames[: max(0, len(frames) - closed)] + opened, count]

    def cut(self, state: list, batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
        inside, frames, count = state
        held, begins = [], False
        for batch in batches:
            for piece in batch.column("value").to_pylist():
                was, before = inside, frames
                inside, found = marks(piece, inside)
                within = len(frames) > 2 and frames[:2] == ELEMENT
                for mark in found:
                    if mark in _OPENING:
                        if frames == ELEMENT and mark == "{":
                            held, begins, within = [piece[_start(piece, was, before) :]], True, False
                        frames += _OPENING[mark]
                    elif mark in "]}":
                        frames = frames[:-1]
                        if frames == ELEMENT and mark == "}":
                            yield count, "".join([*held, piece] if within else held), begins, True
                            held, begins, within = [], False, False
                    elif frames == ELEMENT:
                        if mark == ",":
                            count += 1
                        else:
                            yield count, mark, True, True
                if within:
                    held.append(piece)
        if held:
            yield count, "".join(held), begins, False


def _start(piece: str, inside: bool, frames: str) -> int:
    """Where the feature that begins in a piece does."""
    at = _REST.match(piece).end() if inside else 0
    for found in _PLACES.finditer(piece, at):
        mark = found.group()
        if mark == "{" and frames == ELEMENT:
            return found.start()
        if mark in "]}":
            frames = frames[:-1]
        elif mark in "[{":
            frames += _OPENING[mark]
        elif mark.endswith("["):
            frames += "f" if mark.startswith('"features"') else "a"
    raise ValueError("no feature begins in this piece")


def read_large_features(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file_name``, ``feature_pos``, ``properties`` and ``geometry`` per feature of files with one collection each.

    The document is an object; a feature that is null has a row of nulls, other values that are no objects
    have none. A file that breaks off gives the features before that.
    """
    found = records(spark, path, FeatureScan())
    return found.select(
        "file_name", F.col("pos").cast("int").alias("feature_pos"), F.from_json("text", FEATURE).alias("feature")
    ).select("file_name", "feature_pos", "feature.properties", "feature.geometry")
