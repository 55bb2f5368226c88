"""CSV files of any size with line breaks inside quoted cells, each read by many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse.sources.blocks import Part, folder_columns, records, unfolded

# Cells up to a comma: quoted (a quote is doubled inside, what follows the closing one is no matter) or
# not; and a quoted cell that the line doesn't close. All repeats keep what they took, so no line takes
# more than one look per character.
_INSIDE = '[^"]*+(?:""[^"]*+)*+'
_CELLS = f'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|),)*+'
_OPEN = f'"{_INSIDE}\\z'

#: Lines that end inside quotes, for a line that starts outside and for one that starts inside of them.
OPENS = f"\\A{_CELLS}{_OPEN}"
STAYS = f'\\A{_INSIDE}(?:\\z|"[^,]*+,{_CELLS}{_OPEN})'


class CsvScan:
    """A state is whether the next line starts inside quotes, how many records started before, and whether the
    file's first line ends in a carriage return: then those before line feeds go, inside cells too.
    """

    separator = glue = "\n"
    begin = [0, 0, None]

    def columns(self) -> dict[str, Column]:
        line = F.col("value")
        return {"opens": line.rlike(OPENS), "stays": line.rlike(STAYS), "returns": line.endswith("\r")}

    @staticmethod
    def _steps(batch: pa.RecordBatch) -> list[int]:
        """Per line, bit s tells whether it ends inside quotes if it starts in state s."""
        opens, stays = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int8) for c in ("opens", "stays"))
        return (opens + 2 * stays).tolist()

    def summary(self, batches: Iterator[pa.RecordBatch]) -> list:
        """Where a start outside and a start inside of quotes lead, and the records that start on the way."""
        ends, counts, returns = [0, 1], [0, 0], None
        for batch in batches:
            if returns is None:
                returns = batch.column("returns")[0].as_py()
            for step in self._steps(batch):
                for start in (0, 1):
                    counts[start] += not ends[start]
                    ends[start] = step >> ends[start] & 1
        return [ends, counts, returns]

    def after(self, state: list, summary: list) -> list:
        inside, count, returns = state
        return [summary[0][inside], count + summary[1][inside], summary[2] if returns is None else returns]

    def cut(self, state: list, batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
        inside, count, returns = state
        lines, begins = [], False
        for batch in batches:
            if returns is None:  # the file's first line
                returns = batch.column("returns")[0].as_py()
            for line, step in zip(batch.column("value").to_pylist(), self._steps(batch)):
                if not inside:
                    begins, count = True, count + 1
                lines.append(line[:-1] if returns and line.endswith("\r") else line)
                inside = step >> inside & 1
                if not inside:
                    yield count - 1, "\n".join(lines), begins, True
                    lines = []
        if lines:
            yield count - 1, "\n".join(lines), begins, False


def read_large_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The rows that Spark's multi-line reader gives for CSV files with headers, by a task per block.

    Quotes are doubled inside quoted cells, lines end in a line feed, or all with a carriage return before it. All files must have one header; another one is an error. Rows have no order.
    """
    options = {"escape": '"', "multiLine": "true"}
    columns = spark.read.options(header="true", **options).csv(path).columns
    folders = folder_columns(spark, path)
    named = {name for name, _ in folders}
    cells = [f"`{c.replace('`', '``')}` string" for c in columns if c not in named]
    parsed = records(spark, path, CsvScan()).where("text <> ''")
    parsed = parsed.select("pos", "file_name", F.from_csv("text", F.lit(", ".join(cells)), options).alias("cells"), *unfolded(parsed, folders))
    wrong = F.raise_error(F.concat(F.lit("another header in file "), F.col("file_name")))
    own = F.struct(*[F.lit(c).alias(c) for c in columns if c not in named])
    rows = parsed.where((F.col("pos") > 0) | F.when(F.col("cells").eqNullSafe(own), F.lit(False)).otherwise(wrong.cast("boolean")))
    return rows.select("cells.*", *[F.col(f"`{name}`") for name in columns if name in named])
