"""Table writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
    rows_per_file: int = 0,
) -> None:
    """Write as Parquet, or as CSV with a header and quotes doubled inside quoted text.

    ``rows_per_file`` limits files that can only be read whole, such as CSV with line breaks.
    """
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"format must be parquet or csv, not {fmt!r}")
    # Rows of a partition value meet in few tasks, large values in several, so files stay few.
    gathered = df.hint("rebalance", *partition_by) if partition_by else df
    writer = gathered.write.mode(mode).partitionBy(*partition_by)
    writer = writer.option("maxRecordsPerFile", rows_per_file)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)
