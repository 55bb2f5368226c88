"""Run queries against their SQL counterparts: ``python tests/compare.py [sf_dir] [names...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(float(f"{value:.12g}"))
    return repr(value)


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark_df, connection, sql: str) -> list[str]:
    """What differs in columns, types of cells, or rows; empty when equal."""
    ours_rows = spark_df.collect()
    relation = connection.sql(sql)
    theirs_rows = relation.fetchall()
    found = []
    if sorted(spark_df.columns) != sorted(relation.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(relation.columns)}"]
    if len(ours_rows) != len(theirs_rows):
        found.append(f"rows {len(ours_rows)} != {len(theirs_rows)}")
    ours = sorted_rows(spark_df.columns, ours_rows)
    theirs = sorted_rows(relation.columns, theirs_rows)
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        found.append(f"{len(different)} rows differ, first {different[0]}")
    return found


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    from __spark_entry__ import oracle_sql, queries
    from civicpulse.session import local_session

    spark, connection = local_session(8), connect(sf_dir)
    bad = 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            found = differences(run(spark, sf_dir), connection, oracle_sql()[name])
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:800]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok':5s}{name:30s}{time.time() - started:7.2f}s", *found, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
