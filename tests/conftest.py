import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from civicpulse.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Make a DataFrame from a schema and tuples; collect one as sorted tuples."""

    class Rows:
        @staticmethod
        def make(schema: str, *values: tuple):
            return spark.createDataFrame(list(values), schema)

        @staticmethod
        def get(df, *columns: str):
            picked = df.select(*columns) if columns else df
            return sorted((tuple(r) for r in picked.collect()), key=repr)

    return Rows
