"""Every registered query against its SQL counterpart, over the smallest tables."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from civicpulse.plans.oracles import ORACLES
from civicpulse.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert differences(queries()[name](spark, SF_DIR), connection, oracle_sql()[name]) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())


def test_entry_has_a_row_per_topic(spark):
    assert entry(spark).count() == 10
