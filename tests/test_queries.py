"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle_check import compare, connect

from chartledger.plans.catalog import all_oracles, all_queries

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name not in ORACLES:
        assert df.count() > 0
        return
    same, note, _rows = compare(df, con, ORACLES[name])
    assert same, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
