"""Every registered query against the SQL that states the same result."""

import pytest

import __spark_entry__ as contract
from tagloom.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

#: What differs between tables may agree in a small one.
SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_contract(spark):
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert set(QUERIES) == set(ORACLES) and set(contract.oracle_sql()) <= set(contract.queries())
    df = contract.entry(spark)
    assert df.columns[:2] == ["RowID", "Sentiment"] and df.count() == 200
