"""Every registered query with a SQL form equals DuckDB on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as contract
import oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the shared tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(contract.queries()[name](spark, FOLDER), con, contract.oracle_sql()[name]) == ""


def test_entry(spark):
    assert contract.entry(spark).count() == 3
