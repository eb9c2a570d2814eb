"""Every core query with an SQL twin, beside DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    assert compare(spark, con, SF, name) == ""
