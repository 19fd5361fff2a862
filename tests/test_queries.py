"""Every registered query against its SQL, over the smallest given tables."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", queries())
def test_query_equals_sql(spark, connection, name):
    assert compare(spark, connection, name, SF_DIR) == ""


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert {r["match_type"]: r["pairs"] for r in entry(spark).collect()} == {
        "Exact firstname+lastname+dob+gender": 1,
        "hc-firstname+hc-lastname | Exact DOB+gender": 2,
        "lc firstname+lastname + hc-address  | Exact DOB+gender": 1,
        "Fuzzy Match on Lastname": 117,
        "No Match": 779,
    }
