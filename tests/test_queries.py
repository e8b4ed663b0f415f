"""Every registered query against its SQL, and against what a plan must not contain."""

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from laneflow.plans import ORACLE_SQL, QUERIES
from tests.conftest import FOLDER


@pytest.fixture(scope="module")
def tables():
    return check.duckdb_on(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(queries()) and set(ORACLE_SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, tables, name):
    assert check.compare(spark, tables, name, FOLDER) == ""


def test_entry(spark):
    rows = entry(spark)
    assert rows.count() == 10
    assert len(rows.columns) == 10
