"""Every registered query at the smallest scale, against DuckDB where there is SQL for it."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


def test_checks_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    assert compare(spark, connection, FOLDER, name, queries()[name], oracle_sql().get(name)) == ""


def test_entry(spark):
    assert entry(spark).count() > 0
