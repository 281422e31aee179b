"""Every query against its SQL statement, row for row, on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from compare import compare, tables
from tidemark.plans import registry

SF_DIR = "/root/testdata/sf0.001"
SQL = {name: sql for name, sql in entry_module.oracle_sql().items() if name in registry.QUERIES}


@pytest.fixture(scope="module")
def connection():
    return tables(SF_DIR)


def test_every_query_has_a_statement():
    assert set(SQL) == set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_statement(spark, connection, name):
    compare(entry_module.queries()[name](spark, SF_DIR), connection, SQL[name])


def test_entry(spark):
    assert entry_module.entry(spark).count() == 9
