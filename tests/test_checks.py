"""Every named query against its check query on the smallest data."""

import pytest

from compare import compare, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_registry_is_consistent():
    assert set(CHECKS) <= set(QUERIES)
    assert len(QUERIES) > 250


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "circuit_status" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    _, rows, problems = compare(spark, con, name, QUERIES, CHECKS, FOLDER)
    assert not problems, problems
