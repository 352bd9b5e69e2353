"""Every registered query against its DuckDB twin, on the smallest data."""

import pytest

from __spark_entry__ import entry
from check import compare, duck
from veilspark.plans.registry import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_a_twin():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    ok, note = compare(queries()[name](spark, FOLDER), con, oracle_sql()[name])
    assert ok, note


def test_entry(spark):
    assert entry(spark).count() == 200
