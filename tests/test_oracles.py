"""Every registered query runs, and equals its SQL where it has one."""

import pytest
from compare import compare, oracle

from gridmere.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return oracle(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, con, name):
    ok, rows, _, message = compare(spark, con, sf, name, QUERIES[name], ORACLES[name])
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
