"""Every registered query against DuckDB on the small test tables."""

import compare
import pytest

from pathweave.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    assert compare.type_mismatches(df, con, catalog.ORACLES[name]) == {}
    assert compare.spark_rows(df) == compare.duck_rows(con, catalog.ORACLES[name])


def test_all_queries_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
