"""Every registered query against its DuckDB twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_queries import TABLES, compare
from spendlens.plans import catalog

QUERIES = entry_points.queries()
ORACLE = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, small, name):
    note, _, ok = compare(spark, con, name, QUERIES[name], ORACLE.get(name), small)
    assert ok, note


def test_every_query_of_the_library_has_check_sql():
    """Training-data queries that SQL cannot say are listed by their own tests."""
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
