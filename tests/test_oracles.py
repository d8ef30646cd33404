"""Every catalog query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from rasterloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)
    other = duck.sql(catalog.ORACLES[name])
    at = [other.columns.index(c) for c in cols]
    assert len(other.columns) == len(cols)
    assert rows == sorted((tuple(r[i] for i in at) for r in other.fetchall()), key=repr)


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
