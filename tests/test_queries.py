"""Every registered query against its SQL on DuckDB: names, types and exact rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from tickloom.plans import catalog
from tools import check

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracles()
# Stand-in data too small to hold a case at this scale.
MAY_BE_EMPTY = {"q10_style_breaches", "o1_limit_up_report"}


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in check.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def test_catalog_needs_no_session():
    assert QUERIES and set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    names, kinds = [d[0] for d in cur.description], [str(d[1]) for d in cur.description]
    assert {f.name: check.SPARK[type(f.dataType)] for f in df.schema.fields} == {
        n: check.KINDS[k] for n, k in zip(names, kinds)}
    assert check.rows_of(got, df.columns) == check.rows_of(cur.fetchall(), names)
    assert got or name in MAY_BE_EMPTY


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
