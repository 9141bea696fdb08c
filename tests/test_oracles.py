"""Each catalogue query against its independent SQL form in DuckDB."""

import math
import os

import duckdb
import pytest

from driftline import catalog, catalog_views, oracles, oracles_views

SF = os.environ.get("DRIFTLINE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents benchmark pages".split()
QUERIES = catalog.queries() | catalog_views.queries()
SQL = oracles.oracle_sql() | oracles_views.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return 0.0 if x == 0 else (None if math.isnan(x) else x)
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(SQL[name])
    columns = [c[0] for c in want.description]
    a, b = table(got.columns, got.collect()), table(columns, want.fetchall())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1]) and len(a[1]) > 0
    assert [(x, y) for x, y in zip(a[1], b[1]) if x != y][:3] == []
