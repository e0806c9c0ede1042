"""Each query of the library gives the rows of its SQL in DuckDB."""

import math

import duckdb
import pytest

from foliant.plans import catalog_queries, feed_queries, rule_queries, shelf_queries, stream_queries

SF = "/root/testdata/sf0.001"
MODULES = (shelf_queries, catalog_queries, feed_queries, rule_queries, stream_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name not in SQL:
        return
    got = duck.execute(SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in got.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in rows), key=str) == want
