"""Queries of the subpackage that have SQL give its rows in DuckDB."""

import duckdb
import pytest

from foliant.llm import queries as registered
from tests.test_oracle import plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registered.queries()[name](spark, SF)
    got = c.execute(registered.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(r[columns.index(k)]) for k in sorted(columns)) for r in got.fetchall()), key=str)
    assert sorted((tuple(plain(r[k]) for k in sorted(columns)) for r in df.collect()), key=str) == want
