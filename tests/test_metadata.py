"""Metadata that is saved and found again, where joins are planned as merges and adaptive execution makes broadcasts of them."""

import duckdb
import pytest

from foliant.plans import catalog_queries
from tests.test_oracle import plain

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("planned", ["-1", "100KB"])
def test_joins_that_change_while_they_run(spark, planned):
    conf = {"spark.sql.shuffle.partitions": "20", "spark.sql.autoBroadcastJoinThreshold": planned, "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, x in conf.items():
        spark.conf.set(k, x)
    try:
        df = catalog_queries.metadata_cached(spark, SF)
        rows = df.collect()
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)
    c = duckdb.connect()
    for t in ("part", "lineitem"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = c.execute(catalog_queries.SQL["metadata_cached"])
    columns = [d[0] for d in got.description]
    want = sorted((tuple(plain(r[columns.index(k)]) for k in sorted(columns)) for r in got.fetchall()), key=str)
    assert sorted((tuple(plain(r[k]) for k in sorted(columns)) for r in rows), key=str) == want
