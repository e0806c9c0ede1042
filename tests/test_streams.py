"""Streams over more files than a micro-batch takes, in no order of time, give the rows of their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.plans import stream_queries
from tests.test_oracle import SF, plain


@pytest.fixture(scope="module")
def unsorted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("unsorted"))
    few = {
        "user_id": F.col("user_id") % 3, "ts": F.timestamp_micros(1_704_067_200_000_000 + F.expr("(unix_micros(ts::timestamp) - 1704067200000000) div 15")).cast("timestamp_ntz"),
        "props": F.format_string('{"k": %d}', 1 + F.get_json_object("props", "$.k").cast("int") % 20),
    }
    part = F.pmod(F.xxhash64("event_id"), F.lit(140))
    events = spark.read.parquet(f"{SF}/events.parquet").withColumns(few).withColumn("part", part)
    events.repartitionByRange(140, "part").drop("part").write.parquet(f"{folder}/events.parquet")
    assert len(spark.read.parquet(f"{folder}/events.parquet").inputFiles()) > 64
    return folder


@pytest.mark.parametrize("name", ["stream_audit", "stream_rate_limit", "stream_rejected", "stream_recent", "stream_entries"])
def test_unsorted_files(spark, unsorted, name):
    df = stream_queries.QUERIES[name](spark, unsorted)
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{unsorted}/events.parquet/*.parquet'")
    got = c.execute(stream_queries.SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(r[columns.index(k)]) for k in sorted(columns)) for r in got.fetchall()), key=str)
    assert want
    assert sorted((tuple(plain(r[k]) for k in sorted(columns)) for r in df.collect()), key=str) == want
