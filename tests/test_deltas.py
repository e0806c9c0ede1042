"""Tables of deltas: the audit log and the entries that streams write, with batches that run again, sweeps that fail, and restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliant.operators.audit import audit_lookup
from foliant.operators.shelves import upsert_entries
from foliant.plans.stream_queries import ROCKS, finished
from foliant.schemas import TABLES
from foliant.streaming import streams
from foliant.streaming.deltas import DeltaTable, _uncovered

START = datetime(2024, 3, 1)


def test_covered_deltas():
    assert _uncovered([(0, 0, 0), (1, 1, 0), (2, 2, 0)]) == [(0, 0, 0), (1, 1, 0), (2, 2, 0)]
    assert _uncovered([(0, 0, 0), (1, 1, 0), (0, 1, 0), (2, 2, 0)]) == [(0, 1, 0), (2, 2, 0)]
    assert _uncovered([(0, 1, 0), (0, 1, 1), (0, 0, 5)]) == [(0, 1, 1)]


def calls(spark, lo, hi):
    text = "cast(null as string)"
    return spark.range(lo, hi).selectExpr(f"timestamp '{START}' + make_interval(0, 0, 0, 0, cast(id as int)) started_at", "concat('https://a.example.org/x?i=', id) url", "'GET' method", "200 status_code",
        "1.0d duration_ms", "true has_context", "false authenticated", f"{text} client_id", f"{text} azp", f"{text} user_id", f"{text} email", f"{text} name", f"{text} client_ip", f"{text} user_agent",
        "cast(id as string) trace_id", f"{text} error_type")


def test_retention_of_the_streams_log(spark, tmp_path, monkeypatch):
    """Stream, sweep with failures at each step, stream on, sweep again."""
    log, source, point = str(tmp_path / "log"), str(tmp_path / "in"), str(tmp_path / "point")
    ids = lambda: sorted(int(r["trace_id"]) for r in streams.audit_log(spark, log).read().collect())

    def stream(lo, hi):
        calls(spark, lo, hi).coalesce(1).write.mode("append").parquet(source)
        finished(streams.stream_audit(spark.readStream.schema(calls(spark, 0, 1).schema).parquet(source), log, point))

    stream(0, 60)
    stream(60, 100)
    assert ids() == list(range(100))
    as_of = F.lit(START + timedelta(days=91, hours=5)).cast("timestamp")  # the limit is 2024-03-02 05:00
    monkeypatch.setattr(DeltaTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("before the rename")))
    with pytest.raises(OSError, match="before"):
        streams.retain(spark, log, as_of)
    monkeypatch.undo()
    assert set(ids()) >= set(range(29, 100))
    delete = DeltaTable._delete
    monkeypatch.setattr(DeltaTable, "_delete", lambda self, path: (_ for _ in ()).throw(OSError("behind the rename")) if "delta=" in path else delete(self, path))
    with pytest.raises(OSError, match="behind"):
        streams.retain(spark, log, as_of)
    monkeypatch.undo()
    assert ids() == list(range(29, 100))
    assert sorted(int(r["trace_id"]) for r in streams.retain(spark, log, as_of).collect()) == list(range(29, 100))
    stream(100, 130)
    assert ids() == list(range(29, 130))
    later = F.lit(START + timedelta(days=91, hours=7)).cast("timestamp")
    assert sorted(int(r["trace_id"]) for r in streams.retain(spark, log, later).collect()) == list(range(31, 130))
    table = streams.audit_log(spark, log)
    assert table.parts()[0] == "2024-03-02" and len(table.deltas("2024-03-02")) == 1
    table.add(table.read(["2024-03-05"]).drop("batch"), 2)  # the last batch runs again, with the same rows of that day
    assert len(set(ids())) == len(range(31, 130))


def request(i, user, minute, status="Reading", **more):
    row = dict.fromkeys([c.split(" ")[0] for c in TABLES["entry_requests"].split(", ")])
    return row | {"request_id": i, "ts": START + timedelta(minutes=minute), "user_id": user, "source": "s", "source_book_id": f"b{i % 5}", "title": "t", "status": status, "page_count": 100} | more


def test_entries_in_buckets(spark, tmp_path):
    """Batches, some of which come late and some twice, against one upsert of all; a batch reads no more files as batches go by."""
    rng = random.Random(1)
    schema = spark.createDataFrame([], TABLES["entry_requests"]).schema
    frame = lambda rows: spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)
    empty = spark.createDataFrame([], TABLES["book_entries"])
    before = upsert_entries(empty, frame([request(1000 + i, i, -50) for i in range(6)]))
    rows = [request(i, rng.randrange(6), i if i % 7 else i - 9, rng.choice(["Reading", "Read", "To Be Read"])) for i in range(1, 41)]
    table = streams.EntryTable(spark, str(tmp_path / "t"), buckets=2)
    table.begin(before)
    table.begin(before)
    files = []
    for n in range(8):
        batch = frame(rows[n * 5 : n * 5 + 5])
        table.apply(batch, n, most=2)
        if n in (3, 6):
            table.apply(batch, n, most=2)
        files.append(max(len(table.entries.live(p)) for p in table.entries.parts()))
    assert max(files) <= 4
    names = [f.name for f in empty.schema if f.name not in ("rating",)]
    want = upsert_entries(before, frame(rows))
    key = lambda r: tuple(str(r[c]) for c in names)
    assert sorted(map(key, table.current().collect())) == sorted(map(key, want.collect()))


def test_rejected_and_late_requests(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "key string, ts timestamp, request_id long"
    source, out, point = (str(tmp_path / x) for x in ("in", "out", "point"))

    def stream(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = streams.stream_rate_limit(spark.readStream.schema(schema).parquet(source), out, "key", point, 2, "1 minute", "5 minutes")
        finished(q)
        return q

    at = lambda m, s=0: START + timedelta(minutes=m, seconds=s)
    stream([("a", at(0, 5), 1), ("a", at(0, 4), 2), ("a", at(0, 3), 3), ("b", at(0, 1), 4)])
    stream([("a", at(0, 1), 5), ("a", at(1, 1), 6), ("c", at(20, 1), 7)])
    get = lambda late=False: sorted(r["request_id"] for r in streams.rejected(spark, out, "key", "string", late).collect())
    assert get() == [1, 2]  # 5 and 3 are the first two
    q = stream([("a", at(0, 30), 8), ("b", at(0, 50), 9), ("c", at(20, 2), 10), ("c", at(20, 3), 11)])
    assert get() == [1, 2, 11]
    assert get(late=True) == [8, 9]
    state = q.lastProgress["stateOperators"][0] if isinstance(q.lastProgress, dict) else q.lastProgress.stateOperators[0]
    rows = state["numRowsTotal"] if isinstance(state, dict) else state.numRowsTotal
    assert rows <= 2 + 1 + 2, "only the open window's requests and its timer"


def test_lookups_of_a_clustered_day(spark, tmp_path):
    """Rows stay, and lookups of an API or of a trace that isn't there read few of them."""
    log = str(tmp_path / "log")
    table = streams.audit_log(spark, log)
    names = {f.name for f in table.schema}
    rows = spark.range(4_000).selectExpr("timestamp '2024-03-01' + make_interval(0, 0, 0, 0, 0, 0, id) started_at", "concat('api', pmod(hash(id), 20)) api_name", "concat('trace ', id * 2) trace_id", "concat('actor ', id % 7) actor_id")
    rows = rows.select(*rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in rows.columns]).withColumn("day", F.to_date("started_at"))
    assert names < set(rows.columns)
    for n in range(4):
        table.add(rows.where(F.pmod(F.xxhash64("trace_id"), F.lit(4)) == n), n)

    def read(**wanted):
        found = audit_lookup(table.read(), **wanted)
        got = sorted(r["trace_id"] for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan()
        return got, plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    asked = [{"api": "api3"}, {"trace": "trace 2001"}, {"trace": "trace 2000"}, {"actor_id": "actor 3"}]
    before = [read(**a) for a in asked]
    streams.cluster(spark, log, "2024-03-01", files=8)
    after = [read(**a) for a in asked]
    assert [got for got, _ in after] == [got for got, _ in before]
    assert before[0][1] == 4_000 and after[0][1] <= 1_500
    assert after[1] == ([], 0) and after[2][1] <= 1_500
