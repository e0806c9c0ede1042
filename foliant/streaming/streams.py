"""Audit ingest, retention, limits, recently viewed and shelf entries as streams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.audit import audit_project, expire
from ..operators.shelves import upsert_entries
from ..schemas import TABLES
from ..shipping import ship
from .deltas import DeltaTable


def audit_log(spark: SparkSession, log: str) -> DeltaTable:
    """The log that stream_audit writes: a folder a day."""
    columns = [f"{c} {t}" for c, t in (f.split(" ", 1) for f in re.split(r", (?![0-9])", TABLES["api_request_logs"])) if c != "log_id"]
    return DeltaTable(spark, log, "day", T._parse_datatype_string(", ".join(columns)))


def stream_audit(calls: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Projects a stream of outbound calls and appends micro-batches to a log by day (audit_log reads it). maxFilesPerTrigger of the source bounds a batch.

    A batch that fails is tried again from the checkpoint and takes the place of what it wrote before, so each call counts once. The log keeps no list
    of files: days may be dropped and rewritten while the stream goes on.
    """
    names = audit_log(calls.sparkSession, log).schema.names

    def append(batch: DataFrame, n: int) -> None:
        rows = audit_project(batch).select(*names).withColumn("day", F.to_date("started_at"))
        audit_log(batch.sparkSession, log).add(rows, n)

    return calls.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retain(spark: SparkSession, log: str, as_of: Column, days: int = 90) -> DataFrame:
    """Drops from a log of stream_audit what is no longer kept, and returns the rest. Meant to run daily on a schedule, beside the stream.

    Days that are over go as whole folders. The day that the limit falls on is rewritten without the rows before it, and the rewrite comes into force
    by one rename: a run that fails, wherever, loses nothing that is kept, and the next one goes on. Other days aren't read.
    """
    limit = spark.range(1).select(F.to_date(as_of - F.make_interval(days=F.lit(days))).alias("day")).first()["day"].isoformat()
    table = audit_log(spark, log)
    for day in table.parts():
        if day < limit:
            table.drop(day)
        elif day == limit:
            table.rewrite(day, lambda rows: expire(rows, "started_at", as_of, days))
    return table.read()


def cluster(spark: SparkSession, log: str, day: str, files: int = 8) -> None:
    """Rewrites a day of the log for lookups: sorted by API and time over some files, so that a lookup of an API reads its row groups alone, with bloom filters of traces and actors."""
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("trace_id", "actor_id")}
    audit_log(spark, log).rewrite(day, lambda rows: rows.repartitionByRange(files, "api_name", "started_at").sortWithinPartitions("api_name", "started_at"), options=blooms)


class _Windows(StatefulProcessor):
    """Of one window and all keys of a part keeps each key's first `limit` requests so far; a request that falls out of them is rejected, whatever still comes. Goes when the watermark passes its end."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first, self.handle = handle.getListState("first", "key string, ts long, id long"), handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = int(key[0])
        if end // 1000 <= timerValues.getCurrentWatermarkInMs():
            for df in rows:
                yield _requests(end, df["key"].to_numpy(object), df["ts"].to_numpy(), df["request_id"].to_numpy(), True)
            return
        kept = list(self.first.get())
        new, old = not kept, _columns(kept)
        for more in _gathered(rows, len(kept)):
            old, out = _split([np.concatenate(x) for x in zip(old, more, strict=True)], self.limit)
            if len(out[0]):
                yield _requests(end, *out, False)
        self.first.put([(k, int(t), int(i)) for k, t, i in zip(*old, strict=True)])
        if new:
            self.handle.registerTimer(end // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.first.clear()
        yield pd.DataFrame(columns=["key", "window_end", "ts", "request_id", "late"])

    def close(self) -> None:
        pass


def _columns(rows: list[tuple]) -> list[np.ndarray]:
    """Keys, times and ids of requests."""
    keys = np.empty(len(rows), object)
    keys[:] = [r[0] for r in rows]
    return [keys, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)]


def _gathered(rows: Iterator[pd.DataFrame], least: int) -> Iterator[list[np.ndarray]]:
    """Requests of several frames together, about as many as are kept, so that what is kept isn't sorted again for each frame."""
    frames, n = [], 0
    for df in rows:
        frames.append([df["key"].to_numpy(object), df["ts"].to_numpy(np.int64), df["request_id"].to_numpy(np.int64)])
        n += len(df)
        if n >= max(least, 50_000):
            yield [np.concatenate(x) for x in zip(*frames, strict=True)]
            least, frames, n = least + n, [], 0
    if frames:
        yield [np.concatenate(x) for x in zip(*frames, strict=True)]


def _split(requests: list[np.ndarray], limit: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(the first `limit` requests of each key by time and id, all others)."""
    codes = pd.factorize(requests[0], use_na_sentinel=False)[0]
    order = np.lexsort((requests[2], requests[1], codes))
    codes, at = codes[order], np.arange(len(order))
    begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(order) else at
    first = at - np.repeat(begins, np.diff(np.r_[begins, len(order)])) < limit
    return [x[order[first]] for x in requests], [x[order[~first]] for x in requests]


def _requests(end: int, keys: np.ndarray, ts: np.ndarray, ids: np.ndarray, late: bool) -> pd.DataFrame:
    return pd.DataFrame({"key": keys, "window_end": end, "ts": ts, "request_id": ids, "late": late})


#: Parts of the keys of a window, whose requests are handled together.
PARTS = 16


def stream_rate_limit(calls: DataFrame, folder: str, key: str, checkpoint: str, limit: int = 10, window: str = "1 minute", delay: str = "10 minutes",
                      request: str = "request_id", parts: int = PARTS) -> StreamingQuery:
    """Writes the requests beyond the limit in their fixed window of a key, each once, to folder/rejected, as soon as it is sure: window_end, key, ts and request_id (whole numbers).

    Requests are told apart by (ts, request), so files may come in any order within `delay`. State is `limit` requests of each key in each open window, and goes when the watermark (the last
    window's end less the delay) passes the window's end. Requests of windows that are closed by then go to folder/late. A micro-batch that runs again writes the
    same files again. Needs the RocksDB provider; a request without a time has no window and is left out.

    The keys of a window are dealt into parts, each of which is a group with one call of Python and one list of state: a group for each key and window costs far more than its few
    requests. A checkpoint keeps its number of parts. Python has keys as text, so they must be of a type that a cast to text and back keeps.
    """
    ship(calls.sparkSession)
    stamp = F.col("ts").cast("timestamp")
    rows = calls.select(F.col(key).alias("key"), stamp.alias("ts"), F.col(request).cast("long").alias("request_id"), F.window(stamp, window)["end"].alias("end"))
    # The watermark is that of window ends; the copy that groups carries no mark, so that Spark hands late rows over instead of dropping them.
    marked = rows.where("end is not null").withWatermark("end", delay).select(F.col("key").cast("string").alias("key"), F.unix_micros("ts").alias("ts"), "request_id",
        F.unix_micros("end").alias("window_end"), F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"))
    kind = rows.schema["key"].dataType
    out = marked.groupBy("window_end", "part").transformWithStateInPandas(_Windows(limit), "key string, window_end long, ts long, request_id long, late boolean", "Append", "EventTime")

    def keep(batch: DataFrame, n: int) -> None:
        found = batch.select(F.col("key").cast(kind).alias(key), F.timestamp_micros("window_end").alias("window_end"), F.timestamp_micros("ts").alias("ts"), "request_id",
            F.when(F.col("late"), "late").otherwise("rejected").alias("kind"), F.lit(n).alias("batch"))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "batch").parquet(folder)

    return out.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rejected(spark: SparkSession, folder: str, key: str, kind: str, late: bool = False) -> DataFrame:
    """The rejected (or late) requests that stream_rate_limit has written, for a key of type kind."""
    rows = spark.read.schema(f"window_end timestamp, `{key}` {kind}, ts timestamp, request_id long, kind string, batch long").parquet(folder)
    return rows.where(F.col("kind") == ("late" if late else "rejected")).drop("kind", "batch")


class _Recent(StatefulProcessor):
    """Keeps a user's n books viewed last."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.views = handle.getListState("views", "book string, ts timestamp, view_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = {}
        old = [(b, pd.Timestamp(t), v) for b, t, v in self.views.get()]
        new = [(b, pd.Timestamp(t), v) for df in rows for b, t, v in zip(df["book"], df["ts"], df["view_id"], strict=True)]
        for book, ts, view in old + new:
            if book not in latest or latest[book] < (ts, view):
                latest[book] = (ts, view)
        kept = sorted(((ts, v, b) for b, (ts, v) in latest.items()), reverse=True)[: self.n]
        self.views.put([(b, ts.to_pydatetime(), int(v)) for ts, v, b in kept])
        yield pd.DataFrame([(key[0], b, ts, i) for i, (ts, _, b) in enumerate(kept, 1)], columns=["user_id", "book", "ts", "position"])

    def close(self) -> None:
        pass


def stream_recent(views: DataFrame, n: int = 12) -> DataFrame:
    """Each user's n books viewed last after each batch (update mode). views: user_id, book (string), ts, view_id. State is n rows a user and needs the RocksDB provider."""
    ship(views.sparkSession)
    rows = views.select(F.col("user_id").cast("long"), F.col("book").cast("string"), F.col("ts").cast("timestamp"), F.col("view_id").cast("long"))
    return rows.groupBy("user_id").transformWithStateInPandas(_Recent(n), "user_id long, book string, ts timestamp, position int", "Update", "None")


#: Buckets of users; deltas of a bucket before they are put together.
BUCKETS, MOST_DELTAS = 64, 8


class EntryTable:
    """The entries of all users in buckets of users, as a stream of requests leaves them: entries by their last delta, the requests themselves, and the entries before the stream."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        requests, entries = (spark.createDataFrame([], TABLES[n]).schema for n in ("entry_requests", "book_entries"))
        self.buckets, self.spark = buckets, spark
        self.entries = DeltaTable(spark, f"{folder}/entries", "bucket", entries)
        self.requests = DeltaTable(spark, f"{folder}/requests", "bucket", requests)
        self.before = DeltaTable(spark, f"{folder}/before", "bucket", entries)

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)))

    def begin(self, entries: DataFrame) -> None:
        """Puts the entries before the stream into their buckets, once."""
        if not self.entries.parts() and not self.before.parts():
            self.before.add(self.bucketed(entries.select(*self.before.schema.names)), 0)

    def current(self, parts: list[str] | None = None, before: int | None = None) -> DataFrame:
        """Entries (with bucket) of some buckets or all, after all batches or those before one: of each user the rows of the last delta that has them."""
        written, old = self.entries.read(parts, before), self.before.read(parts).drop("batch")
        last = written.groupBy(F.col("user_id").alias("__user")).agg(F.max("batch").alias("__last"))
        same = F.col("user_id").eqNullSafe(F.col("__user"))
        rows = written.join(last, same & (F.col("batch") == F.col("__last")), "left_semi").drop("batch")
        return rows.unionByName(old.join(last, same, "left_anti"))

    def compact(self, parts: list[str], before: int, most: int) -> None:
        """Puts the deltas of buckets together that have too many: entries of each user's last delta, and all requests."""
        newest = lambda rows: rows.join(rows.groupBy(F.col("user_id").alias("__user")).agg(F.max("batch").alias("__last")), F.col("user_id").eqNullSafe(F.col("__user")) & (
            F.col("batch") == F.col("__last")), "left_semi")
        for part in parts:
            for table, change in ((self.entries, newest), (self.requests, lambda rows: rows)):
                if len([d for d in table.live(part) if d[1] < before]) > most:
                    table.rewrite(part, change, before)

    def apply(self, batch: DataFrame, n: int, most: int = MOST_DELTAS) -> None:
        """Upserts a micro-batch: reads and writes only the buckets that it has users of. If it runs again, its deltas are the same."""
        self.requests.add(self.bucketed(batch.select(*self.requests.schema.names)), n)
        parts = [str(r["bucket"]) for r in self.bucketed(batch.select("user_id")).select("bucket").distinct().collect()]
        self.compact(parts, n, most)
        new = self.requests.read(parts).where(F.col("batch") == n).drop("batch", "bucket")
        users = new.groupBy(F.col("user_id").alias("__user")).agg(F.min("ts").alias("at"))
        among = lambda df, who, how="left_semi": df.join(who, F.col("user_id").eqNullSafe(F.col("__user")), how)
        before = among(self.current(parts, n), users.select("__user")).drop("bucket")
        last = before.groupBy("user_id").agg(F.max("updated_date").alias("last"))
        late = users.join(last, F.col("__user").eqNullSafe(F.col("user_id"))).where("at <= last").select("__user").persist()
        if not late.isEmpty():
            new = among(new, late, "left_anti").unionByName(among(self.requests.read(parts, n + 1).drop("batch", "bucket"), late))
            before = among(before, late, "left_anti").unionByName(among(self.before.read(parts).drop("batch", "bucket"), late))
        self.entries.add(self.bucketed(upsert_entries(before, new)), n)
        late.unpersist()


def stream_entries(requests: DataFrame, folder: str, entries: DataFrame, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Upserts a stream of entry requests into an EntryTable that begins with entries; latest_entries reads it. A folder keeps its number of buckets.

    Users of whom a batch brings a request that is no later than their last one are replayed from the start, out of their buckets' requests, so the table is that of
    all requests in order (ts, request_id), in whatever batches they came. A batch that runs again writes the same rows again, so requests count once.
    """
    EntryTable(requests.sparkSession, folder, buckets).begin(entries)
    upsert = lambda batch, n: EntryTable(batch.sparkSession, folder, buckets).apply(batch, n)
    return requests.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_entries(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> DataFrame:
    """The table of stream_entries after all batches."""
    return EntryTable(spark, folder, buckets).current().drop("bucket")
