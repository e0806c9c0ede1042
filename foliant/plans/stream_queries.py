"""Registered queries that run the streams over the event table until it is used up, and read what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..schemas import TABLES
from ..shared import work_dir
from ..streaming import streams
from . import views as v
from .shelf_queries import event_requests

QUERIES, SQL = {}, {}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def query(f):
    QUERIES[f.__name__] = f
    return f


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream over a table's files, whether the table is a folder or one file."""
    whole = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 64)
    if [f.rsplit("/", 1)[1] for f in whole.inputFiles()] == [f"{name}.parquet"]:
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def finished(q: StreamingQuery) -> None:
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def audited(spark: SparkSession, calls: DataFrame, folder: str) -> None:
    """Streams events as outbound calls into the log under folder."""
    none = F.lit(None).cast("string")
    url = F.concat(F.lit("https://"), "event_type", F.lit(".example.org/e/"), "event_id", F.lit("?user="), "user_id", F.lit("&k=1"))
    calls = calls.select(
        F.col("ts").cast("timestamp").alias("started_at"), url.alias("url"), F.lit("GET").alias("method"), F.lit(200).alias("status_code"),
            F.col("value").alias("duration_ms"), F.lit(True).alias("has_context"), F.lit(True).alias("authenticated"), none.alias("client_id"),
        none.alias("azp"), F.col("user_id").cast("string").alias("user_id"), none.alias("email"), none.alias("name"), none.alias("client_ip"),
            none.alias("user_agent"), F.col("event_id").cast("string").alias("trace_id"), none.alias("error_type"),
    )
    finished(streams.stream_audit(calls, f"{folder}/log", f"{folder}/checkpoint"))


@query
def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "audit")
    audited(spark, stream_of(spark, sf_dir, "events"), folder)
    return streams.audit_log(spark, f"{folder}/log").read().groupBy("day", "api_name").agg(F.count("*").alias("n")).select(F.col("day").cast(
        "string").alias("day"), "api_name", "n")


SQL["stream_audit"] = "SELECT ts::date::varchar AS day, event_type || '.example.org' AS api_name, count(*) AS n FROM events GROUP BY ALL"


@query
def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log that a stream of the events writes, and what is left of it after the daily sweep of 2024-04-10."""
    folder = work_dir(spark, "retention")
    audited(spark, stream_of(spark, sf_dir, "events"), folder)
    return streams.retain(spark, f"{folder}/log", F.lit("2024-04-10").cast("timestamp")).select(F.col("trace_id").cast("long").alias("event_id"))


SQL["stream_retention"] = "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-04-10' - INTERVAL 90 DAY"


def limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests beyond one an hour of a user, of events whose files may come in any order within two months."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    folder = work_dir(spark, "limit")
    events = stream_of(spark, sf_dir, "events")
    finished(streams.stream_rate_limit(events, f"{folder}/out", "user_id", f"{folder}/checkpoint", 1, "1 hour", "60 days", "event_id"))
    rows = streams.rejected(spark, f"{folder}/out", "user_id", events.schema["user_id"].dataType.simpleString())
    return rows.withColumn("window_start", F.col("window_end") - F.expr("interval 1 hour"))


@query
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with more requests than one, and how many were rejected."""
    counts = limited(spark, sf_dir).groupBy("window_start", "user_id").agg(F.count("*").alias("rejected"))
    return counts.select(v.stamp("window_start").alias("window_start"), "user_id", (F.col("rejected") + 1).alias("n"), "rejected")


SQL["stream_rate_limit"] = (
    f"SELECT {v.sql_stamp('h')} AS window_start, user_id, n, n - 1 AS rejected FROM (SELECT date_trunc('hour', ts)::timestamp AS h, user_id, count(*) "
        f"AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL) WHERE n > 1"
)


@query
def stream_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request that the limit rejects, once."""
    return limited(spark, sf_dir).select(v.stamp("window_start").alias("window_start"), "user_id", v.stamp("ts").alias("ts"), F.col("request_id").alias("event_id"))


SQL["stream_rejected"] = (
    f"SELECT {v.sql_stamp('h')} AS window_start, user_id, {v.sql_stamp('ts')} AS ts, event_id FROM (SELECT *, date_trunc('hour', ts)::timestamp AS h FROM events WHERE ts IS NOT NULL) "
    "QUALIFY row_number() OVER (PARTITION BY user_id, h ORDER BY ts, event_id) > 1"
)


@query
def stream_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    folder = work_dir(spark, "recent")
    e = stream_of(spark, sf_dir, "events")
    views = e.select("user_id", F.get_json_object("props", "$.k").alias("book"), "ts", F.col("event_id").alias("view_id"))
    out = streams.stream_recent(views)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    finished(out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in out.schema)}, batch int").parquet(f"{folder}/out")
    last = rows.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["user_id", "batch"], "left_semi").select("user_id", F.col("book").cast("int").alias("k"), v.stamp("ts").alias("ts"), "position")


SQL["stream_recent"] = (
    f"WITH r AS ({v.SHELF_REQUESTS}), l AS (SELECT user_id, k, max(ts) AS ts FROM r GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY "
        f"user_id ORDER BY ts DESC) AS position FROM l) "
    f"SELECT user_id, k, {v.sql_stamp('ts')} AS ts, position FROM n WHERE position <= 12"
)


@query
def stream_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "entries")
    events = stream_of(spark, sf_dir, "events")
    empty = spark.createDataFrame([], TABLES["book_entries"])
    finished(streams.stream_entries(event_requests(v.shelf_requests_of(events)), f"{folder}/table", empty, f"{folder}/checkpoint"))
    rows = streams.latest_entries(spark, f"{folder}/table")
    return rows.select("user_id", "source_book_id", "status", "page_count", "pages_completed", "percent_completed")


SQL["stream_entries"] = v.FOLDED + "SELECT user_id, k::varchar AS source_book_id, status, page_count, pages_completed, percent_completed FROM folded"
