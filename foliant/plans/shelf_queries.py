"""Registered queries on shelves, identities, accounts, audit and calendar, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.audit import next_weekly_refresh
from ..functions.identifiers import with_isbn13
from ..functions.shelves import STATUSES, goal_percentage
from ..functions.text import comparable
from ..functions.text import search_text as normalized_text
from ..functions.identifiers import fallback_id
from ..operators import audit, joins, shelves, validation, windows
from ..schemas import TABLES
from . import views as v
from .views import read, sql_isbn10, sql_isbn13, sql_stamp, stamp

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.fold_entries(v.shelf_requests(spark, sf_dir), ["user_id", "k"], ["ts", "request_id"])


@query(
    v.FOLDED + f", done AS (SELECT user_id, year(end_date) AS year, count(*) AS n FROM folded WHERE status = 'Read' AND end_date IS NOT NULL GROUP BY "
        f"ALL), goals AS ({v.GOALS}) "
    "SELECT user_id, year, target_book_count, coalesce(n, 0) AS completed_book_count, least(100, floor(coalesce(n, 0) / target_book_count * 100 + "
        "0.5))::bigint AS percentage FROM goals LEFT JOIN done USING (user_id, year)"
)
def goal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = v.goals(spark, sf_dir)
    status = joins.goal_status(goals, shelves.completed_by_year(folded(spark, sf_dir)), goals)
    return status.withColumn("percentage", goal_percentage(F.col("completed_book_count"), F.col("target_book_count")))


@query(v.FOLDED + f"SELECT user_id, k, status, page_count, pages_completed, percent_completed, {sql_stamp('start_date')} AS "
    f"start_date, {sql_stamp('end_date')} AS end_date FROM folded")
def entry_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir).select("user_id", "k", "status", "page_count", "pages_completed", "percent_completed", stamp("start_date").alias(
        "start_date"), stamp("end_date").alias("end_date"))


@query(v.FOLDED + "SELECT user_id, CASE WHEN grouping(status) = 1 THEN 'All Books' ELSE status END AS shelf, count(*) AS n FROM folded GROUP BY "
    "GROUPING SETS ((user_id, status), (user_id))")
def shelf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelves.shelf_counts(folded(spark, sf_dir))


@query(v.FOLDED + "SELECT user_id, k, percent_completed, row_number() OVER (PARTITION BY user_id ORDER BY percent_completed DESC, k) AS rank FROM "
    "folded WHERE status = 'Reading' AND contains('book ' || k, '1')")
def shelf_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folded(spark, sf_dir).withColumns({"title": F.concat(F.lit("Book "), "k"), "authors": F.lit(None).cast("string"), "entry_id": F.col("k")})
    found = shelves.shelf_filter(rows, "Reading", "1")
    return found.select("user_id", "k", "percent_completed", F.row_number().over(Window.partitionBy("user_id").orderBy(
        *shelves.shelf_order("progress"))).alias("rank"))


@query(
    f"WITH r AS ({v.SHELF_REQUESTS}), l AS (SELECT user_id, k, max(ts) AS ts FROM r GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY "
        f"user_id ORDER BY ts DESC) AS position FROM l) "
    f"SELECT user_id, k, {sql_stamp('ts')} AS ts, position FROM n WHERE position <= 12"
)
def recently_viewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = v.shelf_requests(spark, sf_dir).select("user_id", "k", "ts", "request_id")
    return windows.recently_viewed(views, "k", order=("ts", "request_id")).select("user_id", "k", stamp("ts").alias("ts"), "position")


_REQUESTS = f"""
requests AS (SELECT o_custkey::int AS user_id, l_partkey AS k, o_custkey * 10000000 + l_partkey AS request_id, CASE WHEN l_partkey % 5 <> 0 THEN {sql_isbn13('l_partkey % 500')} END AS isbn13, CASE WHEN l_partkey % 2 = 0 THEN {sql_isbn10('l_partkey % 300')} END AS isbn10,
  'part' AS source, (l_partkey % 200)::varchar AS source_book_id FROM (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey))
"""


def _order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey",
        F.col("l_partkey").alias("k")).distinct()
    k = F.col("k")
    return pairs.select(
        (F.col("o_custkey") * 10_000_000 + k).alias("request_id"), F.col("o_custkey").cast("int").alias("user_id"),
            F.when(k % 5 != 0, v.isbn13(k % 500)).alias("isbn13"), F.when(k % 2 == 0, v.isbn10(k % 300)).alias("isbn10"), F.lit("part").alias("source"),
        (k % 200).cast("string").alias("source_book_id"),
    )


@query(
    f"WITH {v.ENTRIES_BY_ORDER}, {_REQUESTS} SELECT request_id, min(entry_id) AS match_id FROM requests r LEFT JOIN entries_by_order e ON r.user_id = "
        f"e.user_id AND (r.isbn13 = e.isbn13 OR r.isbn10 = e.isbn10 OR (r.source = e.source AND r.source_book_id = e.source_book_id)) GROUP BY ALL"
)
def entry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.match_entries(_order_requests(spark, sf_dir), v.entries_by_order(spark, sf_dir)).select("request_id", "match_id")


def event_requests(rows: DataFrame) -> DataFrame:
    """Shelf requests with all columns of entry requests."""
    none = F.lit(None).cast("string")
    return rows.select(
        "request_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.lit(None).cast("long").alias("entry_id"),
            F.lit(" events ").alias("source"), F.col("k").cast("string").alias("source_book_id"), F.concat(F.lit("Book "), "k").alias("title"),
            none.alias("authors"),
        none.alias("thumbnail_url"), none.alias("isbn10"), none.alias("isbn13"), F.upper("status").alias("status"), "page_count", "pages_completed",
            "percent_completed",
    )


@query(v.FOLDED + f"SELECT user_id, k::varchar AS source_book_id, status, page_count, pages_completed, percent_completed, {sql_stamp('start_date')} "
    f"AS start_date, {sql_stamp('end_date')} AS end_date FROM folded")
def entry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = validation.validate_entries(event_requests(v.shelf_requests(spark, sf_dir)))
    empty = spark.createDataFrame([], TABLES["book_entries"])
    out = shelves.upsert_entries(empty, valid)
    return out.select("user_id", "source_book_id", "status", "page_count", "pages_completed", "percent_completed", stamp("start_date").alias(
        "start_date"), stamp("end_date").alias("end_date"))


def changing_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a customer's orders as entry requests, whose ISBNs (of 30 and 40) and source ids (of 25) repeat in different combinations; every seventh part has ISBNs alone."""
    k = F.col("request_id") % 10_000_000
    rows = _order_requests(spark, sf_dir).withColumn("k", k)
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (k % 5 + 1).cast("int"))
    none = F.lit(None).cast("string")
    return rows.select(
        "request_id", F.timestamp_seconds(1_704_067_200 + k * 7_919 % 100_003).alias("ts"), "user_id", F.lit(None).cast("long").alias("entry_id"), F.when(k % 7 != 0,
            F.col("source")).alias("source"), F.when(k % 7 != 0, (k % 25).cast("string")).alias("source_book_id"), F.concat(F.lit("Book "), k).alias("title"), none.alias("authors"),
        none.alias("thumbnail_url"), F.when(k % 2 == 0, v.isbn10(k % 30)).alias("isbn10"), F.when(k % 5 != 0, v.isbn13(k % 40)).alias("isbn13"), status.alias("status"), (k % 400).cast("int").alias("page_count"), F.when(k % 3 == 0, (k % 90).cast("int")).alias("pages_completed"),
        F.lit(None).cast("int").alias("percent_completed"),
    )


@query()
def entry_rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries after requests that change their keys; order decides, which SQL can't express: tests compare with a plain replay."""
    valid, _ = validation.validate_entries(changing_requests(spark, sf_dir))
    out = shelves.upsert_entries(spark.createDataFrame([], TABLES["book_entries"]), valid)
    return out.select("user_id", "entry_id", "isbn10", "isbn13", "source_book_id", "status", "page_count", "pages_completed", "percent_completed", stamp("start_date").alias("start_date"),
        stamp("end_date").alias("end_date"))


@query(
    f"WITH g AS ({v.GOALS}), r AS (SELECT o_custkey::int AS user_id, year(o_orderdate)::int AS year, arg_max((1 + o_orderkey % 50)::int, "
        f"(o_orderdate, o_orderkey)) AS t FROM orders GROUP BY ALL) "
    "SELECT user_id, year, coalesce(t, target_book_count) AS target_book_count FROM g FULL JOIN r USING (user_id, year)"
)
def goal_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    requests = o.select(F.col("o_custkey").cast("int").alias("user_id"), F.year("o_orderdate").alias("year"), (1 + F.col("o_orderkey") % 50).cast(
        "int").alias("target_book_count"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("request_id"))
    return shelves.upsert_goals(v.goals(spark, sf_dir), requests).drop("updated_date")


_ISBN_IN = f"CASE WHEN p_partkey % 7 = 0 THEN {sql_isbn13('p_partkey + 1')[:-1]} || 'x') WHEN p_partkey % 7 = 3 THEN {sql_isbn10('p_partkey')[:-1]} || '0') WHEN p_partkey % 2 = 0 THEN {sql_isbn13('p_partkey')} ELSE lower(substr({sql_isbn10('p_partkey')}, 1, 5) || '-' || substr({sql_isbn10('p_partkey')}, 6)) END"
_D = lambda i: f"try_cast(substr(c, {i + 1}, 1) AS int)"
_S13 = " + ".join(f"{_D(i)} * {3 if i % 2 else 1}" for i in range(13))
_S10 = " + ".join(f"{_D(i)} * {10 - i}" for i in range(9)) + " + CASE WHEN substr(c, 10, 1) = 'X' THEN 10 ELSE " + _D(9) + " END"
_T = "'978' || substr(c, 1, 9) || ((10 - (38 + " + " + ".join(f"{_D(i)} * {1 if i % 2 else 3}" for i in range(9)) + ") % 10) % 10)::varchar"


@query(
    f"WITH i AS (SELECT p_partkey, {_ISBN_IN} AS raw FROM part), c AS (SELECT p_partkey, upper(replace(replace(raw, '-', ''), ' ', '')) AS c FROM i), "
    f"f AS (SELECT *, regexp_full_match(c, '[0-9]{{13}}') AND coalesce(({_S13}) % 10 = 0, false) AS is13, regexp_full_match(c, '[0-9]{{9}}[0-9X]') "
        f"AND coalesce(({_S10}) % 11 = 0, false) AS is10 FROM c) "
    f"SELECT p_partkey, CASE WHEN is13 THEN c WHEN is10 THEN {_T} ELSE c END AS isbn13, is13 OR is10 AS is_valid FROM f"
)
def isbn_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ten = v.isbn10(k)
    raw = F.when(k % 7 == 0, F.concat(v.isbn13(k + 1), F.lit("x"))).when(k % 7 == 3, F.concat(ten, F.lit("0"))).when(k % 2 == 0,
        v.isbn13(k)).otherwise(F.lower(F.concat(F.substring(ten, 1, 5), F.lit("-"), F.substring(ten, 6, 5))))
    return with_isbn13(read(spark, sf_dir, "part").select(k, raw.alias("raw")), "raw").select("p_partkey", "isbn13", "is_valid")


@query("SELECT doc_id, lower(trim(regexp_replace(strip_accents(text), '[^a-zA-Z0-9]+', ' ', 'g'))) AS search_text, regexp_replace(lower(text), "
    "'[^\\p{L}\\p{Nd}]', '', 'g') AS comparable, regexp_replace(lower(trim(text || '-' || source)), '[^a-z0-9]+', '-', 'g') AS fallback FROM documents")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", normalized_text(F.col("text")).alias("search_text"), comparable(F.col("text")).alias("comparable"),
        fallback_id(F.col("text"), F.col("source")).alias("fallback"))


def _accounts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    return {
        "users": c.select(k.cast("int").alias("user_id"), F.concat(F.lit("id-"), k).alias("identity_user_id"), F.col("c_name").alias("username")),
        "identities": c.where(k % 10 != 9).select(F.concat(F.lit("id-"), k).alias("id"), F.col("c_name").alias("user_name"), F.concat(F.col("c_name"),
            F.lit("@Example.org")).alias("email")),
        "book_entries": v.entries_by_order(spark, sf_dir), "reading_goals": v.goals(spark, sf_dir),
    }


@query("SELECT c_custkey::int AS user_id, c_name AS user_name, c_name || '@Example.org' AS email FROM customer WHERE c_custkey % 10 <> 9")
def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _accounts(spark, sf_dir)
    return joins.user_profiles(t["users"], t["identities"]).select("user_id", "user_name", "email")


@query("WITH gone AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 10 <> 9) SELECT 'book_entries' AS table_name, "
    "o_orderkey::varchar AS key FROM orders WHERE o_custkey NOT IN (FROM gone) UNION ALL SELECT 'reading_goals', c_custkey::varchar FROM customer "
    "WHERE c_custkey NOT IN (FROM gone) UNION ALL SELECT 'users', c_custkey::varchar FROM customer WHERE c_custkey NOT IN (FROM gone) UNION ALL "
    "SELECT 'identities', 'id-' || c_custkey FROM customer WHERE c_custkey % 10 <> 9 AND c_custkey NOT IN (FROM gone)")
def erase_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _accounts(spark, sf_dir)
    left = joins.erase_users(t, t["users"].where("user_id % 3 = 0"))
    key = {"book_entries": "entry_id", "reading_goals": "user_id", "users": "user_id", "identities": "id"}
    rows = [left[n].select(F.lit(n).alias("table_name"), F.col(c).cast("string").alias("key")) for n, c in key.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN true ELSE EXISTS (FROM customer WHERE c_custkey % 10 <> 9 AND lower(c_name || "
    "'@Example.org') = lower('CUSTOMER#' || lpad((s_suppkey * 3)::varchar, 9, '0') || '@example.org')) END AS taken FROM supplier")
def taken_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    asked = read(spark, sf_dir, "supplier").select(k, F.when(k % 9 == 0, F.lit(" ")).otherwise(F.concat(F.lit("CUSTOMER#"),
        F.lpad((k * 3).cast("string"), 9, "0"), F.lit("@example.org"))).alias("email"))
    return joins.taken_emails(asked, _accounts(spark, sf_dir)["identities"]).select("s_suppkey", "taken")


@query("SELECT p_partkey, p_brand AS author, s_name AS extract FROM part LEFT JOIN (SELECT 'Brand#' || s_suppkey AS b, s_name FROM supplier WHERE "
    "s_suppkey % 2 = 0) ON p_brand = b")
def author_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0")
    summaries = s.select(F.concat(F.lit(" Brand#"), "s_suppkey").alias("title"), F.col("s_name").alias("extract"), F.lit("").alias("page"),
        F.lit("").alias("thumbnail"))
    books = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("author"))
    return joins.enrich_authors(books, summaries).select("p_partkey", "author", F.col("summary.extract").alias("extract"))


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_QUERY = "regexp_extract(url, '\\?([^#]*)', 1)"


@query(
    f"SELECT page_id, lower({_HOST}) AS api_name, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE "
        f"substr(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), 1, 512) END AS route, CASE WHEN page_id % 7 = 0 THEN 500 ELSE 200 END AS status_code, "
    "CASE WHEN page_id % 5 = 0 THEN 'system' WHEN page_id % 5 = 1 THEN 'anonymous' WHEN page_id % 5 = 2 THEN 'system' ELSE 'user' END AS actor_type, "
        "CASE WHEN page_id % 5 = 0 THEN 'service' WHEN page_id % 5 = 1 THEN 'anonymous' WHEN page_id % 5 = 2 THEN 'client' WHEN page_id % 5 = 3 THEN "
        "'u' || page_id ELSE 'unknown' END AS actor_id, "
    f"CASE WHEN {_QUERY} = '' THEN NULL ELSE array_to_string(list_sort(list_distinct(list_transform(str_split({_QUERY}, '&'), lambda x: split_part(x, "
        f"'=', 1)))), ',') END AS query_parameter_names, CASE WHEN page_id % 7 = 0 THEN 'Outbound request failed.' END AS error_message FROM pages"
)
def audit_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    none = F.lit(None).cast("string")
    calls = read(spark, sf_dir, "pages").select(
        F.current_timestamp().alias("started_at"), "url", F.lit("GET").alias("method"), F.when(p % 7 != 0, 200).alias("status_code"),
            F.lit(1.0).alias("duration_ms"), (p % 5 != 0).alias("has_context"), (p % 5 > 1).alias("authenticated"),
        F.when(p % 5 == 2, "client").alias("client_id"), none.alias("azp"), F.when(p % 5 == 3, F.concat(F.lit("u"), p)).alias("user_id"),
            none.alias("email"), none.alias("name"), none.alias("client_ip"), none.alias("user_agent"), p.cast("string").alias("trace_id"),
        F.when(p % 7 == 0, "Timeout").alias("error_type"),
    )
    return audit.audit_project(calls).select(F.col("trace_id").cast("long").alias("page_id"), "api_name", "route", "status_code", "actor_type",
        "actor_id", "query_parameter_names", "error_message")


_THU = "date_trunc('day', ts) + INTERVAL 1 DAY * ((11 - isodow(ts)) % 7) + INTERVAL 5 HOUR"


@query(f"SELECT event_id, {sql_stamp(f'CASE WHEN {_THU} > ts THEN {_THU} ELSE {_THU} + INTERVAL 7 DAY END')} AS refresh FROM events")
def weekly_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", stamp(next_weekly_refresh(F.col("ts").cast("timestamp"))).alias("refresh"))


@query(f"SELECT user_id, arg_max(event_type, (ts, event_type)) AS payload, {sql_stamp('max(ts)')} AS retrieved_at FROM events WHERE event_type <> "
    f"'error' AND ts <= TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-20' < ts + INTERVAL 2 DAY GROUP BY user_id")
def fresh_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("payload"),
        F.col("ts").cast("timestamp").alias("retrieved_at"))
    return windows.fresh_snapshots(rows, F.lit("2024-01-20").cast("timestamp"), F.make_interval(days=F.lit(2)), "user_id").withColumn("retrieved_at",
        stamp("retrieved_at"))


@query(f"SELECT event_id, {sql_stamp('date_trunc(chr(104) || chr(111) || chr(117) || chr(114), ts)')} AS window_start, n AS request_number, n > 1 AS "
    f"rejected FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events)")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.rate_limit(read(spark, sf_dir, "events"), "user_id", 1, "1 hour", ("ts", "event_id"))
    return rows.select("event_id", stamp("window_start").alias("window_start"), "request_number", "rejected")


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("log_id"), F.col("ts").cast("timestamp").alias("started_at"),
        F.col("event_type").alias("api_name"), F.col("user_id").cast("string").alias("actor_id"), F.lit("t").alias("trace_id"))


@query(f"SELECT event_id AS log_id, {sql_stamp('ts')} AS started_at FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' "
    f"AND event_type = 'click'")
def audit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    return audit.audit_lookup(_logs(spark, sf_dir), datetime(2024, 1, 5), datetime(2024, 1, 12), "click").select("log_id", stamp("started_at").alias(
        "started_at"))


@query("SELECT event_id AS log_id FROM events WHERE ts >= TIMESTAMP '2024-04-10' - INTERVAL 90 DAY")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.expire(_logs(spark, sf_dir), "started_at", F.lit("2024-04-10").cast("timestamp")).select("log_id")


@query(
    "SELECT 'entries' AS table_name, 'unique(user_id, source, source_book_id)' AS constraint_name, (SELECT count(*) FROM (SELECT 1 FROM orders WHERE "
        "o_orderkey % 2 = 0 GROUP BY o_custkey, o_orderkey % 200 HAVING count(*) > 1)) AS violations "
    "UNION ALL SELECT 'lines', 'unique(l_orderkey, l_linenumber)', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber "
        "HAVING count(*) > 1)) UNION ALL SELECT 'lines', 'l_orderkey in orders', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT "
        "o_orderkey FROM orders)) "
    "UNION ALL SELECT 'entries', 'user_id in users', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE "
        "c_custkey % 10 <> 3))"
)
def constraint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"entries": v.entries_by_order(spark, sf_dir), "lines": read(spark, sf_dir, "lineitem"), "orders": read(spark, sf_dir, "orders"),
        "users": read(spark, sf_dir, "customer").where("c_custkey % 10 <> 3")}
    unique = {"entries": [["user_id", "source", "source_book_id"]], "lines": [["l_orderkey", "l_linenumber"]]}
    return validation.audit_constraints(tables, unique, [("lines", "l_orderkey", "orders", "o_orderkey"), ("entries", "user_id", "users", "c_custkey")])


@query("WITH i AS (SELECT s_suppkey AS idx, s_name AS name FROM supplier), d AS (SELECT DISTINCT o_orderdate::date AS d FROM orders) SELECT "
    "d::varchar AS date, name FROM d JOIN i ON idx = (((d - DATE '2024-01-01') % (SELECT count(*) FROM i)) + (SELECT count(*) FROM i)) % (SELECT "
    "count(*) FROM i)")
def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("idx"), F.col("s_name").alias("name"))
    dates = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return audit.rotation(dates, items).select(F.col("date").cast("string").alias("date"), "name")
