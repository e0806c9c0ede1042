"""Registered queries on rules, single rows' expressions and updates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.books import release_date, valid_cover_url
from ..functions.identifiers import identifier_of, isbn_query
from ..functions.shelves import progress
from ..operators import joins, shelves, validation
from ..schemas import TABLES
from . import views as v
from .shelf_queries import event_requests
from .views import read, sql_isbn10, sql_isbn13, sql_stamp, stamp

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ASKED = f"CASE p_partkey % 5 WHEN 0 THEN {sql_isbn13('p_partkey')} WHEN 1 THEN '978-' || substr({sql_isbn13('p_partkey')}, 4) || ' ' WHEN 2 THEN lower({sql_isbn10('p_partkey')}) WHEN 3 THEN '977' || substr({sql_isbn13('p_partkey')}, 4) ELSE p_name END"


@query(f"WITH q AS (SELECT p_partkey, upper(regexp_replace({_ASKED}, '[\\s-]', '', 'g')) AS q FROM part) SELECT p_partkey, CASE WHEN "
    f"regexp_full_match(q, '[0-9]{{9}}[0-9X]|97[89][0-9]{{10}}') THEN q END AS isbn FROM q")
def isbn_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that look like ISBNs and such that don't."""
    k = F.col("p_partkey")
    ten, long = v.isbn10(k), v.isbn13(k)
    rest = F.substring(long, 4, 10)
    asked = F.when(k % 5 == 0, long).when(k % 5 == 1, F.concat(F.lit("978-"), rest, F.lit(" "))).when(k % 5 == 2, F.lower(ten)).when(k % 5 == 3,
        F.concat(F.lit("977"), rest)).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select(k, isbn_query(asked).alias("isbn"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN {sql_isbn10('p_partkey + 1')} ELSE {sql_isbn10('p_partkey')} END AS isbn10, CASE WHEN "
    f"p_partkey % 2 = 0 THEN {sql_isbn13('p_partkey')} END AS isbn13 FROM part")
def identifiers_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first identifier of each type, whatever the type's case."""
    k = F.col("p_partkey")
    one = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("identifier"))
    ids = F.filter(F.array(one("OTHER", F.lit("x")), F.when(k % 3 == 0, one("isbn_10", v.isbn10(k + 1))),
        F.when(k % 2 == 0, one("Isbn_13", v.isbn13(k))), one("ISBN_10", v.isbn10(k))), lambda x: x.isNotNull())
    return read(spark, sf_dir, "part").select(k, identifier_of(ids, "ISBN_10").alias("isbn10"), identifier_of(ids, "ISBN_13").alias("isbn13"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 6 < 5 AND o_orderkey % 7 < 5 THEN (CASE WHEN o_orderkey % 7 = 2 OR o_orderkey % "
        "7 = 3 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END)::date::varchar END AS release_date FROM orders"
)
def release_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of upcoming books, as feeds spell them: days, months, bare years (none), nonsense (none)."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    spelled = F.when(k % 7 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 7 == 1, F.date_format(d, "MMMM d, yyyy")).when(k % 7 == 2,
        F.date_format(d, "yyyy-MM")).when(k % 7 == 3, F.date_format(d, "MMM yyyy")).when(k % 7 == 4, F.date_format(d, "M/d/yyyy"))
    spelled = spelled.when(k % 7 == 5, F.date_format(d, "yyyy")).otherwise(F.lit("soon"))
    section = F.when(k % 2 == 0, "upcoming").otherwise("popular")
    return read(spark, sf_dir, "orders").select(k, release_date(section, spelled).cast("string").alias("release_date"))


_CLAMPED = "least(greatest(0, floor({x} + 0.5)), {most})"


@query(
    "WITH e AS (SELECT event_id, value AS x, (event_id % 6) * 50 AS pc FROM events), b AS (SELECT *, " + _CLAMPED.format(x="x", most="CASE WHEN pc > "
        "0 THEN pc ELSE 9007199254740991 END") + "::bigint AS pages, " + _CLAMPED.format(x="x", most="100") + "::bigint AS percent FROM e) "
    "SELECT event_id, 'pages' AS driver, pages, CASE WHEN pc > 0 THEN floor(pages / pc * 100 + 0.5)::bigint ELSE 7 END AS percent FROM b UNION ALL "
        "SELECT event_id, 'percent', CASE WHEN pc > 0 THEN floor(percent / 100 * pc + 0.5)::bigint ELSE 3 END, percent FROM b "
    "UNION ALL SELECT event_id, 'page_count', CASE WHEN pc > 0 THEN least(3, pc) ELSE 3 END, CASE WHEN pc > 0 THEN floor(least(3, pc) / pc * 100 + "
        "0.5)::bigint ELSE 7 END FROM b"
)
def reading_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of pages, of percent and of the page count, from page 3 and 7 percent."""
    e = read(spark, sf_dir, "events").select("event_id", "value", ((F.col("event_id") % 6) * 50).cast("int").alias("pc"))
    out = None
    for driver in ("pages", "percent", "page_count"):
        pages, percent = (F.col("value") if driver == d else F.lit(x) for d, x in (("pages", 3), ("percent", 7)))
        p, q, _ = progress(pages, percent, F.col("pc"), driver)
        rows = e.select("event_id", F.lit(driver).alias("driver"), p.cast("long").alias("pages"), q.cast("long").alias("percent"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT page_id, url LIKE 'https://%' AND page_id % 5 <> 0 AND page_id % 7 <> 0 AS ok FROM pages")
def cover_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as covers: every fifth with user info, every seventh too long."""
    p, url = F.col("page_id"), F.col("url")
    given = F.when(p % 5 == 0, F.regexp_replace(url, "://", "://user:x@")).when(p % 7 == 0, F.concat(F.regexp_replace(url, "[?#].*$", ""),
        F.repeat(F.lit("/a"), F.lit(1000)))).otherwise(F.concat(F.lit(" "), F.regexp_replace(url, "[?#].*$", "")))
    return read(spark, sf_dir, "pages").select(p, valid_cover_url(given).alias("ok"))


@query("SELECT o_orderkey AS entry_id, CASE WHEN o_orderkey % 3 = 0 THEN 'legacy' WHEN o_orderkey % 2 = 0 THEN 'part' END AS source, CASE WHEN "
    "o_orderkey % 3 = 0 THEN 'entry-' || o_orderkey ELSE (o_orderkey % 200)::varchar END AS source_book_id, CASE WHEN o_orderkey % 3 = 0 THEN "
    "'Unknown title' ELSE 'Book ' || o_orderkey END AS title FROM orders")
def legacy_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.entries_by_order(spark, sf_dir).withColumn("title", F.when(F.col("entry_id") % 3 != 0, F.concat(F.lit("Book "), "entry_id")))
    return shelves.backfill_entries(rows).select("entry_id", "source", "source_book_id", "title")


@query(f"SELECT o_orderkey AS entry_id, o_custkey::int AS user_id, {sql_stamp('o_orderdate')} AS updated_date FROM orders WHERE o_custkey IN (SELECT "
    f"c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def owner_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the users of one segment, newest first."""
    users = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("int").alias("user_id"))
    dated = v.entries_by_order(spark, sf_dir).join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"),
        F.col("o_orderdate").cast("timestamp").alias("updated_date")), "entry_id")
    return shelves.entries_for(dated, users).select("entry_id", "user_id", stamp("updated_date").alias("updated_date"))


@query(
    v.FOLDED + ", t AS (SELECT *, 'Book ' || lpad(k::varchar, 4, '0') AS title, CASE WHEN k % 3 <> 0 THEN 'author ' || lpad((k % 7)::varchar, 2, '0') "
        "ELSE '' END AS authors FROM folded) "
    "SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY updated_date DESC, k) AS recent, row_number() OVER (PARTITION BY user_id "
        "ORDER BY title, k) AS by_title, row_number() OVER (PARTITION BY user_id ORDER BY authors, k) AS by_author FROM t"
)
def shelf_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each entry of a user in the orders by recency, title and author."""
    from ..operators import windows

    k = F.col("k")
    rows = windows.fold_entries(v.shelf_requests(spark, sf_dir), ["user_id", "k"], ["ts", "request_id"]).withColumns({
        "entry_id": k, "title": F.concat(F.lit("Book "), F.lpad(k.cast("string"), 4, "0")), "authors": F.when(k % 3 != 0, F.concat(F.lit("author "),
            F.lpad((k % 7).cast("string"), 2, "0"))),
    })
    place = lambda by: F.row_number().over(Window.partitionBy("user_id").orderBy(*shelves.shelf_order(by)))
    return rows.select("user_id", "k", place("recent").alias("recent"), place("title").alias("by_title"), place("author").alias("by_author"))


_CHANGES = f"""
{v.ENTRIES_BY_ORDER}, o AS (SELECT o_orderkey AS entry_id, CASE o_orderstatus WHEN 'F' THEN 'Read' WHEN 'O' THEN 'Reading' ELSE 'To Be Read' END AS status, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS end_date, o_orderdate AS ts FROM orders),
e AS (SELECT x.*, o.status, o.end_date, o.ts FROM entries_by_order x JOIN o USING (entry_id)),
r AS (SELECT entry_id, user_id, {sql_isbn13('(entry_id + entry_id % 2) % 500')} AS isbn13, (entry_id % 200)::varchar AS source_book_id, CASE WHEN entry_id % 2 = 0 THEN 'Read' ELSE 'Reading' END AS status, (entry_id % 100)::int AS pages, ts FROM e WHERE entry_id % 3 = 0),
clash AS (SELECT r.entry_id FROM r JOIN e ON r.user_id = e.user_id AND (r.isbn13 = e.isbn13 OR (e.source = 'part' AND r.source_book_id = e.source_book_id)) GROUP BY r.entry_id HAVING min(e.entry_id) <> r.entry_id)
"""


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries by order with all their columns, and a request for every third."""
    dates = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    some = v.entries_by_order(spark, sf_dir)
    schema = spark.createDataFrame([], TABLES["book_entries"]).schema
    default = {"pages_completed": F.lit(0), "percent_completed": F.lit(0), "title": F.lit("Old")}
    entries = some.select(*[(F.col(f.name) if f.name in some.columns else default.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema])
    k, none = F.col("entry_id"), F.lit(None).cast("string")
    requests = some.join(dates, "entry_id").where(k % 3 == 0).select(
        k.alias("request_id"), "ts", "user_id", k.alias("entry_id"), F.lit(" part ").alias("source"), (k % 200).cast("string").alias(
            "source_book_id"), F.lit("New").alias("title"), none.alias("authors"), none.alias("thumbnail_url"), none.alias("isbn10"),
        v.isbn13((k + k % 2) % 500).alias("isbn13"), F.when(k % 2 == 0, "READ").otherwise("reading").alias("status"), F.lit(100).alias("page_count"),
            (k % 100).cast("int").alias("pages_completed"), F.lit(None).cast("int").alias("percent_completed"),
    )
    return entries, requests


@query(
    f"WITH {_CHANGES} SELECT e.entry_id, CASE WHEN hit THEN r.status ELSE e.status END AS status, CASE WHEN hit THEN r.isbn13 ELSE e.isbn13 END AS "
        f"isbn13, CASE WHEN hit THEN 'New' ELSE 'Old' END AS title, CASE WHEN NOT hit THEN 0 WHEN into_read THEN 100 ELSE r.pages END AS "
        f"pages_completed, CASE WHEN into_read THEN 100 ELSE 0 END AS percent_completed, "
    f"{sql_stamp('CASE WHEN into_read THEN r.ts ELSE e.end_date END')} AS "
        f"end_date, {sql_stamp('CASE WHEN hit AND NOT into_read AND r.status = ' + chr(39) + 'Reading' + chr(39) + ' THEN r.ts END')} AS start_date "
    "FROM (SELECT e.*, r.entry_id IS NOT NULL AND e.entry_id NOT IN (FROM clash) AS hit, r.entry_id IS NOT NULL AND e.entry_id NOT IN (FROM clash) "
        "AND r.status = 'Read' AND e.status <> 'Read' AS into_read FROM e LEFT JOIN r USING (entry_id)) e LEFT JOIN r USING (entry_id)"
)
def entry_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries after updates by id; requests whose keys are another entry's change nothing."""
    out, _ = shelves.update_entries(*_changes(spark, sf_dir))
    return out.select("entry_id", "status", "isbn13", "title", "pages_completed", "percent_completed", stamp("end_date").alias("end_date"),
        stamp("start_date").alias("start_date"))


@query(f"WITH {_CHANGES}, m AS (SELECT r.entry_id, min(e.entry_id) AS other FROM r JOIN e ON r.user_id = e.user_id AND (r.isbn13 = e.isbn13 OR "
    f"(e.source = 'part' AND r.source_book_id = e.source_book_id)) GROUP BY ALL) SELECT entry_id, other FROM m WHERE other <> entry_id")
def update_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, requests = _changes(spark, sf_dir)
    return joins.update_conflicts(entries, requests).select("entry_id", F.col("match_id").alias("other"))


@query(v.FOLDED + f"SELECT user_id, k::varchar AS source_book_id, status, page_count, pages_completed, percent_completed, {sql_stamp('start_date')} "
    f"AS start_date, {sql_stamp('end_date')} AS end_date, {sql_stamp('updated_date')} AS updated_date FROM folded")
def entry_upsert_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests up to February onto no entries, and the later ones onto those entries: the same as all of them at once."""
    requests = event_requests(v.shelf_requests(spark, sf_dir))
    cut = F.lit("2024-02-01").cast("timestamp")
    before = shelves.upsert_entries(spark.createDataFrame([], TABLES["book_entries"]), requests.where(F.col("ts") < cut))
    out = shelves.upsert_entries(before, requests.where(F.col("ts") >= cut))
    return out.select("user_id", "source_book_id", "status", "page_count", "pages_completed", "percent_completed",
        *[stamp(c).alias(c) for c in ("start_date", "end_date", "updated_date")])


_SAY = lambda t, k, f, m, w: f"SELECT '{t}' AS rules, {k}::varchar AS key, '{f}' AS field, '{f} {m}' AS message FROM {t} WHERE {w}"


@query(
    "WITH registration AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN ' ' WHEN c_custkey % 7 = 1 THEN 'x' ELSE c_name END AS username, "
        "repeat('f', (c_custkey % 120)::int) AS first_name, CASE WHEN c_custkey % 5 <> 0 THEN 'L' END AS last_name, CASE WHEN c_custkey % 3 = 0 THEN "
        "c_name ELSE c_name || '@example.org' END AS email, repeat('p', (c_custkey % 140)::int) AS password FROM customer), "
    "login AS (SELECT k, email, password FROM registration), goal AS (SELECT c_custkey AS k, (c_custkey % 1100)::int AS target, (1995 + c_custkey % "
        "35)::int AS year FROM customer), "
    "entry AS (SELECT event_id AS k, repeat('t', (event_id % 600)::int) AS title, (event_id % 130)::int AS percent, CASE WHEN event_id % 4 = 0 THEN "
        "'' ELSE event_type END AS status FROM events) "
    + " UNION ALL ".join([
        _SAY("registration", "k", "username", "is required.", "trim(username) = ''"), _SAY("registration", "k", "username", "must have at least 2 "
            "characters.", "length(username) < 2"), _SAY("registration", "k", "first_name", "is required.", "first_name = ''"),
        _SAY("registration", "k", "first_name", "must have at most 100 characters.", "length(first_name) > 100"), _SAY("registration", "k",
            "last_name", "is required.", "last_name IS NULL"), _SAY("registration", "k", "email", "is not a valid e-mail address.", "NOT contains(email, '@')"),
        _SAY("registration", "k", "password", "is required.", "password = ''"), _SAY("registration", "k", "password", "must have at most 128 "
            "characters.", "length(password) > 128"), _SAY("registration", "k", "password", "must have at least 8 characters.", "length(password) < 8"),
        _SAY("login", "k", "email", "is not a valid e-mail address.", "NOT contains(email, '@')"), _SAY("login", "k", "password", "is required.",
            "password = ''"), _SAY("login", "k", "password", "must have at most 128 characters.", "length(password) > 128"),
        _SAY("goal", "k", "target_book_count", "must be between 1 and 1000.", "target NOT BETWEEN 1 AND 1000"), _SAY("goal", "k", "year",
            "must be between 2000 and 2025.", "year NOT BETWEEN 2000 AND 2025"),
        _SAY("entry", "k", "title", "is required.", "title = ''"), _SAY("entry", "k", "title", "must have at most 500 characters.", "length(title) > "
            "500"), _SAY("entry", "k", "status", "is required.", "status = ''"), _SAY("entry", "k", "percent_completed", "must be between 0 and 100.",
            "percent > 100"),
    ])
)
def rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rows of registrations, logins, goals and entry requests break of their rules."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    many = lambda letter, n: F.repeat(F.lit(letter), n.cast("int"))
    people = c.select(
        k.alias("k"), F.when(k % 7 == 0, " ").when(k % 7 == 1, "x").otherwise(F.col("c_name")).alias("username"), many("f", k % 120).alias(
            "first_name"), F.when(k % 5 != 0, "L").alias("last_name"),
        F.when(k % 3 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("@example.org"))).alias("email"), many("p", k % 140).alias("password"),
    )
    goals = c.select(k.alias("k"), (k % 1100).cast("int").alias("target_book_count"), (1995 + k % 35).cast("int").alias("year"))
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    short = {name: F.lit(None).cast("string") for name in ("source", "source_book_id", "authors", "thumbnail_url", "isbn10", "isbn13")}
    entries = e.select(i.alias("k"), many("t", i % 600).alias("title"), (i % 130).cast("int").alias("percent_completed"),
        F.when(i % 4 == 0, "").otherwise(F.col("event_type")).alias("status"), F.lit(1).alias("page_count"),
        F.lit(1).alias("pages_completed")).withColumns(short)
    out = None
    for name, (rows, rules) in {
        "registration": (people, validation.REGISTRATION_RULES), "login": (people, validation.LOGIN_RULES),
            "goal": (goals, validation.goal_rules(2024)), "entry": (entries, validation.ENTRY_RULES),
    }.items():
        found = validation.validate(rows, rules, ["k"])[1].select(F.lit(name).alias("rules"), F.col("k").cast("string").alias("key"), "field", "message")
        out = found if out is None else out.unionByName(found)
    return out


@query(
    f"WITH r AS ({v.SHELF_REQUESTS}), x AS (SELECT *, CASE WHEN request_id % 6 = 0 THEN 'Unknown' ELSE status END AS s, CASE WHEN request_id % 5 = 0 "
        f"THEN pages_completed + 1000 ELSE pages_completed END AS p FROM r) "
    "SELECT request_id, CASE WHEN s = 'Unknown' THEN 'The selected reading status is not valid.' WHEN page_count > 0 AND p > page_count THEN 'Pages "
        "completed cannot exceed the book''s page count.' ELSE 'An ISBN or source identifier is required.' END AS message "
    "FROM x WHERE s = 'Unknown' OR (page_count > 0 AND p > page_count) OR request_id % 7 = 0"
)
def entry_rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with states that aren't known, too many pages, or no identifier, and the first rule that each breaks."""
    i = F.col("request_id")
    rows = event_requests(v.shelf_requests(spark, sf_dir)).withColumns({
        "status": F.when(i % 6 == 0, "Unknown").otherwise(F.col("status")), "pages_completed": F.when(i % 5 == 0, F.col("pages_completed")
            + 1000).otherwise(F.col("pages_completed")), "source_book_id": F.when(i % 7 != 0, F.col("source_book_id")),
    })
    return validation.validate_entries(rows)[1].select("request_id", "message")


_TIMES = "ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-02-10'"


@query(f"SELECT 'actor' AS lookup, event_id AS log_id FROM events WHERE user_id = 7 AND {_TIMES} UNION ALL SELECT 'trace', event_id FROM events WHERE "
    f"event_id % 100 = 42 UNION ALL SELECT 'range', event_id FROM events WHERE {_TIMES}")
def audit_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log by actor and time, by trace, and by time alone."""
    from datetime import datetime

    from ..operators import audit

    e = read(spark, sf_dir, "events")
    logs = e.select(
        F.col("event_id").alias("log_id"), F.col("ts").cast("timestamp").alias("started_at"), F.col("event_type").alias("api_name"),
            F.col("user_id").cast("string").alias("actor_id"), F.concat(F.lit("t"), F.col("event_id") % 100).alias("trace_id")
    )
    start, end = datetime(2024, 1, 3), datetime(2024, 2, 10)
    found = {"actor": audit.audit_lookup(logs, start, end, actor_id="7"), "trace": audit.audit_lookup(logs, trace="t42"), "range": audit.audit_lookup(
        logs, start, end)}
    rows = [df.select(F.lit(name).alias("lookup"), "log_id") for name, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
