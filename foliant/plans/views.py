"""Book-shaped views over the star-schema tables, in Spark and as SQL for the oracle.

ISBNs are made from whole numbers: the number in nine digits and its check digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import ean_check_digit, let, named_identifiers
from ..schemas import IDENTIFIERS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(c: Column | str) -> Column:
    """A timestamp as text with microseconds, the same in any session."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def isbn13(k: Column) -> Column:
    return let(F.concat(F.lit("978"), F.lpad(k.cast("string"), 9, "0")), lambda twelve: F.concat(twelve, ean_check_digit(twelve)))


def isbn10(k: Column) -> Column:
    def whole(body: Column) -> Column:
        total = F.lit(0)
        for i in range(9):
            total = total + F.substring(body, i + 1, 1).cast("int") * (10 - i)
        return let(F.pmod(11 - F.pmod(total, F.lit(11)), F.lit(11)), lambda check: F.concat(body, F.when(check == 10, "X").otherwise(check.cast("string"))))

    return let(F.lpad(k.cast("string"), 9, "0"), whole)


def sql_isbn13(k: str) -> str:
    body = f"lpad(({k})::varchar, 9, '0')"
    total = " + ".join(f"substr({body}, {i + 1}, 1)::int * {1 if i % 2 else 3}" for i in range(9))
    return f"('978' || {body} || ((10 - (38 + {total}) % 10) % 10)::varchar)"


def sql_isbn10(k: str) -> str:
    body = f"lpad(({k})::varchar, 9, '0')"
    total = " + ".join(f"substr({body}, {i + 1}, 1)::int * {10 - i}" for i in range(9))
    return f"({body} || CASE (11 - ({total}) % 11) % 11 WHEN 10 THEN 'X' ELSE ((11 - ({total}) % 11) % 11)::varchar END)"


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


STATUS_OF = {"signup": "To Be Read", "click": "Reading", "purchase": "Read", "error": "Did Not Finish", "view": "Not Interested"}
SQL_STATUS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_OF.items()) + " END"


def shelf_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as shelf requests: the book is props.k, the event's type the status."""
    return shelf_requests_of(read(spark, sf_dir, "events"))


def shelf_requests_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv]), F.col("event_type"))
    return events.select(
        F.col("event_id").alias("request_id"), "ts", F.col("user_id").cast("int").alias("user_id"), k.alias("k"), status.alias("status"),
            (k * 3).alias("page_count"),
        F.when(F.col("event_id") % 2 == 0, F.least(k * 3, F.floor("value").cast("int"))).alias("pages_completed"), F.when(F.col("event_id") % 3 != 0,
            F.least(F.lit(100), F.floor("value").cast("int"))).alias("percent_completed"),
    )


SHELF_REQUESTS = (
    f"SELECT event_id AS request_id, ts, user_id::int AS user_id, k, {SQL_STATUS} AS status, k * 3 AS page_count, CASE WHEN event_id % 2 = 0 THEN "
        f"least(k * 3, floor(value)::int) END AS pages_completed, "
    "CASE WHEN event_id % 3 <> 0 THEN least(100, floor(value)::int) END AS percent_completed FROM (SELECT *, regexp_extract(props, '\"k\": "
        "*([0-9]+)', 1)::int AS k FROM events)"
)

#: The fold of shelf requests as SQL; entries: user_id, k, status, page_count, pages_completed, percent_completed, start_date, end_date, updated_date.
FOLDED = f"""
WITH r AS ({SHELF_REQUESTS}),
s AS (SELECT *, row_number() OVER w AS n, status = 'Read' AND coalesce(lag(status) OVER w <> 'Read', true) AS into_read FROM r WINDOW w AS (PARTITION BY user_id, k ORDER BY ts, request_id)),
p AS (SELECT *, CASE WHEN into_read THEN 100 ELSE percent_completed END AS pc, CASE WHEN into_read AND page_count > 0 THEN page_count ELSE pages_completed END AS pg FROM s),
folded AS (SELECT user_id, k, arg_max(status, n) AS status, arg_max(page_count, n) AS page_count, coalesce(arg_max(pg, n) FILTER (WHERE pg IS NOT NULL), 0) AS pages_completed,
  coalesce(arg_max(pc, n) FILTER (WHERE pc IS NOT NULL), 0) AS percent_completed, min(ts) FILTER (WHERE status = 'Reading') AS start_date, max(ts) FILTER (WHERE into_read) AS end_date, max(ts) AS updated_date FROM p GROUP BY user_id, k)
"""


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("reading_goal_id"), F.col("c_custkey").cast("int").alias("user_id"), F.lit(2024).alias("year"),
        (1 + F.col("c_custkey") % 40).cast("int").alias("target_book_count"), F.lit("2024-01-01").cast("timestamp").alias("updated_date"))


GOALS = "SELECT c_custkey::int AS user_id, 2024 AS year, (1 + c_custkey % 40)::int AS target_book_count FROM customer"


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as volumes; every third has no cover."""
    k = F.col("p_partkey")
    cover = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("https://covers.example.org/"), k))
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), k).alias("id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("subtitle"),
            F.array("p_brand").alias("authors"), F.col("p_type").alias("description"), F.lit("").alias("publisher"),
        F.lit(None).cast("string").alias("published_date"), F.col("p_size").alias("page_count"), F.lit("en").alias("language"),
            F.array("p_type").alias("categories"), cover.alias("small_thumbnail"), cover.alias("thumbnail"),
        named_identifiers(F.lit(None).cast("string"), isbn13(k)).alias("identifiers"), F.lit("volumes").alias("feed"), k.alias("pos"),
    )


def bestsellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a line item of 49 or more: even keys have ISBN_13 only, odd ones ISBN_10 too, which then comes first."""
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    sold = read(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    odd = F.when(k % 2 == 1, isbn10(k))
    ids = F.array(F.struct(F.lit("ISBN_10").alias("type"), odd.alias("identifier")), F.struct(F.lit("ISBN_13").alias("type"),
        isbn13(k).alias("identifier"))).cast(IDENTIFIERS)
    return part.join(sold, "p_partkey", "left_semi").select(k.alias("pos"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"),
        F.col("p_type").alias("description"), F.lit("").alias("publisher"), ids.alias("isbns"),
        F.when(k % 5 != 0, F.lit("https://covers.example.org/b")).alias("book_image"))


#: Genre rules over the words of part names.
TEST_RULES = {"colours": r"\b(?:red|blue)\b", "hardware": r"\b(?:rings?|bolts?)\b", "sizes": r"\b(?:large|small)\b"}


def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as catalogue rows, an order a file; the check digit is cut off in line 7; some titles and authors are wrong."""
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    k = F.col("l_partkey")
    full = F.when(F.col("l_suppkey") % 2 == 0, isbn10(k)).otherwise(isbn13(k))
    isbn = F.when(F.col("l_linenumber") == 7, F.substring(full, 1, 9)).otherwise(full)
    rows = line.join(part, k == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("file"), isbn.alias("isbn"), F.when(F.col("l_suppkey") % 11 == 0, F.lit("no such title")).otherwise(
            F.col("p_name")).alias("title"), F.when(F.col("l_suppkey") % 13 == 0, F.lit(" ")).when(F.col("l_suppkey") % 17 == 0,
            F.lit("Somebody Else")).otherwise(F.col("p_brand")).alias("author"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate").alias("o"),
    )
    from pyspark.sql import Window

    return rows.withColumn("row", F.row_number().over(Window.partitionBy("file").orderBy("o")) + 1).drop("o")


IMPORT_ROWS = f"""
import_rows AS (SELECT l_orderkey AS file, CASE WHEN l_linenumber = 7 THEN substr(full_isbn, 1, 9) ELSE full_isbn END AS isbn, l_partkey, CASE WHEN l_suppkey % 11 = 0 THEN 'no such title' ELSE p_name END AS title,
  CASE WHEN l_suppkey % 13 = 0 THEN ' ' WHEN l_suppkey % 17 = 0 THEN 'Somebody Else' ELSE p_brand END AS author, l_linenumber, l_suppkey,
  1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS row
  FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN {sql_isbn10('l_partkey')} ELSE {sql_isbn13('l_partkey')} END AS full_isbn FROM lineitem JOIN part ON l_partkey = p_partkey))
"""


def metadata_rows(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Parts as metadata by p_partkey % 5: cache 0, library 1 and 2, volumes 3; 4 has none."""
    k = F.col("p_partkey")
    rest = {"cache": [0], "library": [1, 2], "volumes": [3]}[which]
    return read(spark, sf_dir, "part").where((k % 5).isin(rest)).select(
        isbn13(k).alias("isbn13"), F.concat(F.lit(which + "-"), k).alias("source_book_id"), F.col("p_name").alias("title"), F.array("p_brand").alias(
            "authors"), F.col("p_type").alias("description"), F.lit("base").alias("cover_url"),
        F.when(k % 10 == 0, "override").alias("cover_override_url"), F.lit("").alias("publisher"), named_identifiers(isbn10(k), isbn13(k)).alias(
            "identifiers"), F.lit("2024-05-01").alias("published_date"), F.lit(which).alias("provider"),
    )


SQL_PROVIDER = "CASE WHEN p_partkey % 5 = 0 THEN 'cache' WHEN p_partkey % 5 <= 2 THEN 'library' WHEN p_partkey % 5 = 3 THEN 'volumes' END"


def catalog_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts of each order as a batch's books: even suppliers' are popular, the others upcoming."""
    line = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch_id"), F.col("l_partkey").alias("k")).agg(
        F.min("l_suppkey").alias("s"), F.min("l_linenumber").alias("n"))
    from pyspark.sql import Window

    section = F.when(F.col("s") % 2 == 0, "popular").otherwise("upcoming")
    rows = line.withColumn("section", section)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("batch_id", "section").orderBy("n", "k"))).select("batch_id", "section",
        "position", isbn13(F.col("k")).alias("isbn13"), F.col("k").alias("source_key"))


CATALOG_BOOKS = f"""
catalog_books AS (SELECT batch_id, section, row_number() OVER (PARTITION BY batch_id, section ORDER BY n, k) AS position, {sql_isbn13('k')} AS isbn13, k AS source_key
  FROM (SELECT *, CASE WHEN s % 2 = 0 THEN 'popular' ELSE 'upcoming' END AS section FROM (SELECT l_orderkey AS batch_id, l_partkey AS k, min(l_suppkey) AS s, min(l_linenumber) AS n FROM lineitem GROUP BY ALL)))
"""


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Published").when(F.col("o_orderstatus") == "O", "Draft").otherwise("Archived")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), F.col("o_orderpriority").alias("genre_slug"),
        status.alias("status"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("timestamp")).alias("published_at"))


BATCHES = """
batches AS (SELECT o_orderkey AS batch_id, o_orderpriority AS genre_slug, CASE o_orderstatus WHEN 'F' THEN 'Published' WHEN 'O' THEN 'Draft' ELSE 'Archived' END AS status,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS published_at FROM orders)
"""


def entries_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "Read").when(F.col("o_orderstatus") == "O", "Reading").otherwise("To Be Read")
    return o.select(
        k.alias("entry_id"), F.col("o_custkey").cast("int").alias("user_id"), F.when(k % 4 != 0, isbn13(k % 500)).alias("isbn13"),
            F.when(k % 3 == 0, isbn10(k % 300)).alias("isbn10"), F.when(k % 2 == 0, "part").alias("source"),
        (k % 200).cast("string").alias("source_book_id"), status.alias("status"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast(
            "timestamp")).alias("end_date"),
    )


ENTRIES_BY_ORDER = f"""
entries_by_order AS (SELECT o_orderkey AS entry_id, o_custkey::int AS user_id, CASE WHEN o_orderkey % 4 <> 0 THEN {sql_isbn13('o_orderkey % 500')} END AS isbn13, CASE WHEN o_orderkey % 3 = 0 THEN {sql_isbn10('o_orderkey % 300')} END AS isbn10,
  CASE WHEN o_orderkey % 2 = 0 THEN 'part' END AS source, (o_orderkey % 200)::varchar AS source_book_id FROM orders)
"""
