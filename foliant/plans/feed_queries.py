"""Registered queries that write the tables as feeds, catalogue files and tables, and read them back with the library's sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import identifier_of
from ..operators import catalog, search
from ..schemas import TABLES, VOLUMES
from ..shared import work_dir
from ..sources import feeds
from ..sources.catalog_csv import read_catalog_csv
from ..sources.tables import load_table, save_table
from . import views as v
from .views import read, sql_isbn10, sql_isbn13

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Items of a response.
PAGE = 200


def _responses(df: DataFrame, item: Column, key: Column, field: str) -> DataFrame:
    """A row for each response: items of PAGE neighbouring keys, in the order of the keys."""
    pages = df.groupBy(F.floor(key / PAGE).alias("page")).agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), item.alias("x")))).alias("xs"))
    return pages.select("page", F.transform("xs", lambda x: x["x"]).alias(field))


def _written(df: DataFrame, name: str) -> str:
    """Writes each row as a JSON file of its own."""
    path = work_dir(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", 1).option("ignoreNullFields", "false").json(path)
    return path


def _volume_pages(spark: SparkSession, sf_dir: str) -> str:
    """Parts as responses of the volume feed: every ninth isn't English, every eleventh has no title, every thirteenth no id."""
    k = F.col("p_partkey")
    text = lambda c: F.lit(None).cast("string") if c is None else c
    ids = F.array(F.struct(F.lit("isbn_13").alias("type"), v.isbn13(k).alias("identifier")), F.struct(F.lit("OTHER").alias("type"),
        F.concat(F.lit("x-"), k).alias("identifier")))
    links = F.when(F.col("p_size") % 3 != 0, F.struct(F.concat(F.lit("small-"), k).alias("smallThumbnail"),
        F.when(k % 2 == 0, F.concat(F.lit("large-"), k)).alias("thumbnail")))
    info = F.struct(
        F.when(k % 11 != 0, F.col("p_name")).alias("title"), text(None).alias("subtitle"), F.array("p_brand", F.lit("")).alias("authors"),
            F.col("p_type").alias("description"), F.when(k % 4 != 0, F.lit("house")).alias("publisher"),
        F.lit("2024-05-01").alias("publishedDate"), F.col("p_size").alias("pageCount"), F.when(k % 9 == 0, "es").otherwise("en").alias("language"),
            F.array("p_type").alias("categories"), links.alias("imageLinks"), ids.alias("industryIdentifiers"),
    )
    item = F.struct(F.when(k % 13 != 0, F.concat(F.lit("v"), k)).alias("id"), info.alias("volumeInfo"))
    return _written(_responses(read(spark, sf_dir, "part"), item, k, "items").select(F.col("items").cast(VOLUMES.split(" ", 1)[1]).alias("items")), "volumes")


_SQL_VOLUMES = f"SELECT *, 'v' || p_partkey AS id, {sql_isbn13('p_partkey')} AS isbn13, CASE WHEN p_size % 3 <> 0 THEN 'small-' || p_partkey END AS small, CASE WHEN p_size % 3 <> 0 AND p_partkey % 2 = 0 THEN 'large-' || p_partkey END AS large FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0"


@query(f"SELECT id, p_name AS title, p_brand || ',' AS authors, p_type AS description, CASE WHEN p_partkey % 4 <> 0 THEN 'house' END AS publisher, "
    f"p_size AS page_count, small AS small_thumbnail, large AS thumbnail, isbn13, 2 AS n_identifiers FROM ({_SQL_VOLUMES})")
def feed_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.read_volumes(spark, _volume_pages(spark, sf_dir))
    return rows.select("id", "title", F.array_join("authors", ",").alias("authors"), "description", "publisher", "page_count", "small_thumbnail",
        "thumbnail", identifier_of(F.col("identifiers"), "ISBN_13").alias("isbn13"), F.size("identifiers").alias("n_identifiers"))


@query(f"SELECT 'volumes' AS source, id AS source_book_id, p_name AS title, p_brand || ', ' AS authors, coalesce(large, small) AS thumbnail_url, "
    f"NULL::varchar AS isbn10, isbn13, 'Reading' AS status, p_size AS page_count, 0 AS pages_completed, 0 AS percent_completed FROM ({_SQL_VOLUMES})")
def volume_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.volumes_to_entries(feeds.read_volumes(spark, _volume_pages(spark, sf_dir)), "Reading")


@query(f"SELECT isbn13, id AS source_book_id, p_name AS title, p_brand AS authors, p_type AS description, coalesce(large, small, '') AS cover_url, "
    f"CASE WHEN p_partkey % 4 <> 0 THEN 'house' ELSE '' END AS publisher, 'GoogleBooks' AS provider FROM ({_SQL_VOLUMES})")
def volume_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.read_volumes(spark, _volume_pages(spark, sf_dir)).withColumn("isbn13", identifier_of(F.col("identifiers"), "isbn_13"))
    return feeds.metadata_from_volumes(rows).select("isbn13", "source_book_id", "title", F.array_join("authors", ",").alias("authors"), "description",
        "cover_url", "publisher", "provider")


@query(
    f"SELECT DISTINCT 'list ' || l_returnflag AS list_name, p_name AS title, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS author, "
        f"p_partkey % 30 AS weeks_on_list, {sql_isbn10('p_partkey')} AS isbn10, CASE WHEN p_partkey % 3 <> 0 THEN {sql_isbn13('p_partkey')} END AS "
        f"isbn13, 1 AS n_links "
    "FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 7 <> 0 AND p_partkey // 200 % 10 <> 9"
)
def feed_bestsellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts sold with each return flag as lists: a seventh of the books are null, every tenth response isn't OK, and every response has a null list."""
    k = F.col("p_partkey")
    sold = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag").distinct().join(read(spark, sf_dir, "part"),
        "p_partkey")
    none = F.lit(None).cast("string")
    links = F.array(F.lit(None).cast("struct<name:string,url:string>"), F.struct(F.lit("shop").alias("name"), F.lit("u").alias("url")))
    book = F.when(k % 7 != 0, F.struct(
        F.col("p_name").alias("title"), F.when(k % 5 != 0, F.col("p_brand")).alias("author"), none.alias("description"), none.alias("publisher"),
            v.isbn10(k).alias("primary_isbn10"), F.when(k % 3 != 0, v.isbn13(k)).alias("primary_isbn13"),
        none.alias("book_image"), (k % 30).cast("int").alias("weeks_on_list"), none.alias("age_group"), none.alias("contributor"),
            none.alias("contributor_note"), none.alias("amazon_product_url"), none.alias("created_date"), links.alias("buy_links"),
    ))
    lists = sold.groupBy("l_returnflag", F.floor(k / PAGE).alias("page")).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), book.alias("b")))).alias("xs"))
    one = F.struct(F.concat(F.lit("list "), "l_returnflag").alias("display_name"), F.transform("xs", lambda x: x["b"]).alias("books"))
    result = F.struct(F.lit("2024-01-01").alias("bestsellers_date"), F.array(F.when(F.lit(False), one), one).alias("lists"))
    path = _written(lists.select(F.when(F.col("page") % 10 == 9, "ERROR").otherwise("OK").alias("status"), result.alias("results")), "bestsellers")
    rows = feeds.read_bestsellers(spark, path)
    isbn = lambda i: F.col("isbns")[i]["identifier"]
    return rows.select("list_name", "title", "author", "weeks_on_list", isbn(0).alias("isbn10"), isbn(1).alias("isbn13"), F.size("buy_links").alias("n_links"))


@query(
    f"SELECT 'openlibrary-works-OL' || p_partkey || 'W' AS id, p_name AS title, p_brand AS authors, (1900 + p_size)::varchar AS published_date, "
        f"'https://covers.openlibrary.org/b/id/' || p_size || '-L.jpg' AS thumbnail, "
    f"{sql_isbn10('p_partkey')} AS isbn10, {sql_isbn13('p_partkey')} AS isbn13, p_partkey % 100 AS readinglog_count FROM part WHERE p_partkey % 6 <> "
        f"0 AND p_partkey % 17 <> 0"
)
def feed_open_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as works: every sixth has a blank title, every seventeenth no key; ISBNs come twice and with blanks."""
    k = F.col("p_partkey")
    isbns = F.array(F.lit(" "), v.isbn13(k), v.isbn10(k), v.isbn10(k + 1), v.isbn13(k + 1))
    work = F.struct(
        F.when(k % 17 != 0, F.concat(F.lit("/works/OL"), k, F.lit("W"))).alias("key"), F.when(k % 6 == 0, " ").otherwise(F.col("p_name")).alias(
            "title"), F.array("p_brand").alias("author_name"), isbns.alias("isbn"),
        F.col("p_size").cast("int").alias("cover_i"), (1900 + F.col("p_size")).cast("int").alias("first_publish_year"), (k % 100).cast("int").alias(
            "readinglog_count"),
    )
    rows = feeds.read_open_works(spark, _written(_responses(read(spark, sf_dir, "part"), work, k, "docs").select("docs"), "works"))
    isbn = lambda kind: identifier_of(F.col("identifiers"), kind)
    return rows.select("id", "title", F.array_join("authors", ",").alias("authors"), "published_date", "thumbnail", isbn("ISBN_10").alias("isbn10"),
        isbn("ISBN_13").alias("isbn13"), "readinglog_count")


@query(
    f"SELECT {sql_isbn13('p_partkey')} AS isbn13, 'openlibrary-' || CASE WHEN p_partkey % 3 = 0 THEN 'isbn-' || {sql_isbn13('p_partkey')} ELSE "
        f"'books-B' || p_partkey END AS source_book_id, p_name AS title, p_brand AS authors, CASE WHEN p_partkey % 2 = 0 THEN 'large' ELSE 'medium' "
        f"END AS cover_url, p_type AS publisher, "
    f"{sql_isbn10('p_partkey')} || ',' || {sql_isbn13('p_partkey')} AS identifiers FROM part WHERE p_partkey % 7 <> 0"
)
def library_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as books of the library feed: every seventh has no author; the ISBN asked for is given for even parts only."""
    k = F.col("p_partkey")
    name = lambda c: F.struct(c.alias("name"))
    book = F.struct(
        v.isbn13(k).alias("isbn"), F.col("p_name").alias("title"), F.when(k % 3 != 0, F.concat(F.lit("/books/B"), k)).alias("key"),
            F.array(name(F.lit("")), name(F.when(k % 7 != 0, F.col("p_brand")))).alias("authors"), F.array(name(F.col("p_type")),
            name(F.lit("other"))).alias("publishers"),
        F.struct(F.when(k % 2 == 0, "large").alias("large"), F.lit("medium").alias("medium")).alias("cover"),
            F.struct(F.array(v.isbn10(k), F.lit(" ")).alias("isbn_10"), F.when(k % 2 == 0, F.array(v.isbn13(k))).alias("isbn_13")).alias(
            "identifiers"), F.lit("May 2024").alias("publish_date"),
    )
    path = work_dir(spark, "library")
    pages = _responses(read(spark, sf_dir, "part"), book, k, "books")
    pages.select(F.to_json("books", {"ignoreNullFields": "false"}).alias("value")).write.option("maxRecordsPerFile", 1).text(
        path)  # an array of books is a file
    rows = feeds.metadata_from_library(feeds.read_library_books(spark, path))
    return rows.select("isbn13", "source_book_id", "title", F.array_join("authors", ",").alias("authors"), "cover_url", "publisher",
        F.array_join(F.transform("identifiers", lambda x: x["identifier"]), ",").alias("identifiers"))


#: Lines of a catalogue file, which must stay below 2 MiB.
LINES = 5_000
_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
_SQL_FILE = f"(l_orderkey % (SELECT 1 + count(*) // {LINES} FROM lineitem))::int"
_SQL_LINES = f"SELECT *, {_SQL_FILE} AS file, 1 + row_number() OVER (PARTITION BY {_SQL_FILE} ORDER BY {', '.join(_ORDER)}) AS row FROM lineitem"


@query(
    f"WITH l AS ({_SQL_LINES}), f AS (SELECT *, file % 5 = 4 AS bad FROM l) SELECT file, row::int AS row, 'row' AS kind, {sql_isbn13('l_partkey')} AS "
        f"isbn, 'Part \"' || l_partkey || '\", vol. ' || l_linenumber AS field, 'Supplier' || chr(10) || l_suppkey AS text FROM f WHERE NOT bad AND "
        f"l_linenumber NOT IN (6, 7) "
    "UNION ALL SELECT file, row::int, 'error', NULL, 'row', 'Expected 3 columns but found 2.' FROM f WHERE NOT bad AND l_linenumber = 7 UNION ALL "
        "SELECT DISTINCT file, 1, 'error', NULL, 'header', m FROM f, (VALUES ('Unknown columns: genre.'), ('Missing columns: author.')) x(m) WHERE bad"
)
def catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as catalogue files of some LINES records: quoted commas, quotes and line ends; blank records (line 6), short ones (line 7), and every fifth file with an unknown and a missing column."""
    line = read(spark, sf_dir, "lineitem")
    n = line.agg((1 + F.floor(F.count("*") / LINES)).alias("n")).first()["n"]
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    isbn, title, author = v.isbn13(F.col("l_partkey")), F.concat(F.lit('Part "'), "l_partkey", F.lit('", vol. '), "l_linenumber"), F.concat(
        F.lit("Supplier\n"), "l_suppkey")
    value = F.when(F.col("l_linenumber") == 6, F.lit(" ,, ")).when(F.col("l_linenumber") == 7, F.concat_ws(",", isbn, quoted(title))).otherwise(
        F.concat_ws(",", quoted(author), isbn, quoted(title)))
    rows = line.select((F.col("l_orderkey") % n).cast("int").alias("file"), F.struct(*_ORDER).alias("o"), value.alias("value"))
    files = rows.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "value"))), lambda x: x["value"]),
        "\r\n").alias("body"))  # a file is below 2 MiB
    header = F.when(F.col("file") % 5 == 4, F.lit("genre, ISBN,title")).otherwise(F.lit("﻿Author, ISBN,title"))
    path = work_dir(spark, "catalogs")
    # each file is a row of text without a line end of its own
    files.select("file", F.concat(header, F.lit("\r\n"), "body").alias("value")).repartition("file").write.partitionBy("file").option("lineSep",
        "\r\n").format("text").save(path)
    good, errors = read_catalog_csv(spark, path, pattern="*.txt")
    number = F.regexp_extract("file", r"file=(\d+)", 1).cast("int").alias("file")
    both = good.select(number, "row", F.lit("row").alias("kind"), "isbn", F.col("title").alias("field"), F.col("author").alias("text"))
    return both.unionByName(errors.select(number, "row", F.lit("error").alias("kind"), F.lit(None).cast("string").alias("isbn"), "field",
        F.col("message").alias("text")))


@query(
    f"WITH {v.CATALOG_BOOKS}, {v.BATCHES} SELECT 'catalog_books' AS table_name, batch_id || '/' || section || '/' || position AS key, isbn13 AS value "
        f"FROM catalog_books UNION ALL SELECT 'catalog_batches', batch_id::varchar, status FROM batches "
    "UNION ALL SELECT 'reading_goals', user_id || '/' || year, target_book_count::varchar FROM (" + v.GOALS + f") UNION ALL SELECT "
        f"'book_metadata', {sql_isbn13('p_partkey')}, p_name FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT 'users', c_custkey::varchar, c_name "
        f"FROM customer "
    "UNION ALL SELECT 'book_entries', o_orderkey::varchar, CASE o_orderstatus WHEN 'F' THEN 'Read' WHEN 'O' THEN 'Reading' ELSE 'To Be Read' END FROM "
        "orders UNION ALL SELECT 'api_request_logs', event_id::varchar, event_type FROM events"
)
def typed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven tables, saved with their types (the log by day) and loaded again."""
    c = read(spark, sf_dir, "customer")
    e = read(spark, sf_dir, "events")
    tables = {
        "users": c.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("id-"), "c_custkey").alias("identity_user_id"),
            F.col("c_name").alias("username")),
        "book_entries": v.entries_by_order(spark, sf_dir), "reading_goals": v.goals(spark, sf_dir), "catalog_batches": v.batches(spark, sf_dir),
            "catalog_books": v.catalog_books(spark, sf_dir), "book_metadata": v.metadata_rows(spark, sf_dir, "cache"),
        "api_request_logs": e.select(F.col("event_id").alias("log_id"), F.col("ts").alias("started_at"), F.col("event_type").alias("api_name"),
            F.to_date("ts").alias("day")),
    }
    keys = {
        "users": ("user_id", "username"), "book_entries": ("entry_id", "status"), "reading_goals": (F.concat_ws("/", "user_id", "year"),
            "target_book_count"), "catalog_batches": ("batch_id", "status"),
        "catalog_books": (F.concat_ws("/", "batch_id", "section", "position"), "isbn13"), "book_metadata": ("isbn13", "title"),
            "api_request_logs": ("log_id", "api_name"),
    }
    path, out = work_dir(spark, "tables"), None
    for name, df in tables.items():
        schema = spark.createDataFrame([], TABLES[name]).schema
        whole = df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in df.columns])
        save_table(whole, name, f"{path}/{name}", ["day"] if name == "api_request_logs" else None)
        key, value = (F.col(x) if isinstance(x, str) else x for x in keys[name])
        rows = load_table(spark, name, f"{path}/{name}").select(F.lit(name).alias("table_name"), key.cast("string").alias("key"),
            value.cast("string").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


#: Descriptions that the genre rules are tried on, by part.
_BLURBS = (
    "A haunted house and its ghosts", "Dragons, wizards and a quest", "Androids in a dystopian future", "A detective and an unsolved case",
        "Spies and a hostage", "They fall in love at a wedding", "The Regency after a civil war", "A family saga", "Memoirs of a sailor",
    "The fall of an empire", "A teenager in high school", "Nothing of the kind", "GOTHIC romance; life of a sorceress", "history of magical robots",
)


def _rules_sql() -> str:
    from ..functions.books import GENRE_RULES

    return " UNION ALL ".join(f"SELECT '{g}' AS genre_slug, '(?i){p}' AS pattern" for g, p in GENRE_RULES.items())


@query(f"WITH rules AS ({_rules_sql()}), b AS (SELECT p_partkey, p_name || ' ' || [{', '.join(repr(x) for x in _BLURBS)}][p_partkey % {len(_BLURBS)} "
    f"+ 1] AS t FROM part) SELECT p_partkey, genre_slug FROM b, rules WHERE regexp_matches(t, pattern)")
def genre_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's own genre rules over parts with a description each."""
    from ..functions.books import classify

    blurb = F.element_at(F.array(*[F.lit(x) for x in _BLURBS]), (F.col("pos") % len(_BLURBS) + 1).cast("int"))
    return classify(v.volumes(spark, sf_dir).withColumn("description", blurb)).select(F.col("pos").alias("p_partkey"), "genre_slug")


_HAS = lambda c, x: f"contains(lower({c}), '{x}')"
_FOUND = "SELECT '{q}' AS query, 'part-' || p_partkey AS id FROM part WHERE {w} ORDER BY 'part-' || p_partkey LIMIT {n}"


@query(
    " UNION ALL ".join("(" + _FOUND.format(q=q, w=w, n=n) + ")" for q, w, n in (
        ("text", _HAS("p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_type", "hot") + " AND " + _HAS("p_name || ' ' || p_type || ' ' || "
            "p_brand || ' ' || p_type", "economy"), 40), ("subject", _HAS("p_type", "economy"), 40), ("author", _HAS("p_brand", "brand#1"), 40),
            ("title", _HAS("p_name", "gear"), 40),
        ("isbn", "p_partkey = 25", 1), ("routed isbn", "p_partkey = 25", 1), ("routed title", _HAS("p_name", "ring"), 40),
            ("routed author", _HAS("p_brand", "brand#2"), 40),
    ))
)
def search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by each field, with the page that it gives, and each route."""
    vol = v.volumes(spark, sf_dir)
    isbn = spark.range(1).select(v.isbn13(F.lit(25)).alias("i")).first()["i"]
    found = {
        "text": search.field_search(vol, text="Hot economy"), "subject": search.field_search(vol, subject="Economy"), "author": search.field_search(
            vol, inauthor="Brand#1"), "title": search.field_search(vol, intitle="GEAR"), "isbn": search.field_search(vol, isbn=isbn),
        "routed isbn": search.search(vol, f"{isbn[:3]}-{isbn[3:]}"), "routed title": search.search(vol, "ring", "title"),
            "routed author": search.search(vol, "brand#2", "author"),
    }
    out = None
    for name, df in found.items():
        rows = df.select(F.lit(name).alias("query"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "WITH k AS (SELECT DISTINCT upper(" + sql_isbn13("p_partkey") + ") AS k, (SELECT count(*) FROM part) AS n FROM part), b AS (SELECT k, ('0x' || "
        "substr(md5(k), 1, 8))::bigint % greatest(1, (n + 299) // 300) AS bucket FROM k), "
    "c AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY k) - 1) // 30 AS chunk FROM b) SELECT bucket, chunk, string_agg('ISBN:' || k, "
        "',' ORDER BY k) AS keys, count(*) AS n FROM c GROUP BY ALL"
)
def request_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.chunk_keys(v.volumes(spark, sf_dir).select(F.col("identifiers")[0]["identifier"].alias("isbn13")))
