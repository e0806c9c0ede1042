"""Nested feeds of books, flattened to one book shape.

Volume shape: id, title, subtitle, authors, description, publisher, published_date, page_count, language, categories, small_thumbnail, thumbnail, identifiers, feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import is_blank, named_identifiers
from ..schemas import BESTSELLERS, IDENTIFIERS, LIBRARY_BOOKS, OPEN_WORKS, VOLUMES

VOLUME_COLUMNS = ("id", "title", "subtitle", "authors", "description", "publisher", "published_date", "page_count", "language", "categories",
    "small_thumbnail", "thumbnail", "identifiers", "feed")
COVERS = "https://covers.openlibrary.org/b/id/"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    return flatten_volumes(_json(spark, path, VOLUMES))


def flatten_volumes(responses: DataFrame) -> DataFrame:
    """English items with an id and a title."""
    v = F.col("item.volumeInfo")
    rows = responses.select(F.explode("items").alias("item")).select(
        F.col("item.id").alias("id"), v["title"].alias("title"), v["subtitle"].alias("subtitle"), v["authors"].alias("authors"),
            v["description"].alias("description"), v["publisher"].alias("publisher"),
        v["publishedDate"].alias("published_date"), v["pageCount"].alias("page_count"), v["language"].alias("language"),
            v["categories"].alias("categories"), v["imageLinks"]["smallThumbnail"].alias("small_thumbnail"),
        v["imageLinks"]["thumbnail"].alias("thumbnail"), v["industryIdentifiers"].alias("identifiers"), F.lit("volumes").alias("feed"),
    )
    return rows.where("id <> '' and title <> '' and language = 'en'")


def read_bestsellers(spark: SparkSession, path: str) -> DataFrame:
    return flatten_bestsellers(_json(spark, path, BESTSELLERS))


def flatten_bestsellers(responses: DataFrame) -> DataFrame:
    """A row for each book of each list of responses that are OK; null lists, books and links are left out."""
    text = lambda c: F.coalesce(c, F.lit(""))
    lists = responses.where("status = 'OK'").select(F.col("results.bestsellers_date").alias("bestsellers_date"), F.posexplode("results.lists").alias(
        "list_pos", "list")).where("list is not null")
    books = lists.select("bestsellers_date", "list_pos", text(F.col("list.display_name")).alias("list_name"), F.posexplode("list.books").alias(
        "book_pos", "b")).where("b is not null")
    ids = F.array(F.struct(F.lit("ISBN_10").alias("type"), F.col("b.primary_isbn10").alias("identifier")), F.struct(F.lit("ISBN_13").alias("type"),
        F.col("b.primary_isbn13").alias("identifier")))
    return books.select(
        "bestsellers_date", "list_pos", "list_name", "book_pos", *[text(F.col(f"b.{c}")).alias(c) for c in ("age_group", "amazon_product_url",
            "author", "book_image", "contributor", "contributor_note", "description", "publisher", "title")],
        F.filter("b.buy_links", lambda x: x.isNotNull()).alias("buy_links"), F.col("b.created_date").alias("created_date"),
            ids.cast(IDENTIFIERS).alias("isbns"), F.coalesce("b.weeks_on_list", F.lit(0)).alias("weeks_on_list"),
    )


def bestsellers_to_volumes(books: DataFrame) -> DataFrame:
    """Bestseller rows (title, author, description, publisher, isbns, book_image) in volume shape; other columns stay. ISBN_10 comes first."""
    isbn = lambda i: F.coalesce(F.get("isbns", i)["identifier"], F.lit(""))
    cover = F.when(~is_blank(F.col("book_image")), F.col("book_image"))
    return books.withColumns({
        "id": F.regexp_replace(F.concat(F.lit("nyt-"), isbn(1), F.lit("-"), isbn(0)), "-+$", ""), "title": F.coalesce("title", F.lit("Untitled")),
            "authors": F.array(F.coalesce("author", F.lit("Unknown author"))),
        "description": F.coalesce("description", F.lit("")), "publisher": F.coalesce("publisher", F.lit("")), "language": F.lit("en"),
            "small_thumbnail": cover, "thumbnail": cover,
        "identifiers": named_identifiers(isbn(0), isbn(1)), "feed": F.lit("bestsellers"),
    })


def _slug(key: Column) -> Column:
    return F.translate(F.regexp_replace(key, "^/+|/+$", ""), "/", "-")


def read_open_works(spark: SparkSession, path: str) -> DataFrame:
    return flatten_open_works(_json(spark, path, OPEN_WORKS))


def flatten_open_works(responses: DataFrame) -> DataFrame:
    """Works with a title and key in volume shape, with the first ISBN of each length and readinglog_count."""
    works = responses.select(F.explode("docs").alias("w")).where(~is_blank(F.col("w.title")) & ~is_blank(F.col("w.key")))
    isbn = lambda n: F.get(F.filter("w.isbn", lambda x: ~is_blank(x) & (F.length(x) == n)), 0)
    cover = F.concat(F.lit(COVERS), F.col("w.cover_i").cast("string"), F.lit("-L.jpg"))
    none = F.lit(None)
    return works.select(
        F.concat(F.lit("openlibrary-"), _slug(F.col("w.key"))).alias("id"), F.col("w.title").alias("title"), none.cast("string").alias("subtitle"),
            F.coalesce("w.author_name", F.array().cast("array<string>")).alias("authors"),
        none.cast("string").alias("description"), none.cast("string").alias("publisher"), F.col("w.first_publish_year").cast("string").alias(
            "published_date"), none.cast("int").alias("page_count"), F.lit("en").alias("language"),
        none.cast("array<string>").alias("categories"), cover.alias("small_thumbnail"), cover.alias("thumbnail"), named_identifiers(isbn(10),
            isbn(13)).alias("identifiers"), F.lit("open-works").alias("feed"),
        F.col("w.readinglog_count").alias("readinglog_count"),
    )


def read_library_books(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, LIBRARY_BOOKS)


def metadata_from_volumes(df: DataFrame) -> DataFrame:
    """Metadata of volume-shaped rows with the isbn13 they were asked for; rows need a title and an author."""
    authors = F.filter("authors", lambda a: F.length(a) > 0)
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = df.where((F.length("title") > 0) & (F.size(authors) > 0))
    return rows.select(
        "isbn13", F.coalesce("id", F.concat(F.lit("isbn-"), F.col("isbn13"))).alias("source_book_id"), "title", authors.alias("authors"),
            text("description").alias("description"),
        F.coalesce("thumbnail", "small_thumbnail", F.lit("")).alias("cover_url"), text("publisher").alias("publisher"), F.coalesce("identifiers",
            F.array().cast(IDENTIFIERS)).alias("identifiers"), "published_date",
        F.lit("GoogleBooks").alias("provider"),
    )


def metadata_from_library(df: DataFrame) -> DataFrame:
    """Metadata of library rows (column isbn holds the ISBN-13 they were asked for); rows need a title and an author."""
    authors = F.filter(F.transform("authors", lambda a: F.coalesce(a["name"], F.lit(""))), lambda a: F.length(a) > 0)
    kind = lambda field, name: F.transform(F.filter(F.coalesce(F.col(f"identifiers.{field}"), F.array().cast("array<string>")),
        lambda x: ~is_blank(x)), lambda x: F.struct(F.lit(name).alias("type"), x.alias("identifier")))
    own = F.struct(F.lit("ISBN_13").alias("type"), F.col("isbn").alias("identifier"))
    given = F.concat(kind("isbn_10", "ISBN_10"), kind("isbn_13", "ISBN_13")).cast(IDENTIFIERS)
    ids = F.when(F.exists(given, lambda x: (x["type"] == "ISBN_13") & (x["identifier"] == F.col("isbn"))), given).otherwise(F.array_append(given, own))
    return df.where((F.length("title") > 0) & (F.size(authors) > 0)).select(
        F.col("isbn").alias("isbn13"), F.concat(F.lit("openlibrary-"), _slug(F.coalesce("key", F.concat(F.lit("isbn-"), F.col("isbn"))))).alias(
            "source_book_id"), "title", authors.alias("authors"), F.lit("").alias("description"),
        F.coalesce("cover.large", "cover.medium", F.lit("")).alias("cover_url"), F.coalesce(F.get(F.filter("publishers", lambda p: p.isNotNull()), 0)[
            "name"], F.lit("")).alias("publisher"), ids.alias("identifiers"),
        F.col("publish_date").alias("published_date"), F.lit("OpenLibrary").alias("provider"),
    )
