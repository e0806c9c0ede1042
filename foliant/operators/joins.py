"""Joins on identities, priorities and memberships."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import explode_identifiers, is_blank, normalize_identifier, normalize_isbn
from ..functions.text import author_key, comparable
from ..shared import saved, work_dir


def _entry_keys(df: DataFrame, id_column: str) -> DataFrame:
    """(id, user, kind, value) for each identity key that isn't blank."""
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    source, book = F.trim("source"), F.trim("source_book_id")
    pair = F.when(~is_blank(source) & ~is_blank(book), F.to_json(F.array(source, book)))
    keys = F.array(key("isbn13", normalize_identifier(F.col("isbn13"))), key("isbn10", normalize_identifier(F.col("isbn10"))), key("source", pair))
    return df.select(F.col(id_column).alias("__id"), F.col("user_id").alias("__user"),
        F.explode(F.filter(keys, lambda k: k["value"].isNotNull())).alias("k")).select("__id", "__user", "k.kind", "k.value")


def match_entries(left: DataFrame, entries: DataFrame, left_id: str = "request_id") -> DataFrame:
    """left with match_id: the least entry of the same user that shares isbn13, isbn10 or (source, source book id); null if there is none.

    Keys are exploded into rows for one hash join; a join on an OR would compare all rows of a user.
    """
    pairs = _entry_keys(left, left_id).alias("l").join(_entry_keys(entries, "entry_id").alias("r"), ["__user", "kind", "value"])
    best = pairs.groupBy(F.col("l.__id").alias(left_id)).agg(F.min("r.__id").alias("match_id"))
    return left.join(best, left_id, "left")


def update_conflicts(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (with entry_id) whose match is another entry."""
    return match_entries(requests, entries).where("match_id <> entry_id")


METADATA = ("isbn13", "source_book_id", "title", "authors", "description", "cover_url", "publisher", "identifiers", "published_date", "provider")


def resolve_metadata(isbns: DataFrame, cache: DataFrame, library: DataFrame, volumes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved, new_rows, unresolved) for distinct isbn13: cached first, then the library feed, then the volume feed. Of several rows of a source, the least counts.

    Sources are grouped and joined one by one, as Spark 4.1 may group a union of joins where its sides lie, which adaptive execution then changes: rows of an ISBN don't meet
    there. The joins are merges, as files of metadata are much smaller than their rows in a broadcast.
    """
    found, places = isbns.select("isbn13").distinct(), []
    for rank, df in enumerate((cache, library, volumes)):
        one = df.select(*METADATA, F.col("cover_override_url") if "cover_override_url" in df.columns else F.lit(None).cast("string").alias("cover_override_url"), F.lit(rank).alias("__rank"))
        row = F.struct(*[c for c in one.columns if c != "isbn13"])
        best = one.where("isbn13 is not null").groupBy("isbn13").agg(F.min_by(row, F.struct("source_book_id", "title")).alias(f"__m{rank}"))
        found = found.join(best.hint("merge"), "isbn13", "left")
        places.append(f"__m{rank}")
    found = found.select("isbn13", F.coalesce(*places).alias("m"))
    resolved = found.where("m is not null").select("isbn13", "m.*")
    return resolved.drop("__rank"), resolved.where("__rank > 0").drop("__rank"), found.where("m is null").select("isbn13")


class MetadataCache:
    """Metadata by isbn13 in a table whose files are buckets of ISBNs, so that a join on isbn13 doesn't shuffle it. What an import finds is saved, also if its rows are rejected later."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 16):
        self.spark, self.name, self.buckets = spark, name or f"book_metadata_{uuid.uuid4().hex}", buckets
        self.columns = [*METADATA, "cover_override_url"]

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        """The cache; it must have been saved to once."""
        return self.spark.table(self.name)

    def save(self, rows: DataFrame) -> None:
        """Adds the rows whose isbn13 isn't there, one for each. Saving again adds nothing."""
        override = F.col("cover_override_url") if "cover_override_url" in rows.columns else F.lit(None).cast("string").alias("cover_override_url")
        rows = rows.select(*METADATA, override).where("isbn13 is not null")
        if self.exists():
            rows = rows.join(self.read().select("isbn13").hint("merge"), "isbn13", "left_anti")
        rest = F.struct(*[c for c in self.columns if c != "isbn13"])
        one = rows.groupBy("isbn13").agg(F.min_by(rest, F.struct("source_book_id", "title")).alias("m")).select("isbn13", "m.*")
        one = saved(one.select(*self.columns), "new-metadata")  # the cache can't be read while it is written
        writer = one.repartition(self.buckets, "isbn13").write.mode("append").bucketBy(self.buckets, "isbn13").sortBy("isbn13").format("parquet")
        (writer if self.exists() else writer.option("path", work_dir(self.spark, "book-metadata"))).saveAsTable(self.name)


def expand_by_author(fits: DataFrame, books: DataFrame, group: str, book_id: str, author: str = "author") -> DataFrame:
    """(book, group) for the books whose author (trimmed, without case) wrote one that fits the group; blank authors match nothing."""
    named = books.select(book_id, F.lower(F.trim(author)).alias("__author"))
    authors = fits.join(named, book_id).where("__author <> ''").select(group, "__author").distinct()
    return named.join(authors, "__author").select(book_id, group)


def fits_by_isbn(books: DataFrame, volumes: DataFrame, group: str, book_id: str) -> DataFrame:
    """(book, group) for the books (column isbns) with an ISBN among the identifiers of the group's volumes."""
    feed = explode_identifiers(volumes).select(group, F.upper("identifier").alias("__isbn")).distinct()
    own = books.select(book_id, F.explode("isbns").alias("x")).where(~is_blank(F.col("x.identifier"))).select(book_id,
        F.upper(normalize_isbn(F.col("x.identifier"))).alias("__isbn"))
    return own.join(feed, "__isbn").select(book_id, group)


def split_conflicts(rows: DataFrame, published_other: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is already published in the other section, published rows that carry over)."""
    there, here = published_other.select(*keys).distinct(), rows.select(*keys).distinct()
    return rows.join(there, keys, "left_semi"), published_other.join(here, keys, "left_anti")


def contains_either(a: Column, b: Column) -> Column:
    """Whether one comparable text holds the other; an empty one is held by all."""
    return a.contains(b) | b.contains(a)


def verified(metadata: Column, title: Column, author: Column) -> tuple[Column, Column]:
    """Whether the title, and any author, of a struct of metadata agrees with what a row says."""
    same_author = F.exists(metadata["authors"], lambda a: contains_either(comparable(a), comparable(author)))
    return contains_either(comparable(metadata["title"]), comparable(title)), same_author


def user_profiles(users: DataFrame, identities: DataFrame) -> DataFrame:
    return users.join(identities.select(F.col("id").alias("identity_user_id"), "user_name", "email"), "identity_user_id")


def batches_with_books(batches: DataFrame, books: DataFrame) -> DataFrame:
    return batches.join(books, "batch_id", "left")


def goal_status(goals: DataFrame, completed: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """user_id, year, target_book_count (0 without a goal) and completed_book_count (0 without books) for keys, or for all users and years of either side."""
    g, c = goals.select("user_id", "year", "target_book_count"), completed.select("user_id", "year", "completed_book_count")
    both = g.join(c, ["user_id", "year"], "full") if keys is None else keys.select("user_id", "year").distinct().join(g, ["user_id", "year"],
        "left").join(c, ["user_id", "year"], "left")
    return both.select("user_id", "year", F.coalesce("target_book_count", F.lit(0)).alias("target_book_count"), F.coalesce("completed_book_count",
        F.lit(0)).alias("completed_book_count"))


def genre_listing(curated: DataFrame, merged: DataFrame, genre: str = "genre_slug", always_curated: tuple[str, ...] = ("horror",)) -> DataFrame:
    """Curated rows where a genre has any, or is always curated; merged feed rows for the others. Both need the same columns."""
    has = curated.select(F.lower(genre).alias("__g")).distinct()
    rest = merged.withColumn("__g", F.lower(genre)).where(~F.col("__g").isin(*always_curated)).join(has, "__g", "left_anti").drop("__g")
    return curated.unionByName(rest)


def enrich_authors(df: DataFrame, summaries: DataFrame, author: str = "author") -> DataFrame:
    """df with the summary of its author by key; null where there is none."""
    key = "__author"
    right = summaries.withColumn(key, author_key(F.col("title"))).groupBy(key).agg(F.min(F.struct("extract", "page", "thumbnail")).alias("summary"))
    return df.withColumn(key, author_key(F.col(author))).join(right, key, "left").drop(key)


def erase_users(tables: dict[str, DataFrame], user_ids: DataFrame) -> dict[str, DataFrame]:
    """Entries, goals, profiles and identities without the users; users whose identity is missing keep everything."""
    users = tables["users"].join(user_ids.select("user_id").distinct(), "user_id", "left_semi")
    gone = users.join(tables["identities"].select(F.col("id").alias("identity_user_id")), "identity_user_id", "left_semi").select("user_id", "identity_user_id")
    ids = gone.select("user_id")
    out = {name: tables[name].join(ids, "user_id", "left_anti") for name in ("book_entries", "reading_goals", "users") if name in tables}
    return out | {"identities": tables["identities"].join(gone.select(F.col("identity_user_id").alias("id")), "id", "left_anti")}


def taken_emails(candidates: DataFrame, identities: DataFrame, email: str = "email") -> DataFrame:
    """candidates with `taken`: the e-mail is in use (without case) or blank."""
    used = identities.where("email is not null").select(F.lower("email").alias("__email")).distinct().withColumn("__used", F.lit(True))
    return candidates.withColumn("__email", F.lower(email)).join(used, "__email", "left").withColumn("taken", is_blank(F.col(email))
        | F.coalesce("__used", F.lit(False))).drop("__email", "__used")


def apply_cover_overrides(draft: DataFrame, metadata: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(draft, metadata) after overrides (request_id, batch_id, isbn13, url) in order; a url is taken as it is, a blank one takes an override away and brings the base cover back.

    An override counts only where its draft holds the book and metadata knows it. It changes the book in that draft, and the metadata for whoever imports it next.
    """
    books = draft.select("batch_id", "isbn13").distinct()
    good = overrides.join(books, ["batch_id", "isbn13"], "left_semi").join(metadata.select("isbn13").distinct(), "isbn13", "left_semi")
    url = F.when(~is_blank(F.col("url")), F.col("url"))
    last = lambda *keys: good.groupBy(*keys).agg(F.max_by(F.struct(url.alias("url")), "request_id").alias("__new"))
    meta = metadata.join(last("isbn13"), "isbn13", "left")
    meta = meta.withColumn("cover_override_url", F.when(F.col("__new").isNotNull(), F.col("__new.url")).otherwise(F.col("cover_override_url"))).drop("__new")
    base = metadata.groupBy("isbn13").agg(F.min("cover_url").alias("__base"))
    changed = draft.join(last("batch_id", "isbn13").join(base, "isbn13", "left"), ["batch_id", "isbn13"], "left")
    cover = F.when(F.col("__new").isNotNull(), F.coalesce("__new.url", "__base")).otherwise(F.col("cover_url"))
    return changed.withColumn("cover_url", cover).select(*draft.columns), meta.select(*metadata.columns)
