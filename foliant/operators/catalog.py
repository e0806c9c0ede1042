"""Catalogues: feed merging, import, versions and edits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.books import GENRE_RULES, genres_of, has_cover, release_date, resolved_cover
from ..functions.identifiers import book_identity, with_isbn13
from ..shared import saved
from ..sources.feeds import bestsellers_to_volumes
from .joins import expand_by_author, fits_by_isbn, resolve_metadata, split_conflicts, verified
from .windows import compact_positions, keep_first, ranked

SECTIONS = ("popular", "upcoming")
# The messages of reports; names in braces stand for a row's values.
MESSAGES = {
    "isbn": "Enter a valid ISBN-10 or ISBN-13.",
    "title": "Title is required.",
    "author": "Author is required.",
    "duplicate": "ISBN is duplicated; the first occurrence was kept.",
    "section": "This ISBN is already in the {section} section.",
    "metadata": "No book metadata was found for this ISBN.",
    "other title": "Resolved title '{title}' does not match the CSV.",
    "other authors": "Resolved authors '{authors}' do not match the CSV.",
    "no books": "The CSV contains no books.",
    "empty": "No valid rows were available to preview.",
    "no draft": "Draft catalog not found.",
    "in draft": "This ISBN is already in the draft.",
}
_VOLUME = ("id", "title", "authors", "description", "publisher", "language", "small_thumbnail", "thumbnail", "identifiers", "feed")


def combine_feeds(*feeds: DataFrame, group: list[str] | None = None, pos: str = "pos") -> DataFrame:
    """Feed responses one after another, the first row of each book identity kept (within each group, if given). Rows need their position in the response."""
    tagged = [df.withColumn("src_rank", F.lit(i)) for i, df in enumerate(feeds)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    identity = book_identity(F.col("identifiers"), F.col("title"), F.col("authors"))
    return keep_first(both.withColumn("identity", identity), [*(group or []), "identity"], ["src_rank", pos])[0]


def genre_merge(volumes: DataFrame, bestsellers: DataFrame, rules: dict[str, str] = GENRE_RULES) -> DataFrame:
    """Merged listing of all genres at once, with `rank` in each.

    volumes: volume shape with genre_slug and pos. bestsellers: bestseller rows with pos. A bestseller belongs to a genre if an ISBN of it is in the
    genre's feed, if the genre's rule is found in it, or if its author wrote one that does. Bestsellers come before feed rows when identities are
    compared; the order is: with cover, bestsellers, then as they came.
    """
    genres = volumes.select("genre_slug").distinct()
    best = bestsellers.withColumn("__key", F.col("pos"))
    by_isbn = fits_by_isbn(best, volumes, "genre_slug", "__key")
    by_rule = best.select("__key", F.explode(genres_of(F.col("title"), F.col("description"), rules)).alias("genre_slug")).join(genres, "genre_slug",
        "left_semi")
    fits = by_isbn.unionByName(by_rule.select("__key", "genre_slug")).distinct()
    expanded = expand_by_author(fits, best, "genre_slug", "__key")
    chosen = fits.unionByName(expanded).distinct().join(best, "__key")
    left = bestsellers_to_volumes(chosen).select("genre_slug", *_VOLUME, "pos")
    merged = combine_feeds(left, volumes.select("genre_slug", *_VOLUME, "pos"), group=["genre_slug"])
    return merge_order(merged)


def merge_order(df: DataFrame, group: str = "genre_slug") -> DataFrame:
    """Adds `rank` in each group: with cover first, bestsellers first, then by insertion."""
    return ranked(df, [group], [~has_cover(F.col("thumbnail")), "src_rank"], "pos")


def merge_totals(df: DataFrame, group: str = "genre_slug") -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("total"))


def list_sizes(books: DataFrame, name: str = "list_name") -> DataFrame:
    """Books of each list, and the largest index."""
    return books.groupBy(name).agg(F.count("*").alias("n"), (F.count("*") - 1).alias("max"))


def chunk_keys(df: DataFrame, column: str = "isbn13", n: int = 30) -> DataFrame:
    """Distinct ISBNs (without case) as requests of at most n keys: bucket, chunk, keys ("ISBN:a,ISBN:b") and their number.

    Numbers run within hash buckets, ten requests each on average, so there is no global sort; the last chunk of a bucket may be short.
    """
    keys = df.select(F.upper(column).alias("k")).where("k is not null").distinct()
    buckets = max(1, -(-keys.count() // (10 * n)))
    keys = keys.withColumn("bucket", F.conv(F.substring(F.md5("k"), 1, 8), 16, 10).cast("long") % buckets)
    numbered = keys.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("bucket").orderBy("k")) - 1) / n))
    return numbered.groupBy("bucket", "chunk").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("ISBN:"), "k"))), ",").alias("keys"),
        F.count("*").alias("n"))


def assemble_sections(batches: DataFrame, books: DataFrame) -> DataFrame:
    """For each batch (batch_id, genre_slug, published_at) both sections in order, each with its books by position; empty sections are kept."""
    both = batches.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("section_order"), F.lit(s).alias("section")) for i,
        s in enumerate(SECTIONS)]))).select("batch_id", "genre_slug", "published_at", "s.*")
    fields = [c for c in books.columns if c not in ("batch_id", "section", "position")]
    lists = books.groupBy("batch_id", "section").agg(F.sort_array(F.collect_list(F.struct("position", *fields))).alias("books"))
    return both.join(lists, ["batch_id", "section"], "left").withColumn("books", F.coalesce("books", F.array()))


def next_positions(books: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest position + 1 for each key; keys without books begin at 1 where they are joined with a default."""
    return books.groupBy(*keys).agg((F.coalesce(F.max("position"), F.lit(0)) + 1).alias("next_position"))


def publish(batches: DataFrame, requests: DataFrame) -> DataFrame:
    """Batches after publishing (genre_slug, batch_id, at): a draft or published batch becomes Published at the time, the slug's others that were published become
    Archived. Unknown and archived ids change nothing."""
    ok = requests.join(batches.where(F.col("status").isin("Draft", "Published")).select("batch_id", "genre_slug"), ["batch_id", "genre_slug"], "left_semi")
    new = ok.groupBy("genre_slug").agg(F.max_by(F.struct("batch_id", "at"), F.struct("at", "batch_id")).alias("p")).select("genre_slug",
        F.col("p.batch_id").alias("__id"), F.col("p.at").alias("__at"))
    both = batches.join(new, "genre_slug", "left")
    mine = F.coalesce(F.col("batch_id") == F.col("__id"), F.lit(False))
    status = F.when(mine, "Published").when(F.col("__id").isNotNull() & (F.col("status") == "Published"), "Archived").otherwise(F.col("status"))
    return both.withColumns({"status": status, "published_at": F.when(mine, F.col("__at")).otherwise(F.col("published_at"))}).drop("__id",
        "__at").select(*batches.columns)


def _said(broken: Column, stage: int, rule: int, field: str, message: str, value: Column | None = None) -> Column:
    """An error as a struct where a row is broken, else null. message: a key of MESSAGES; value: what stands for its name in braces."""
    before, _, behind = MESSAGES[message].partition("{")
    text = F.lit(before) if value is None else F.concat(F.lit(before), value, F.lit(behind.partition("}")[2]))
    return F.when(broken, F.struct(F.lit(stage).alias("stage"), F.lit(rule).alias("rule"), F.lit(field).alias("field"), text.alias("message")))


def _errors(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, "row", F.explode("__errors").alias("e")).select(*keys, "row", "e.*")


def _all_said(*errors: Column) -> Column:
    return F.filter(F.array(*errors), lambda x: x.isNotNull())


def checked_rows(rows: DataFrame, keys: list[str], save: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with isbn13 and position, errors) of parsed catalogue rows (keys, row, isbn, title, author): required fields, valid ISBN, first of each ISBN.

    Positions count the kept rows of a file in order and aren't closed up after later rejections. All rules are judged in one pass over the rows; with `save` what
    is judged is written, for callers that use both results.
    """
    blank = lambda c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    named = with_isbn13(rows, "isbn").withColumn("__good", F.col("is_valid") & ~blank("title") & ~blank("author"))
    ranked = named.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "isbn13", "__good").orderBy("row")))
    judged = ranked.withColumn("__errors", _all_said(
        _said(~F.col("is_valid"), 1, 1, "isbn", "isbn"), _said(blank("title"), 1, 2, "title", "title"), _said(blank("author"), 1, 3, "author", "author"),
        _said(F.col("__good") & (F.col("__n") > 1), 2, 1, "isbn", "duplicate"),
    ))
    judged = saved(judged, "checked-rows") if save else judged
    kept = judged.where(F.size("__errors") == 0).drop("__good", "__n", "__errors", "is_valid")
    return compact_positions(kept, keys, ["row"]), _errors(judged, keys)


def import_catalog(rows: DataFrame, cache: DataFrame, library: DataFrame, volumes: DataFrame, published: DataFrame, keep_existing: bool = False,
    file_errors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(draft, errors, new metadata) of many catalogue files at once.

    rows: file, slug, section, row, isbn, title, author. published: books (slug, section, isbn13 and book columns) of each slug's published batch. Published books of
    the slug's other section carry over; an imported ISBN that is among them is an error, and neither copy goes into the draft (keep_existing: the
    published one does). A file of whose rows none is valid stops there with an error, one of which none is imported has another; files without any row have
    theirs from read_catalog_csv (file_errors). Errors have stage, row and rule to order them by. Rows are judged once and written to the shared folder.
    """
    keys = ["file", "slug", "section"]
    good, errors = checked_rows(rows, keys, save=True)
    good = saved(good, "import-rows")
    if file_errors is not None:
        errors = errors.unionByName(file_errors.select(*keys, "row", F.lit(0).alias("stage"), F.lit(0).alias("rule"), "field", "message"))
    resolved, new_rows, _ = resolve_metadata(good, cache, library, volumes)
    other = F.when(F.col("section") == "popular", "upcoming").otherwise("popular")
    there = published.select("slug", F.col("section").alias("__other"), "isbn13").distinct().withColumn("__clash", F.lit(True))
    meta = resolved.select("isbn13", F.struct(*[c for c in resolved.columns if c != "isbn13"]).alias("m"))
    both = good.withColumn("__other", other).join(there, ["slug", "__other", "isbn13"], "left").join(meta, "isbn13", "left")
    known = F.col("m").isNotNull()
    title, author = verified(F.col("m"), F.col("title"), F.col("author"))
    judged = both.withColumn("__errors", _all_said(
        _said(F.col("__clash"), 3, 1, "isbn", "section", F.col("__other")), _said(~known, 4, 1, "isbn13", "metadata"),
        _said(known & ~title, 4, 2, "title", "other title", F.col("m.title")),
        _said(known & ~author, 4, 3, "author", "other authors", F.array_join("m.authors", ", ")),
    ))
    judged = saved(judged, "judged-rows")
    books = judged.where(F.size("__errors") == 0).select(
        *keys, "position", "isbn13", "m.source_book_id", "m.title", "m.authors", "m.description", resolved_cover(F.col("m.cover_override_url"),
            F.col("m.cover_url")).alias("cover_url"), "m.publisher", "m.identifiers", "m.published_date",
        release_date(F.col("section"), F.col("m.published_date")).alias("release_date"),
    )
    filled = books.select(*keys).distinct()
    # Of each file that had rows: whether any was valid, and whether any was imported.
    state = rows.select(*keys, F.lit(0).alias("__state")).unionByName(good.select(*keys, F.lit(1).alias("__state"))).unionByName(filled.select(*keys, F.lit(2).alias("__state")))
    state = state.groupBy(*keys).agg(F.max("__state").alias("__state")).where("__state < 2")
    none, message = F.col("__state") == 0, lambda m: F.lit(MESSAGES[m])
    empty = state.select(*keys, F.lit(1).alias("row"), F.when(none, 2).otherwise(5).alias("stage"), F.when(none, 2).otherwise(1).alias("rule"), F.lit("file").alias("field"),
        F.when(none, message("no books")).otherwise(message("empty")).alias("message"))
    errors = errors.unionByName(_errors(judged, keys)).unionByName(empty)
    carried = filled.withColumn("section", other).join(published, ["slug", "section"])
    if not keep_existing:
        carried = split_conflicts(good.withColumn("section", other), carried, ["file", "slug", "section", "isbn13"])[1]
    return books.unionByName(carried.select(*books.columns)), errors, new_rows


def add_books(draft: DataFrame, requests: DataFrame, cache: DataFrame, library: DataFrame, volumes: DataFrame, batches: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(draft, errors): requests (request_id, batch_id, section, isbn) in order; rejected are invalid ISBNs, unknown drafts, ISBNs in the draft and ISBNs without metadata.

    batches (batch_id, status) says which drafts there are, also those without books; without it they are those of the books. Of several requests for a book the first adds
    it; where there is no metadata, each says so.
    """
    named = with_isbn13(requests, "isbn")
    drafts = draft.select("batch_id") if batches is None else batches.where("status = 'Draft'").select("batch_id")
    resolved, _, _ = resolve_metadata(named.where("is_valid"), cache, library, volumes)
    meta = resolved.withColumn("cover_url", resolved_cover(F.col("cover_override_url"), F.col("cover_url"))).drop("cover_override_url", "provider")
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    seen = Window.partitionBy("batch_id", "isbn13", "is_valid").orderBy("request_id")
    judged = named.join(flag(drafts, "__draft"), "batch_id", "left").join(flag(draft.select("batch_id", "isbn13"), "__there"), ["batch_id", "isbn13"], "left")
    judged = judged.join(meta.select("isbn13", F.struct(*[c for c in meta.columns if c != "isbn13"]).alias("m")), "isbn13", "left").withColumn("__n", F.row_number().over(seen))
    known = F.col("m").isNotNull()
    error = F.when(~F.col("is_valid"), MESSAGES["isbn"]).when(F.col("__draft").isNull(), MESSAGES["no draft"])
    error = error.when(F.col("__there") | known & (F.col("__n") > 1), MESSAGES["in draft"]).when(~known, MESSAGES["metadata"])
    judged = saved(judged.withColumn("message", error), "added-books")
    start = next_positions(draft, ["batch_id", "section"])
    seq = Window.partitionBy("batch_id", "section").orderBy("request_id")
    added = judged.where("message is null").select("request_id", "batch_id", "section", "isbn13", "m.*").withColumn("n", F.row_number().over(seq))
    added = added.join(start, ["batch_id", "section"], "left").withColumns({"position": (F.coalesce("next_position", F.lit(1)) + F.col("n") - 1).cast("int"),
        "release_date": release_date(F.col("section"), F.col("published_date"))})
    added = added.select(*[F.col(c) if c in added.columns else F.lit(None).alias(c) for c in draft.columns])
    return draft.unionByName(added), judged.where("message is not null").select("request_id", "message")


def remove_books(draft: DataFrame, requests: DataFrame) -> DataFrame:
    """The draft without (batch_id, isbn13) pairs; positions of the sections they leave are closed up. One join and one window over the draft."""
    gone = requests.select("batch_id", "isbn13").distinct().withColumn("__gone", F.lit(True))
    rows = draft.join(gone, ["batch_id", "isbn13"], "left").withColumn("__gone", F.coalesce("__gone", F.lit(False)))
    section = Window.partitionBy("batch_id", "section")
    rows = rows.withColumns({"__n": F.row_number().over(section.orderBy("__gone", "position", "isbn13")), "__t": F.max("__gone").over(section)})
    return rows.where(~F.col("__gone")).withColumn("position", F.when(F.col("__t"), F.col("__n")).otherwise(F.col("position")).cast("int")).select(*draft.columns)
