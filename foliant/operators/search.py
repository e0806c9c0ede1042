"""Field-scoped search, routing and ranking over a table of volumes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import identifier_of, is_blank, normalize_isbn
from ..functions.text import ascii_search_text, decomposed, search_literal, search_text
from ..shared import saved
from .windows import keep_first

PAGE = 40


def _has_terms(field: Column, text: str) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.lower(field).contains(t), F.lit(False)) for t in text.lower().split()])


def search_fields() -> dict[str, Column]:
    """What each kind of search looks through."""
    authors, subjects = (F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ") for c in ("authors", "categories"))
    return {"text": F.concat_ws(" ", "title", "description", authors, subjects), "intitle": F.col("title"), "inauthor": authors, "subject": subjects}


def field_search(df: DataFrame, text: str | None = None, intitle: str | None = None, inauthor: str | None = None, subject: str | None = None,
    isbn: str | None = None, limit: bool = True) -> DataFrame:
    """Volumes in which every term of each given field occurs; at most 1 for an ISBN, else PAGE (the feature's page size), by id."""
    fields = [(q, search_fields()[name]) for name, q in (("text", text), ("intitle", intitle), ("inauthor", inauthor), ("subject", subject))]
    given = [_has_terms(c, q) for q, c in fields if q and q.strip()]
    if isbn and isbn.strip():
        wanted = re.sub(r"[\s-]", "", isbn).upper()
        given.append(F.exists("identifiers", lambda x: F.upper(normalize_isbn(x["identifier"])) == wanted))
    if not given:
        raise ValueError("a search needs a query")
    found = df.where(reduce(lambda a, b: a & b, given))
    return found.orderBy("id").limit(1 if isbn and isbn.strip() else PAGE) if limit else found


def isbn_of(query: str) -> str | None:
    q = re.sub(r"[\s-]", "", query).upper()
    return q if re.fullmatch(r"[0-9]{9}[0-9X]|97[89][0-9]{10}", q) else None


def _some_has(term: str) -> Column:
    return F.exists("__a", lambda a: a.contains(term)).cast("int")


def rank_results(df: DataFrame, query: str, order: str = "pos", ascii_only: bool = False) -> DataFrame:
    """Volumes, one for each id, with `score`, best first and then by input position. ascii_only keeps the text rules in the JVM."""
    q = search_literal(query)
    terms = q.split()
    norm = ascii_search_text if ascii_only else search_text
    kept, _ = keep_first(df.where("id <> ''"), ["id"], [order])
    authors = F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")))
    if ascii_only:
        each = F.transform(authors, ascii_search_text)
    else:  # one Python call for all authors, which a control character keeps apart
        each = F.transform(F.split(decomposed(F.array_join(authors, "\u001f")), "\u001f"), ascii_search_text)
    rows = kept.withColumns({"__t": norm(F.coalesce("title", F.lit(""))), "__a": each})
    t, some = F.col("__t"), lambda f: F.exists("__a", f)
    score = F.when(t == q, 1000).when(t.startswith(q), 600).when(t.contains(q), 400).otherwise(0)
    score = score + F.when(some(lambda a: a == q), 900).when(some(lambda a: a.startswith(q)), 550).when(some(lambda a: a.contains(q)), 350).otherwise(0)
    if terms:
        in_title = reduce(lambda a, b: a + b, [t.contains(x).cast("int") for x in terms])
        in_author = reduce(lambda a, b: a + b, [_some_has(x) for x in terms])
        score = score + F.round(in_title / len(terms) * 200).cast("int") + F.round(in_author / len(terms) * 180).cast("int")
    score = score + F.when(F.coalesce(F.size("identifiers"), F.lit(0)) > 0, 20).otherwise(0) + F.when(~(is_blank(F.col("thumbnail"))
        & is_blank(F.col("small_thumbnail"))), 10).otherwise(0)
    return rows.withColumn("score", score).drop("__t", "__a").orderBy(F.desc("score"), order)


def search(df: DataFrame, query: str, search_type: str = "all", **options) -> DataFrame:
    """Routes a query: ISBN-shaped to identifiers, title or author to their field, else both, ranked."""
    isbn = isbn_of(query)
    if search_type == "isbn" or (search_type == "all" and isbn):
        return field_search(df, isbn=isbn or query)
    if search_type == "title":
        return field_search(df, intitle=query)
    if search_type == "author":
        return field_search(df, inauthor=query)
    return search_all(df, query, **options)


def search_all(df: DataFrame, query: str, limit: bool = True, **options) -> DataFrame:
    """Title results, then author results, the first of each id, ranked."""
    title, author = field_search(df, intitle=query, limit=limit), field_search(df, inauthor=query, limit=limit)
    both = title.withColumn("__src", F.lit(0)).unionByName(author.withColumn("__src", F.lit(1)))
    return rank_results(both.withColumn("pos", F.struct("__src", "id")).drop("__src"), query, "pos", **options)


def popular_by_subject(df: DataFrame, subject: str, n: int = 60, language: str = "en") -> DataFrame:
    """The n volumes of a subject and language with the most readers."""
    return df.where((F.col("language") == language) & F.exists("categories", lambda s: F.lower(s) == subject.lower())).orderBy(
        F.desc("readinglog_count"), "id").limit(n)


def volumes_to_entries(df: DataFrame, status: str) -> DataFrame:
    """Entry requests of search results, without progress."""
    return df.select(
        F.coalesce("feed", F.lit("volumes")).alias("source"), F.col("id").alias("source_book_id"), "title",
            F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", ").alias("authors"),
        F.coalesce("thumbnail", "small_thumbnail").alias("thumbnail_url"), identifier_of(F.col("identifiers"), "ISBN_10").alias("isbn10"),
            identifier_of(F.col("identifiers"), "ISBN_13").alias("isbn13"), F.lit(status).alias("status"),
        F.coalesce("page_count", F.lit(0)).alias("page_count"), F.lit(0).alias("pages_completed"), F.lit(0).alias("percent_completed"),
    )


def grams_of(text: Column, n: int = 3) -> Column:
    """The different n-grams of a text in lower case."""
    low = F.lower(text)
    return F.when(F.length(low) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def search_many(df: DataFrame, queries: DataFrame, page: int = PAGE) -> DataFrame:
    """search_all for a table of queries (query_id, query) in one plan: query_id, id, score, rank. Texts are ASCII, as in rank_results(ascii_only=True).

    Of each query the n-gram of its terms (three characters, or what a shorter term has) that stands in the fewest titles and authors is its key: volumes and queries meet by keys,
    and all terms are compared where they meet. Pages, deduplication and ranks are windows by query, whose groups are cut to a page on the way. A query without terms finds nothing.
    """
    fields = search_fields()
    asked = queries.select("query_id", F.lower("query").alias("low"), ascii_search_text(F.col("query")).alias("q")).withColumn("terms", F.filter(F.split(F.trim("low"), r"\s+"), lambda t: t != ""))
    asked = saved(asked.where(F.size("terms") > 0).withColumn("words", F.filter(F.split("q", " "), lambda t: t != "")), "asked")
    gram = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))
    keys = asked.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform("terms", gram)))).alias("gram"))
    sizes = [r["n"] for r in keys.select(F.length("gram").alias("n")).distinct().collect()]  # 1, 2 or 3
    bonus = F.when(F.coalesce(F.size("identifiers"), F.lit(0)) > 0, 20).otherwise(0) + F.when(~(is_blank(F.col("thumbnail")) & is_blank(F.col("small_thumbnail"))), 10).otherwise(0)
    books = saved(df.where("id <> ''").select("id", "title", "authors", bonus.alias("__bonus"), F.monotonically_increasing_id().alias("__row")), "searched")
    sides = F.array(*[F.struct(F.lit(i).alias("src"), F.lower(F.coalesce(fields[f], F.lit(""))).alias("text")) for i, f in enumerate(("intitle", "inauthor"))])
    texts = books.select("__row", "id", F.explode(sides).alias("s")).select("__row", "id", "s.*")
    own = F.flatten(F.array(*[grams_of(F.col("text"), n) for n in sizes])) if sizes else F.array().cast("array<string>")
    found = texts.select("__row", "id", "src", "text", F.explode(F.array_distinct(own)).alias("gram"))
    found = found.join(keys.select("gram").distinct(), "gram", "left_semi")
    often = found.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = keys.join(often, "gram", "left").groupBy("query_id").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    met = found.join(rarest, "gram").join(asked.select("query_id", "terms"), "query_id").where(F.forall("terms", lambda t: F.col("text").contains(t)))
    paged = met.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "src").orderBy("id", "__row"))).where(F.col("n") <= page)
    once = paged.groupBy("query_id", "id").agg(F.min(F.struct("src", "__row")).alias("m")).select("query_id", "id", "m.*")
    authors = F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: ascii_search_text(F.coalesce(a, F.lit(""))))
    found_books = books.drop("id").hint("merge")  # never a broadcast: files of books are much smaller than their rows
    rows = once.join(found_books, "__row").join(asked.select("query_id", "q", "words"), "query_id").withColumns({"__t": ascii_search_text(F.coalesce("title", F.lit(""))), "__a": authors})
    t, q, n = F.col("__t"), F.col("q"), F.greatest(F.size("words"), F.lit(1))
    some = lambda f: F.exists("__a", f)
    score = F.when(t == q, 1000).when(t.startswith(q), 600).when(t.contains(q), 400).otherwise(0)
    score = score + F.when(some(lambda a: a == q), 900).when(some(lambda a: a.startswith(q)), 550).when(some(lambda a: a.contains(q)), 350).otherwise(0)
    share = lambda has, most: F.round(F.size(F.filter("words", has)) / n * most).cast("int")
    score = score + share(lambda w: t.contains(w), 200) + share(lambda w: F.exists("__a", lambda a: a.contains(w)), 180) + F.col("__bonus")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "src", "id")  # two pages at most
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(best)).select("query_id", "id", "score", "rank")
