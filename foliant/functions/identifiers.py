"""Identifiers of books, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.regexp_replace(c, r"\s+", "") == "", F.lit(True))


def normalize_isbn(c: Column) -> Column:
    """Without hyphens and spaces."""
    return F.translate(c, "- ", "")


def normalize_identifier(c: Column) -> Column:
    """As normalize_isbn, in upper case; blank gives null."""
    return F.when(~is_blank(c), F.upper(normalize_isbn(c)))


def _weighted(digits: Column, n: int, weight) -> Column:
    """Sum of the first n digits, each times weight(position)."""
    total = F.lit(0)
    for i in range(n):
        total = total + F.substring(digits, i + 1, 1).try_cast("int") * weight(i)
    return total


def let(value: Column, body) -> Column:
    """body(value), with value computed once: as a column it would be repeated wherever body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ean_check_digit(digits: Column) -> Column:
    """The 13th digit for 12 digits."""
    return F.pmod(10 - F.pmod(_weighted(digits, 12, lambda i: 3 if i % 2 else 1), F.lit(10)), F.lit(10)).cast("string")


def _canonical(c: Column) -> Column:
    """struct(isbn13, is_valid) of a normalised identifier."""
    is13 = c.rlike("^[0-9]{13}$") & (F.pmod(_weighted(c, 13, lambda i: 3 if i % 2 else 1), F.lit(10)) == 0)
    last = F.when(F.substring(c, 10, 1) == "X", F.lit(10)).otherwise(F.substring(c, 10, 1).try_cast("int"))
    is10 = c.rlike("^[0-9]{9}[0-9X]$") & (F.pmod(_weighted(c, 9, lambda i: 10 - i) + last, F.lit(11)) == 0)
    longer = let(F.concat(F.lit("978"), F.substring(c, 1, 9)), lambda t: F.concat(t, ean_check_digit(t)))
    pair = lambda x, ok: F.struct(x.alias("isbn13"), F.lit(ok).alias("is_valid"))
    return F.when(F.coalesce(is13, F.lit(False)), pair(c, True)).when(F.coalesce(is10, F.lit(False)), pair(longer, True)).otherwise(pair(c, False))


def with_isbn13(df: DataFrame, column: str) -> DataFrame:
    """Adds isbn13 and is_valid: a valid ISBN-13 stays, a valid ISBN-10 is rewritten with prefix 978, all else is kept as normalised and invalid."""
    found = let(F.upper(normalize_isbn(F.coalesce(F.col(column), F.lit("")))), _canonical)
    return df.withColumn("__isbn", found).withColumns({"isbn13": F.col("__isbn.isbn13"), "is_valid": F.col("__isbn.is_valid")}).drop("__isbn")


def isbn_query(c: Column) -> Column:
    """The query as an ISBN if it has the shape of one (no check digit is looked at), else null."""
    q = F.upper(F.regexp_replace(c, r"[\s-]", ""))
    return F.when(q.rlike(r"^(?:[0-9]{9}[0-9X]|97[89][0-9]{10})$"), q)


def identifier_of(identifiers: Column, kind: str) -> Column:
    """The first identifier of a type, whatever its case; null if there is none."""
    return F.get(F.filter(identifiers, lambda x: F.upper(x["type"]) == kind.upper()), 0)["identifier"]


def named_identifiers(isbn10: Column, isbn13: Column) -> Column:
    """ISBN_10, then ISBN_13, blank ones left out."""
    both = F.array(F.struct(F.lit("ISBN_10").alias("type"), isbn10.alias("identifier")), F.struct(F.lit("ISBN_13").alias("type"), isbn13.alias("identifier")))
    return F.filter(both, lambda x: ~is_blank(x["identifier"]))


def book_identity(identifiers: Column, title: Column, authors: Column) -> Column:
    """The first normalised identifier, else title|first author; upper case, as identities are compared without case."""
    first = F.get(F.filter(identifiers, lambda x: ~is_blank(x["identifier"])), 0)["identifier"]
    by_name = F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(F.get(authors, 0), F.lit("")))
    return F.upper(F.coalesce(normalize_isbn(first), by_name))


def fallback_id(title: Column, author: Column) -> Column:
    """title-author in lower case with one hyphen for each run of other characters."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit("-"), F.coalesce(author, F.lit("")))
    return F.regexp_replace(F.lower(F.trim(joined)), "[^a-z0-9]+", "-")


def explode_identifiers(df: DataFrame, column: str = "identifiers") -> DataFrame:
    """A row for each non-blank identifier of any type, normalised, as `identifier`."""
    each = F.explode(F.filter(F.col(column), lambda x: ~is_blank(x["identifier"])))
    return df.withColumn("__id", each).withColumn("identifier", normalize_isbn(F.col("__id.identifier"))).drop("__id")
