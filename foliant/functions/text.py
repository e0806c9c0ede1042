"""Keys made from titles, authors and queries."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def comparable(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]", "")


def decomposed(c: Column) -> Column:
    """NFKD without combining marks U+0300 to U+036F, by an Arrow UDF: Spark has no such function. A text of ASCII only is its own and isn't sent to Python: its row has a null there."""
    beyond = c.rlike(r"[^\x00-\x7F]")
    return F.coalesce(F.pandas_udf(_without_marks, "string")(F.when(beyond, c)), c)


def _without_marks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not 0x300 <= ord(c) <= 0x36F))


def search_text(c: Column) -> Column:
    """Decomposed, marks dropped, other characters than ASCII letters and digits one space, trimmed, lower case.

    For a literal or ASCII-only column use ascii_search_text, which stays in the JVM.
    """
    return ascii_search_text(decomposed(c))


def ascii_search_text(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, "[^a-zA-Z0-9]+", " ")))


def search_literal(query: str) -> str:
    """search_text of one Python string."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", query) if not 0x300 <= ord(c) <= 0x36F)
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).lower().split())


def author_key(c: Column) -> Column:
    return F.translate(F.trim(c), "_", " ")
