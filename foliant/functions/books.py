"""Genre rules, covers and release dates."""

from __future__ import annotations

import re._parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identifiers import is_blank

# The genre rules.
GENRE_RULES = {
    "horror": r"\b(horror|haunted|haunting|ghosts?|vampires?|demons?|demonic|occult|possess(?:ed|ion)|supernatural|gothic|undead)\b",
    "fantasy": r"\b(fantasy|litrpg|dungeons?|dragons?|magic|magical|mages?|wizards?|witches?|sorcer(?:er|ess|y)|fae|fairy|fairies|elves?|kingdoms?|quests?|enchanted|mythic(?:al)?|gods?|goddesses?)\b",
    "science-fiction": r"\b(science fiction|sci-fi|space(?:ship|craft)?|aliens?|galactic|dystopi(?:a|an)|time travel|androids?|robots?|extraterrestrial|futuristic)\b",
    "mystery": r"\b(mystery|mysteries|detectives?|whodunit|murder investigation|investigates?|disappearance|missing person|unsolved)\b",
    "thriller": r"\b(thriller|conspirac(?:y|ies)|assassins?|espionage|spies?|kidnapped|hostages?|serial killer|race against time)\b",
    "romance": r"\b(romance|romantic|love story|falls? in love|lovers?|soulmates?|wedding|marriage of convenience)\b",
    "historical-fiction": r"\b(historical fiction|world war|civil war|victorian|regency|renaissance|medieval|nineteenth century|eighteenth century)\b",
    "literary-fiction": r"\b(literary fiction|family saga|intergenerational|coming to terms|examines? (?:grief|identity|family)|portrait of a family)\b",
    "biography-memoir": r"\b(biograph(?:y|ical)|memoirs?|autobiograph(?:y|ical)|life of|personal history|recounts? (?:her|his|their) life)\b",
    "history": r"\b(history of|historical account|civilization|ancient world|world war|civil war|empire|revolution|presidency|twentieth century)\b",
    "young-adult": r"\b(young adult|teenagers?|high school|coming[- ]of[- ]age|sixteen-year-old|seventeen-year-old|eighteen-year-old)\b",
}
def genres_of(title: Column, description: Column, rules: dict[str, str] = GENRE_RULES) -> Column:
    """The genres whose pattern is found in title and description; each pattern is a literal, compiled once a task."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))
    return F.filter(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(g)) for g, p in rules.items()]), lambda x: x.isNotNull())


def classify(df: DataFrame, rules: dict[str, str] = GENRE_RULES) -> DataFrame:
    """A row for each book and genre."""
    return df.withColumn("genre_slug", F.explode(genres_of(F.col("title"), F.col("description"), rules)))


def terms_of(pattern: str) -> list[str]:
    """All texts that a rule's pattern stands for: words, alternatives, sets and optional parts between word boundaries."""

    def spelled(parts) -> list[str]:
        out = [""]
        for kind, value in parts:
            kind = str(kind)
            if kind == "LITERAL":
                some = [chr(value)]
            elif kind == "IN":
                some = [chr(v) for _, v in value]
            elif kind == "BRANCH":
                some = [x for branch in value[1] for x in spelled(branch)]
            elif kind == "SUBPATTERN":
                some = spelled(value[3])
            elif kind == "MAX_REPEAT" and value[:2] == (0, 1):
                some = ["", *spelled(value[2])]
            elif kind == "AT":
                some = [""]
            else:
                raise ValueError(f"a rule can't have {kind}")
            out = [a + b for a in out for b in some]
        return out

    return spelled(sre.parse(pattern))


#: What words are made of.
_WORD = r"\p{L}\p{Nd}\p{Mn}_"
#: Rules that are sent to all tasks at most; more are joined by shuffle.
MOST_SENT = 100_000


def classify_by_terms(df: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """keys and genre_slug, once each, for the books whose title and description hold a term of a rule (genre_slug, term), whatever their case (A to Z), between word boundaries.

    Any number of rules takes one pass: a text is cut into its words and what stands between them, each word meets the terms that begin with it, and the term is compared with the
    words that follow. A term begins and ends with a word; what stands between its words must be the same in the text. Blank terms and null texts match nothing.
    """
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pieces = lambda c: F.split(low(c), f"(?<=[{_WORD}])(?=[^{_WORD}])|(?<=[^{_WORD}])(?=[{_WORD}])")
    terms = rules.select("genre_slug", low(F.col("term")).alias("term"), pieces(F.col("term")).alias("p")).where(F.col("term").rlike(f"^[{_WORD}]")).distinct()
    terms = terms.select("genre_slug", "term", F.size("p").alias("n"), F.col("p")[0].alias("word"))
    size, longest = terms.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(1))).first()
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    words = df.select(*keys, pieces(text).alias("p")).select(*keys, "p", F.posexplode("p").alias("at", "word")).where(F.col("word").rlike(f"^[{_WORD}]"))
    words = words.select(*keys, "word", F.slice("p", F.col("at") + 1, F.lit(longest)).alias("rest")).distinct()
    found = words.join(F.broadcast(terms) if size <= MOST_SENT else terms, "word")
    return found.where(F.array_join(F.slice("rest", F.lit(1), F.col("n")), "") == F.col("term")).select(*keys, "genre_slug").distinct()


def resolved_cover(override: Column, base: Column) -> Column:
    return F.coalesce(override, base)


def has_cover(thumbnail: Column) -> Column:
    return ~is_blank(thumbnail)


_FORMATS = ("yyyy-MM-dd", "yyyy-MM", "MMMM d, yyyy", "MMM d, yyyy", "MMMM yyyy", "MMM yyyy", "M/d/yyyy", "yyyy/M/d", "d MMMM yyyy")


def release_date(section: Column, published: Column) -> Column:
    """For the section upcoming the published date, if it is more than a year; else null."""
    parsed = F.coalesce(*[F.call_function("try_to_date", F.trim(published), F.lit(f)) for f in _FORMATS])
    return F.when(section == "upcoming", parsed)


def valid_cover_url(c: Column) -> Column:
    """https, absolute, at most 2,000 characters, no user info."""
    url = F.trim(c)
    part = lambda name: F.try_parse_url(url, F.lit(name))
    return F.coalesce(~is_blank(c) & (F.length(c) <= 2000) & (F.lower(part("PROTOCOL")) == "https") & part("HOST").isNotNull()
        & part("USERINFO").isNull(), F.lit(False))
