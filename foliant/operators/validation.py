"""Row rules, business rules and constraint checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import is_blank
from ..functions.shelves import canonical_status


@dataclass(frozen=True)
class Rule:
    """What a field must be: required (not blank), within lengths, within a range, an e-mail."""

    field: str
    required: bool = False
    most: int | None = None
    least: int | None = None
    low: int | None = None
    high: int | None = None
    email: bool = False

    def errors(self) -> list[Column]:
        """A struct(field, message) for each broken part, else null. Only `required` looks at nulls."""
        c = F.col(self.field)
        say = lambda broken, message: F.when(broken, F.struct(F.lit(self.field).alias("field"), F.lit(message).alias("message")))
        out = []
        if self.required:
            out.append(say(is_blank(c.cast("string")), f"{self.field} is required."))
        if self.most is not None:
            out.append(say(F.length(c) > self.most, f"{self.field} must have at most {self.most} characters."))
        if self.least is not None:
            out.append(say(F.length(c) < self.least, f"{self.field} must have at least {self.least} characters."))
        if self.low is not None or self.high is not None:
            out.append(say((c < self.low) | (c > self.high), f"{self.field} must be between {self.low} and {self.high}."))
        if self.email:
            out.append(say(~c.rlike("^[^@\r\n]+@[^@\r\n]+$"), f"{self.field} is not a valid e-mail address."))
        return out


_INT = 2**31 - 1
ENTRY_RULES = [
    Rule("source", most=100), Rule("source_book_id", most=200), Rule("title", required=True, most=500), Rule("authors", most=1000),
        Rule("thumbnail_url", most=2000), Rule("isbn10", most=20), Rule("isbn13", most=20),
    Rule("status", required=True, most=50), Rule("page_count", low=0, high=_INT), Rule("pages_completed", low=0, high=_INT), Rule("percent_completed",
        low=0, high=100),
]
REGISTRATION_RULES = [
    Rule("username", required=True, most=64, least=2), Rule("first_name", required=True, most=100), Rule("last_name", required=True, most=100),
        Rule("email", required=True, most=254, email=True), Rule("password", required=True, most=128, least=8),
]
LOGIN_RULES = [Rule("email", required=True, most=254, email=True), Rule("password", required=True, most=128)]


def goal_rules(this_year: int) -> list[Rule]:
    return [Rule("target_book_count", low=1, high=1000), Rule("year", low=2000, high=this_year + 1)]


def validate(df: DataFrame, rules: list[Rule], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, errors with keys, rule number, field and message)."""
    broken = F.filter(F.array(*[e for r in rules for e in r.errors()]), lambda x: x.isNotNull())
    rows = df.withColumn("__errors", broken)
    errors = rows.select(*keys, F.posexplode("__errors").alias("rule", "e")).select(*keys, "rule", "e.field", "e.message")
    return rows.where(F.size("__errors") == 0).drop("__errors"), errors


def entry_error(df: DataFrame) -> Column:
    """The first business rule that an entry request breaks, or null."""
    named = ~is_blank(F.col("isbn10")) | ~is_blank(F.col("isbn13")) | (~is_blank(F.col("source")) & ~is_blank(F.col("source_book_id")))
    return (
        F.when(canonical_status(F.col("status")).isNull(), "The selected reading status is not valid.")
        .when((F.col("page_count") > 0) & (F.col("pages_completed") > F.col("page_count")), "Pages completed cannot exceed the book's page count.")
        .when(~named, "An ISBN or source identifier is required.")
    )


def validate_entries(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with `message`)."""
    rows = df.withColumn("message", entry_error(df))
    return rows.where("message is null").drop("message"), rows.where("message is not null")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


# Uniqueness and references that the tables must keep.
UNIQUE = {
    "book_entries": [["user_id", "source", "source_book_id"]], "reading_goals": [["user_id", "year"]],
        "catalog_books": [["batch_id", "section", "position"], ["batch_id", "isbn13"]], "book_metadata": [["isbn13"]],
}
REFERENCES = [("users", "identity_user_id", "identities", "id"), ("catalog_books", "batch_id", "catalog_batches", "batch_id"),
    ("reading_goals", "user_id", "users", "user_id"), ("book_entries", "user_id", "users", "user_id")]


def audit_constraints(tables: dict[str, DataFrame], unique: dict[str, list[list[str]]] = UNIQUE,
    references: list[tuple[str, str, str, str]] = REFERENCES) -> DataFrame:
    """A row for each constraint: table_name, constraint_name, violations (keys more than once, rows without their parent). Keys with a null aren't compared.

    Each table is read once: a row is stacked as the keys that it has in each constraint, as child or as parent, and all are counted in one aggregation.
    """
    rules = [(n, k, None) for n, many in unique.items() for k in many if n in tables]
    rules += [(n, [k], (parent, pk)) for n, k, parent, pk in references if n in tables and parent in tables]
    text = lambda keys: F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]), F.to_json(F.array(*[F.col(k).cast("string") for k in keys])))
    key = lambda i, keys, parent: F.struct(F.lit(i).alias("rule"), text(keys).alias("key"), F.lit(int(not parent)).alias("child"), F.lit(int(parent)).alias("parent"))
    out = None
    for name, df in tables.items():
        stacks = [key(i, keys, False) for i, (n, keys, _) in enumerate(rules) if n == name] + [key(i, [of[1]], True) for i, (*_, of) in enumerate(rules) if of and of[0] == name]
        if stacks:
            rows = df.select(F.explode(F.array(*stacks)).alias("k")).select("k.*").where("key is not null")
            out = rows if out is None else out.unionByName(rows)
    names = [(i, n, f"{keys[0]} in {of[0]}" if of else "unique(" + ", ".join(keys) + ")", bool(of)) for i, (n, keys, of) in enumerate(rules)]
    if out is None:
        raise ValueError("no table has a constraint")
    named = out.sparkSession.createDataFrame(names, "rule int, table_name string, constraint_name string, reference boolean")
    counts = out.groupBy("rule", "key").agg(F.sum("child").alias("n"), F.max("parent").alias("parent"))
    broken = counts.groupBy("rule").agg(F.count_if(F.col("n") > 1).alias("repeated"), F.sum(F.when(F.col("parent") == 0, F.col("n"))).alias("orphans"))
    return named.join(broken, "rule", "left").select("table_name", "constraint_name", F.coalesce(F.when(F.col("reference"), F.col("orphans")).otherwise(F.col("repeated")), F.lit(0).cast(
        "long")).alias("violations"))
