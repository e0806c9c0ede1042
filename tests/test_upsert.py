"""The upsert of entries by any key against a plain replay of all requests."""

import collections

from foliant.operators import shelves, validation
from foliant.operators.components import components
from foliant.plans import shelf_queries
from foliant.schemas import TABLES
from tests.test_oracle import SF

TEXTS = ("source", "source_book_id", "title", "authors", "thumbnail_url", "isbn10", "isbn13", "status", "page_count")


def keys(x):
    pair = (x["source"], x["source_book_id"]) if x["source"] and x["source_book_id"] else None
    return {(kind, v) for kind, v in (("13", x["isbn13"]), ("10", x["isbn10"]), ("s", pair)) if v}


def plain(entries, requests):
    """user -> entries, looking through all of a user's entries for each request."""
    shelf = collections.defaultdict(list)
    for e in entries:
        shelf[e["user_id"]].append(dict(e))
    for r in sorted(requests, key=lambda r: (r["ts"], r["request_id"])):
        mine = shelf[r["user_id"]]
        found = [e for e in mine if keys(e) & keys(r)]
        if found:
            e = min(found, key=lambda e: e["entry_id"])
        else:
            e = {"entry_id": -r["request_id"], "user_id": r["user_id"], "status": None, "pages_completed": 0, "percent_completed": 0, "start_date": None, "end_date": None}
            mine.append(e)
        was = e["status"]
        e.update({c: r[c] for c in TEXTS})
        for c in ("pages_completed", "percent_completed"):
            e[c] = r[c] if r[c] is not None else e[c]
        if e["status"] == "Reading":
            e["start_date"] = e["start_date"] or r["ts"]
        if e["status"] == "Read" and was != "Read":
            e["end_date"], e["percent_completed"] = r["ts"], 100
            e["pages_completed"] = e["page_count"] if (e["page_count"] or 0) > 0 else e["pages_completed"]
    return [e for es in shelf.values() for e in es]


COLUMNS = ("user_id", "entry_id", "isbn10", "isbn13", "source_book_id", "status", "page_count", "pages_completed", "percent_completed", "start_date", "end_date")


def listed(rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=str)


def test_keys_that_change(spark):
    valid, _ = validation.validate_entries(shelf_queries.changing_requests(spark, SF))
    asked = [r.asDict() for r in shelves.prepared(valid).collect()]
    empty = spark.createDataFrame([], TABLES["book_entries"])
    half = asked[::2], asked[1::2]
    once = shelves.upsert_entries(empty, valid)
    assert listed(once.collect()) == listed(plain([], asked))
    assert len(plain([], asked)) < len(asked)
    schema = valid.schema
    first = shelves.upsert_entries(empty, spark.createDataFrame([tuple(r[f.name] for f in schema) for r in half[0]], schema))
    want = plain([], half[0])
    both = shelves.upsert_entries(first, spark.createDataFrame([tuple(r[f.name] for f in schema) for r in half[1]], schema))
    assert listed(both.collect()) == listed(plain(want, half[1]))


def test_a_user_is_many_groups(spark):
    """Ten thousand books of one user, whose keys change pairwise, are as many parts as books."""
    rows = spark.range(10_000).selectExpr("id request_id", "timestamp_seconds(id) ts", "1 user_id", "cast(null as long) entry_id", "'s' source", "cast(id div 2 as string) source_book_id", "'t' title",
        "cast(null as string) authors", "cast(null as string) thumbnail_url", "cast(null as string) isbn10", "if(id % 2 = 1, cast(id as string), null) isbn13", "'Reading' status", "1 page_count", "0 pages_completed", "0 percent_completed")
    e = shelves._key_names(spark.createDataFrame([], TABLES["book_entries"]))
    _, asked = shelves._with_parts(e, shelves._key_names(shelves.prepared(rows)))
    assert asked.select("__part").distinct().count() == 5_000
    assert shelves.upsert_entries(e.drop("__keys"), rows).count() == 5_000


def test_components_of_strings(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), (None, "z"), ("q", "q")], "a string, b string")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
