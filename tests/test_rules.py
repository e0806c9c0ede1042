"""Rules on hand-made rows."""

import json
import random
import re
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import audit as audit_functions
from foliant.functions import books, identifiers, shelves, text
from foliant.operators import audit, catalog, joins, search, validation, windows
from foliant.operators import shelves as shelf_ops
from foliant.operators.search_index import SearchIndex
from foliant.schemas import TABLES
from foliant.sources import feeds
from foliant.sources.catalog_csv import csv_records, parse_catalog, read_catalog_csv
from foliant.sources.tables import load_table, save_table


def one(spark, column, **values):
    """The value of a column over one row."""
    row = spark.createDataFrame([tuple(values.values())] if values else [(1,)], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'bigint'}" for k, v in values.items()) or "x int")
    return row.select(column.alias("v")).first()["v"]


def brute_isbn13(raw):
    s = raw.replace("-", "").replace(" ", "").upper()
    if len(s) == 13 and s.isdigit() and sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(s)) % 10 == 0:
        return s, True
    if len(s) == 10 and s[:9].isdigit() and (s[9].isdigit() or s[9] == "X"):
        if (sum(int(c) * (10 - i) for i, c in enumerate(s[:9])) + (10 if s[9] == "X" else int(s[9]))) % 11 == 0:
            t = "978" + s[:9]
            return t + str((10 - sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(t)) % 10) % 10), True
    return s, False


def test_isbn_against_brute_force(spark):
    rng = random.Random(3)
    raw = ["".join(rng.choice("0123456789X- ") for _ in range(rng.choice((9, 10, 13, 14)))) for _ in range(500)] + ["0-306-40615-2", "080442957X", "080442957x", "978-3-16-148410-0", "", "9780000000000"]
    for body in range(300):
        raw += [f"{body:09d}{c}" for c in "0123456789X"]
    df = identifiers.with_isbn13(spark.createDataFrame([(x,) for x in raw], "raw string"), "raw")
    for r in df.collect():
        assert (r["isbn13"], r["is_valid"]) == brute_isbn13(r["raw"])


def test_identifiers(spark):
    ids = F.from_json(F.lit('[{"type":"other","identifier":" "},{"type":"isbn_13","identifier":"978-1"},{"type":"ISBN_10","identifier":"1"}]'), "array<struct<type:string,identifier:string>>")
    assert one(spark, identifiers.identifier_of(ids, "ISBN_13")) == "978-1"
    assert one(spark, identifiers.book_identity(ids, F.lit("T"), F.array(F.lit("a")))) == "9781"
    none = F.array().cast("array<struct<type:string,identifier:string>>")
    assert one(spark, identifiers.book_identity(none, F.lit("Tea"), F.array(F.lit("ann")))) == "TEA|ANN"
    assert one(spark, identifiers.normalize_identifier(F.lit(" -x 1"))) == "X1"
    assert one(spark, identifiers.normalize_identifier(F.lit("  "))) is None
    assert one(spark, identifiers.isbn_query(F.lit("123456789x"))) == "123456789X"
    assert one(spark, identifiers.isbn_query(F.lit("977 0000000000"))) is None
    assert one(spark, identifiers.fallback_id(F.lit("A  Tale!"), F.lit("B. C"))) == "a-tale-b-c"


def test_text_keys(spark):
    assert one(spark, text.search_text(F.col("t")), t="Crème BRÛLÉE, øre!") == "creme brulee re"
    assert text.search_literal("Crème BRÛLÉE, øre!") == "creme brulee re"
    assert one(spark, text.comparable(F.lit("Éa-1 b"))) == "éa1b"
    assert one(spark, text.author_key(F.lit(" Jane_Doe "))) == "Jane Doe"


def test_books(spark):
    assert one(spark, books.genres_of(F.lit("The GHOSTS of war"), F.lit("a medieval romance"))) == ["horror", "romance", "historical-fiction"]
    assert one(spark, books.genres_of(F.lit("ghostly"), F.lit(None).cast("string"))) == []
    dates = {"2024-07-04": "2024-07-04", "July 4, 2024": "2024-07-04", "2024": None, "2024-07": "2024-07-01", "soon": None}
    for raw, want in dates.items():
        got = one(spark, books.release_date(F.lit("upcoming"), F.lit(raw)))
        assert (str(got) if got else None) == want
    assert one(spark, books.release_date(F.lit("popular"), F.lit("2024-07-04"))) is None
    urls = {"https://a.org/x": True, "http://a.org": False, "https://u:p@a.org/": False, "/x": False, " ": False, "https://a.org/" + "x" * 2000: False}
    for url, want in urls.items():
        assert one(spark, books.valid_cover_url(F.lit(url))) is want


@pytest.mark.parametrize(("pages", "percent", "count", "driver", "want"), [(150, 0, 100, "pages", (100, 100, 100)), (-3, 7, 0, "pages", (0, 7, 0)), (0, 33, 10, "percent", (3, 33, 10)), (0, 120, 0, "percent", (0, 100, 0)), (50, 10, 40, "page_count", (40, 100, 40)), (1, 0, 200, "pages", (1, 1, 200))])
def test_progress(spark, pages, percent, count, driver, want):
    got = shelves.progress(F.lit(pages), F.lit(percent), F.lit(count), driver)
    assert tuple(one(spark, c) for c in got) == want


def test_shelf_scalars(spark):
    assert one(spark, shelves.canonical_status(F.lit("to BE read"))) == "To Be Read"
    assert one(spark, shelves.canonical_status(F.lit("reread"))) is None
    assert [one(spark, shelves.goal_percentage(F.lit(d), F.lit(t))) for d, t in ((0, 0), (1, 8), (9, 8))] == [0, 13, 100]


def test_audit_names(spark):
    url = "https://EN.wikipedia.org/w/Page?Page=2&ref=x&&page=3&a%2Bb=1&c+d"
    assert one(spark, audit_functions.api_name(F.lit(url))) == "Wikipedia API"
    assert one(spark, audit_functions.api_name(F.lit(None).cast("string"))) == "Unknown External API"
    assert one(spark, audit_functions.query_names(F.lit(url))) == "a+b,c+d,Page,ref"
    assert one(spark, audit_functions.query_names(F.lit("https://a.org/"))) is None
    for ts, want in {"2024-01-04 04:59:59": "2024-01-04 05:00:00", "2024-01-04 05:00:00": "2024-01-11 05:00:00", "2024-01-05 00:00:00": "2024-01-11 05:00:00"}.items():
        assert str(one(spark, audit_functions.next_weekly_refresh(F.lit(ts).cast("timestamp")))) == want


CSV = 'Author,ISBN ,title\r\n"Doe, J",1,"Multi\nline"\r\n ,,\r\nx,y\r\n"say ""hi""",2,t\r\n'


def test_catalog_csv(spark, tmp_path):
    rows, errors = parse_catalog(("﻿" + CSV).encode())
    assert rows == [(2, "1", "Multi\nline", "Doe, J"), (5, "2", "t", 'say "hi"')]
    assert errors == [(4, "row", "Expected 3 columns but found 2.")]
    assert parse_catalog(b"") == ([], [(1, "file", "The CSV is empty.")])
    assert [e[2] for e in parse_catalog(b"isbn,isbn,genre\n")[1]] == ["Unknown columns: genre.", "Missing columns: title, author.", "Duplicate columns: isbn."]
    assert parse_catalog(b"isbn,title,author\n\n ,,\n1,2\n")[1] == [(4, "row", "Expected 3 columns but found 2."), (1, "file", "The CSV contains no books.")]
    assert [e[2] for e in parse_catalog(b"\n")[1]] == ["Unknown columns: .", "Missing columns: isbn, title, author."]
    assert parse_catalog(b'isbn,title,author\n"open,1,2')[1] == [(1, "file", "The CSV contains an unclosed quoted field.")]
    long = "x, \n" * 260_000
    assert parse_catalog(f'isbn,title,author\n1,"{long}",c'.encode())[0] == [(2, "1", long.strip(), "c")]
    assert parse_catalog(b"isbn,title,author\n\xff,1,2")[1][0][:2] == (1, "file")
    (tmp_path / "a.csv").write_text(CSV)
    (tmp_path / "b.csv").write_text("isbn\n")
    rows, errors = read_catalog_csv(spark, str(tmp_path))
    assert rows.count() == 2
    assert sorted(r["message"] for r in errors.collect()) == ["Expected 3 columns but found 2.", "Missing columns: title, author."]


def test_feeds(spark, tmp_path):
    volumes = {"items": [{"id": "1", "volumeInfo": {"title": "A", "language": "en", "authors": ["x"], "industryIdentifiers": [{"type": "ISBN_13", "identifier": "9"}]}}, {"id": "2", "volumeInfo": {"title": "B", "language": "es"}}, {"volumeInfo": {"title": "C", "language": "en"}}, {"id": "3", "volumeInfo": {"language": "en"}}]}
    (tmp_path / "v.json").write_text(json.dumps(volumes))
    assert [r["id"] for r in feeds.read_volumes(spark, str(tmp_path / "v.json")).collect()] == ["1"]
    best = {"status": "OK", "results": {"bestsellers_date": "2024-01-01", "lists": [None, {"display_name": "L", "books": [None, {"title": "T", "author": "A", "primary_isbn10": "1", "primary_isbn13": "2", "buy_links": [None, {"name": "n", "url": "u"}]}]}]}}
    (tmp_path / "b.json").write_text(json.dumps(best))
    rows = feeds.read_bestsellers(spark, str(tmp_path / "b.json"))
    r = rows.first()
    assert (rows.count(), r["list_name"], r["description"], r["weeks_on_list"], len(r["buy_links"])) == (1, "L", "", 0, 1)
    v = feeds.bestsellers_to_volumes(rows).first()
    assert v["id"] == "nyt-2-1"
    assert [i["type"] for i in v["identifiers"]] == ["ISBN_10", "ISBN_13"]
    (tmp_path / "n.json").write_text(json.dumps(best | {"status": "ERROR"}))
    assert feeds.read_bestsellers(spark, str(tmp_path / "n.json")).count() == 0
    works = {"docs": [{"key": "/works/OL1W", "title": "W", "isbn": ["123456789x", "123456789X", "9780000000002"], "cover_i": 5, "first_publish_year": 1999}, {"key": "/k", "title": " "}]}
    (tmp_path / "w.json").write_text(json.dumps(works))
    w = feeds.read_open_works(spark, str(tmp_path / "w.json")).collect()
    assert len(w) == 1
    assert (w[0]["id"], w[0]["published_date"], w[0]["thumbnail"], [i["identifier"] for i in w[0]["identifiers"]]) == ("openlibrary-works-OL1W", "1999", "https://covers.openlibrary.org/b/id/5-L.jpg", ["123456789x", "9780000000002"])
    library = [{"isbn": "978", "title": "T", "key": "/books/B", "authors": [{"name": "A"}, {"name": ""}], "identifiers": {"isbn_10": ["1"]}}, {"isbn": "979", "title": "no author"}]
    (tmp_path / "l.json").write_text(json.dumps(library))
    m = feeds.metadata_from_library(feeds.read_library_books(spark, str(tmp_path / "l.json"))).collect()
    assert [(x["source_book_id"], x["authors"], [i["identifier"] for i in x["identifiers"]]) for x in m] == [("openlibrary-books-B", ["A"], ["1", "978"])]
    meta = feeds.metadata_from_volumes(feeds.read_volumes(spark, str(tmp_path / "v.json")).withColumn("isbn13", F.lit("9"))).first()
    assert (meta["source_book_id"], meta["cover_url"]) == ("1", "")


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 7, 2024, 5, datetime(2024, 1, 1))], TABLES["reading_goals"])
    save_table(df, "reading_goals", str(tmp_path / "goals"))
    assert load_table(spark, "reading_goals", str(tmp_path / "goals")).collect() == df.collect()


def requests(spark, rows):
    names = TABLES["entry_requests"]
    return spark.createDataFrame(rows, names)


def request(i, minute, status, isbn13=None, isbn10=None, source=None, book=None, pages=None, percent=None, count=10, user=1):
    return (i, datetime(2024, 1, 1) + timedelta(minutes=minute), user, None, source, book, " T ", None, None, isbn10, isbn13, status, count, pages, percent)


def test_upsert_rules(spark):
    rows = [
        request(1, 1, "reading", isbn13="97-8"), request(2, 2, "READ", isbn13="978"), request(3, 3, "read", isbn13="978", percent=5), request(4, 4, "Reading", isbn13="978", isbn10="x"), request(5, 5, "Did not finish", isbn10="X", pages=3),
        request(6, 6, "Read", isbn13="978"), request(7, 1, "Read", source="s", book="b", count=0, user=2),
    ]
    out = shelf_ops.upsert_entries(spark.createDataFrame([], TABLES["book_entries"]), requests(spark, rows)).orderBy("user_id", F.desc("entry_id")).collect()
    first, second, other = out
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    # request 5 erases the ISBN-13, so request 6 makes an entry of its own
    assert (first["entry_id"], first["status"], first["isbn13"], first["isbn10"], first["start_date"], first["end_date"], first["pages_completed"], first["percent_completed"]) == (-1, "Did Not Finish", None, "X", at(1), at(2), 3, 5)
    assert (second["entry_id"], second["status"], second["percent_completed"], second["pages_completed"], second["title"]) == (-6, "Read", 100, 10, "T")
    assert (other["user_id"], other["pages_completed"], other["percent_completed"]) == (2, 0, 100)


def test_updates_and_conflicts(spark):
    entries = shelf_ops.upsert_entries(spark.createDataFrame([], TABLES["book_entries"]), requests(spark, [request(1, 1, "reading", isbn13="978"), request(2, 1, "reading", isbn13="979")]))
    change = [r[:3] + (e,) + r[4:] for e, r in ((-1, request(3, 5, "Read", isbn13="978")), (-2, request(4, 5, "Read", isbn13="978")))]
    updated, conflicts = shelf_ops.update_entries(entries, requests(spark, change))
    assert [r["request_id"] for r in conflicts.collect()] == [4]
    got = {r["entry_id"]: (r["status"], r["percent_completed"], r["end_date"]) for r in updated.collect()}
    assert got == {-1: ("Read", 100, datetime(2024, 1, 1, 0, 5)), -2: ("Reading", 0, None)}


def test_any_key_match_against_or(spark):
    rng = random.Random(1)
    pick = lambda: rng.choice([None, "", *"abcdefgh"])
    left = [(i, rng.randrange(3), pick(), pick(), pick(), pick()) for i in range(300)]
    right = [(i, rng.randrange(3), pick(), pick(), pick(), pick()) for i in range(300)]
    columns = "user_id int, isbn13 string, isbn10 string, source string, source_book_id string"
    got = {r["request_id"]: r["match_id"] for r in joins.match_entries(spark.createDataFrame(left, "request_id int, " + columns), spark.createDataFrame(right, "entry_id int, " + columns)).collect()}
    for a in left:
        hits = [b[0] for b in right if a[1] == b[1] and ((a[2] and a[2] == b[2]) or (a[3] and a[3] == b[3]) or (a[4] and a[5] and (a[4], a[5]) == (b[4], b[5])))]
        assert got[a[0]] == (min(hits) if hits else None)


def test_validation(spark):
    rows = spark.createDataFrame([("u", "F", "L", "a@b", "longenough"), (" ", "F", None, "nobody", "short")], "username string, first_name string, last_name string, email string, password string")
    good, errors = validation.validate(rows.withColumn("id", F.monotonically_increasing_id()), validation.REGISTRATION_RULES, ["username"])
    assert good.count() == 0
    assert sorted(r["message"] for r in errors.collect()) == ["email is not a valid e-mail address.", "last_name is required.", "password must have at least 8 characters.", "username is required.", "username must have at least 2 characters.", "username must have at least 2 characters."]
    bad = requests(spark, [request(1, 1, "x", isbn13="1"), request(2, 1, "read", isbn13="1", pages=11), request(3, 1, "read", source="s"), request(4, 1, "read", source="s", book="b")])
    fine, rest = validation.validate_entries(bad)
    assert [r["request_id"] for r in fine.collect()] == [4]
    assert rest.count() == 3


def test_recently_viewed_rules(spark):
    rows = [(1, b, datetime(2024, 1, 1) + timedelta(minutes=i)) for i, b in enumerate([*"abca", *map(str, range(14))])]
    views = spark.createDataFrame(rows, "user_id int, book string, ts timestamp")
    got = [r["book"] for r in windows.recently_viewed(views, "book").orderBy("position").collect()]
    assert got == [str(i) for i in range(13, 1, -1)]
    few = windows.recently_viewed(views.where("book in ('a', 'b', 'c')"), "book").orderBy("position").collect()
    assert [r["book"] for r in few] == ["a", "c", "b"]


def test_backfill_and_entries_of_volumes(spark):
    r = shelf_ops.backfill_entries(spark.createDataFrame([(5, None, None, None)], "entry_id long, source string, source_book_id string, title string")).first()
    assert tuple(r) == (5, "legacy", "entry-5", "Unknown title")
    volume = spark.createDataFrame([("1", "T", ["A", "B"], None, "small", [("isbn_13", "978")], None, None)], "id string, title string, authors array<string>, thumbnail string, small_thumbnail string, identifiers array<struct<type:string,identifier:string>>, page_count int, feed string")
    e = search.volumes_to_entries(volume, "To Be Read").first()
    assert (e["authors"], e["thumbnail_url"], e["isbn10"], e["isbn13"], e["page_count"]) == ("A, B", "small", None, "978", 0)


def test_search_ranking(spark):
    columns = "id string, title string, authors array<string>, thumbnail string, small_thumbnail string, identifiers array<struct<type:string,identifier:string>>, pos int"
    rows = [("a", "Cafés of Paris", ["x"], None, None, None, 0), ("b", "Paris", ["y"], None, None, [("ISBN_10", "1")], 1), ("c", "z", ["Paris Hilton"], "t", None, None, 2), ("b", "again", ["y"], None, None, None, 3), ("", "no id", [], None, None, None, 4)]
    got = search.rank_results(spark.createDataFrame(rows, columns), "PARIS").collect()
    assert [(r["id"], r["score"]) for r in got] == [("b", 1000 + 200 + 20), ("c", 550 + 180 + 10), ("a", 400 + 200)]
    with pytest.raises(ValueError, match="query"):
        search.field_search(spark.createDataFrame(rows, columns), " ")


def test_merge_keeps_first_identifier_rule(spark):
    """A bestseller lists ISBN_10 first, so a feed item that lists ISBN_13 first is another identity."""
    ids = "array<struct<type:string,identifier:string>>"
    feed = spark.createDataFrame([("g", "v1", "Other", ["A"], "", "", "en", None, "cover", [("ISBN_13", "978")], "volumes", 0)], f"genre_slug string, id string, title string, authors array<string>, description string, publisher string, language string, small_thumbnail string, thumbnail string, identifiers {ids}, feed string, pos long")
    best = spark.createDataFrame([(0, "One", " ann ", "", "", [("ISBN_10", "1"), ("ISBN_13", "978")], None), (1, "Two", "Ann", "", "", [("ISBN_10", "2"), ("ISBN_13", None)], "c"), (2, "Three", "bob", "", "", [("ISBN_10", "3"), ("ISBN_13", None)], None)], f"pos long, title string, author string, description string, publisher string, isbns {ids}, book_image string")
    got = catalog.genre_merge(feed, best, {"g": "never"}).orderBy("rank").collect()
    assert [(r["title"], r["feed"]) for r in got] == [("Two", "bestsellers"), ("Other", "volumes"), ("One", "bestsellers")]


def test_rotation_and_lookup(spark):
    items = spark.createDataFrame([(i, f"n{i}") for i in range(3)], "idx int, name string")
    dates = spark.createDataFrame([("2024-01-01",), ("2024-01-05",), ("2023-12-31",)], "d string").select(F.to_date("d").alias("date"))
    assert {str(r["date"]): r["name"] for r in audit.rotation(dates, items).collect()} == {"2024-01-01": "n0", "2024-01-05": "n1", "2023-12-31": "n2"}


def toggled(text):
    """Records by tokens: a quoted stretch, a comma, a line's end, other characters."""
    records, record, field = [], [], ""
    for t in re.findall(r'"(?:[^"]|"")*"|\r\n|[\r\n,]|[^"\r\n,]+|"', text):
        if t == '"':
            raise ValueError
        if t[0] == '"':
            field += t[1:-1].replace('""', '"')
        elif t[0] not in ",\r\n":
            field += t
        else:
            record, field = [*record, field], ""
            if t != ",":
                records, record = [*records, record], []
    return [*records, [*record, field]] if field or record else records


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='a,"\r\n', max_size=12))
def test_quotes_anywhere(text):
    try:
        want = toggled(text)
    except ValueError:
        with pytest.raises(ValueError, match="unclosed"):
            csv_records(text)
    else:
        assert csv_records(text) == want


def test_rules_as_a_table(spark):
    """Terms of the genre patterns find what the patterns find; ten thousand more rules change nothing for books without them."""
    rng = random.Random(3)
    terms = [(g, t) for g, p in books.GENRE_RULES.items() for t in books.terms_of(p)]
    assert {"sci-fi", "coming-of-age", "spaceship", "possession", "life of"} <= {t for _, t in terms} and "" not in {t for _, t in terms}
    some = [t for _, t in terms] + ["the", "x", "ghostly", "sci", "fi", "_magic", "ÉLVES", "Science  Fiction", "9gods"]
    rows = [(i, None if i % 9 == 0 else rng.choice(["", " ", "-", ", ", "é"]).join(rng.choice(some) for _ in range(rng.randrange(5))), None if i % 5 == 0 else rng.choice(some).upper() + rng.choice(["", "!", "s"])) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, title string, description string")
    want = sorted((r["id"], r["genre_slug"]) for r in books.classify(df).collect())
    more = [(f"g{i % 50}", f"zz{i} yy{i % 7}") for i in range(10_000)]
    rules = spark.createDataFrame(terms + more + [("none", None), ("none", " "), ("horror", "ghost")], "genre_slug string, term string")
    got = sorted((r["id"], r["genre_slug"]) for r in books.classify_by_terms(df, rules, ["id"]).collect())
    assert got == want and len(got) > 300
    one = spark.createDataFrame([(1, "A ZZ77 YY0 b", None)], "id int, title string, description string")
    assert [tuple(r) for r in books.classify_by_terms(one, rules, ["id"]).collect()] == [(1, "g27")]


def test_the_cache_is_joined_without_a_shuffle(spark):
    cache = joins.MetadataCache(spark, buckets=4)
    row = {c: "x" for c in joins.METADATA} | {"authors": ["a"], "identifiers": []}
    schema = TABLES["book_metadata"]
    frame = lambda ids: spark.createDataFrame([tuple((row | {"isbn13": i}).get(f.name) for f in spark.createDataFrame([], schema).schema) for i in ids], schema)
    cache.save(frame(["1", "2", "2", None]))
    cache.save(frame(["2", "3"]))
    cache.save(frame(["3"]))
    assert sorted(r["isbn13"] for r in cache.read().collect()) == ["1", "2", "3"]
    wanted = spark.range(100).selectExpr("cast(id as string) isbn13").repartition(4, "isbn13")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = wanted.join(cache.read(), "isbn13")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_constraints_read_each_table_once(spark, tmp_path):
    one = lambda name, ddl, rows: (spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}"))[1]
    tables = {
        "users": one("users", "user_id int, identity_user_id string", [(1, "a"), (2, "zz"), (3, None)]), "identities": one("identities", "id string", [("a",)]),
        "reading_goals": one("reading_goals", "user_id int, year int", [(1, 2024), (1, 2024), (1, 2025), (9, 2024), (9, 2023)]),
        "book_entries": one("book_entries", "user_id int, source string, source_book_id string", [(1, "s", "b"), (1, "s", "b"), (1, "s", None), (1, "s", None)]),
    }
    out = validation.audit_constraints(tables)
    got = {(r["table_name"], r["constraint_name"]): r["violations"] for r in out.collect()}
    assert got == {("book_entries", "unique(user_id, source, source_book_id)"): 1, ("reading_goals", "unique(user_id, year)"): 1, ("users", "identity_user_id in identities"): 1,
        ("reading_goals", "user_id in users"): 2, ("book_entries", "user_id in users"): 0}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 4


def test_most_buckets_of_an_index_are_not_read(spark, tmp_path):
    """Searches through the index give the rows of a scan; rare terms read few buckets."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 4, 6]))) for _ in range(300)]
    row = lambda i: (f"v{i}", " ".join(rng.choice(words) for _ in range(4)) if i % 9 else None, "d", [rng.choice(words), None] if i % 4 else None, ["Sub Ject"] if i % 2 else [])
    rows = [row(i) for i in range(600)] + [("rare", "A Zanzibar Journey", None, ["Q"], None)] + [("same", "x y", None, None, None)] * 30
    df = spark.createDataFrame(rows, "id string, title string, description string, authors array<string>, categories array<string>").coalesce(2)
    index = SearchIndex(spark, str(tmp_path))
    index.build(df, rows=20)
    ids = lambda found: sorted(r["id"] for r in found.collect())
    for asked in ({"intitle": "zanzibar journey"}, {"text": f"{words[3]} {words[5]}"}, {"intitle": words[7], "subject": "ject sub"}, {"inauthor": words[2]}, {"text": "x"}, {"intitle": "nowhere at all"}):
        assert ids(index.search(**asked, limit=False)) == ids(search.field_search(df, **asked, limit=False))
    assert len(index.buckets(intitle="zanzibar")) == 1 and index.buckets(intitle="nowhere") == [] and index.buckets(text="x") is None
    all_files = len(spark.read.parquet(f"{tmp_path}/volumes").inputFiles())
    scan = index.search(intitle="zanzibar")._jdf.queryExecution().executedPlan().toString()
    assert all_files > 20 and "PartitionFilters: [isnotnull(bucket" in scan.replace("#", " #").replace(" #", "#") or "bucket#" in scan
