"""Registered queries on catalogues, feeds and search, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, joins, search, validation, windows
from ..operators.search_index import SearchIndex
from ..shared import drop_saved, saved, work_dir
from . import views as v
from .views import read, sql_isbn10, sql_isbn13, sql_stamp, stamp

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ORDERED = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"


@query(
    f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY {_ORDERED}) AS n, count(*) OVER (PARTITION BY l_orderkey, "
        f"l_partkey) AS copies FROM lineitem) "
    f"SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDERED})::int AS position, CASE WHEN copies > 1 THEN "
        f"copies END AS n FROM r WHERE n = 1"
)
def import_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    order = _ORDERED.split(", ")
    kept, _ = windows.keep_first(line, ["l_orderkey", "l_partkey"], order)
    again = validation.duplicates(line, ["l_orderkey", "l_partkey"])
    return windows.compact_positions(kept, ["l_orderkey"], order).join(again, ["l_orderkey", "l_partkey"], "left").select("l_orderkey", "l_partkey",
        "position", "n")


#: Valid rows of the import with their number, and the errors of the first two stages. A cut ISBN of nine digits is never valid.
_CHECKED = v.IMPORT_ROWS + f""",
named AS (SELECT *, l_linenumber <> 7 AS valid, {sql_isbn13('l_partkey')} AS isbn13 FROM import_rows),
good AS (SELECT *, row_number() OVER (PARTITION BY file, isbn13 ORDER BY row) AS n FROM named WHERE valid AND trim(title) <> '' AND trim(author) <> ''),
kept AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY row) AS position FROM good WHERE n = 1),
early AS (SELECT file, row, 1 AS stage, 1 AS rule, 'isbn' AS field, 'Enter a valid ISBN-10 or ISBN-13.' AS message FROM named WHERE NOT valid
  UNION ALL SELECT file, row, 1, 3, 'author', 'Author is required.' FROM named WHERE trim(author) = ''
  UNION ALL SELECT file, row, 2, 1, 'isbn', 'ISBN is duplicated; the first occurrence was kept.' FROM good WHERE n > 1)
"""


@query(f"WITH {_CHECKED} SELECT * FROM early")
def import_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.checked_rows(v.import_rows(spark, sf_dir), ["file"])[1]


@query(
    f"WITH k AS (SELECT DISTINCT l_partkey AS p_partkey FROM lineitem) SELECT {sql_isbn13('p_partkey')} AS isbn13, {v.SQL_PROVIDER} AS provider, CASE "
        f"WHEN {v.SQL_PROVIDER} IS NOT NULL THEN p_name END AS title, coalesce(p_partkey % 5 BETWEEN 1 AND 3, false) AS is_new "
    "FROM k JOIN part USING (p_partkey)"
)
def metadata_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "lineitem").select(v.isbn13(F.col("l_partkey")).alias("isbn13"))
    found, new, missing = joins.resolve_metadata(wanted, *[v.metadata_rows(spark, sf_dir, n) for n in ("cache", "library", "volumes")])
    flags = new.select("isbn13", F.lit(True).alias("is_new"))
    rows = found.select("isbn13", "provider", "title").unionByName(missing.select("isbn13", F.lit(None).cast("string").alias("provider"),
        F.lit(None).cast("string").alias("title")))
    return rows.join(flags, "isbn13", "left").select("isbn13", "provider", "title", F.coalesce("is_new", F.lit(False)).alias("is_new"))


def _section(file: str) -> str:
    return f"CASE WHEN ({file}) % 2 = 0 THEN 'popular' ELSE 'upcoming' END"


#: Published books of a slug: an order is a slug of its own; parts of its odd lines from supplier 7 on are published in the other section.
_IMPORTED = f"""
WITH {_CHECKED},
published AS (SELECT file, max(l_partkey) AS k FROM import_rows GROUP BY file),
clash AS (SELECT t.file, t.row FROM kept t JOIN published p ON t.file = p.file AND t.l_partkey = p.k),
late AS (SELECT file, row, 3 AS stage, 1 AS rule, 'isbn' AS field, 'This ISBN is already in the ' || CASE WHEN file % 2 = 0 THEN 'upcoming' ELSE 'popular' END || ' section.' AS message FROM clash
  UNION ALL SELECT file, row, 4, 1, 'isbn13', 'No book metadata was found for this ISBN.' FROM kept WHERE l_partkey % 5 = 4
  UNION ALL SELECT file, row, 4, 2, 'title', 'Resolved title ''' || p_name || ''' does not match the CSV.' FROM kept JOIN part ON l_partkey = p_partkey WHERE l_partkey % 5 <> 4 AND title = 'no such title'
  UNION ALL SELECT file, row, 4, 3, 'author', 'Resolved authors ''' || p_brand || ''' do not match the CSV.' FROM kept JOIN part ON l_partkey = p_partkey WHERE l_partkey % 5 <> 4 AND author = 'Somebody Else'),
fine AS (SELECT k.* FROM kept k WHERE l_partkey % 5 <> 4 AND title <> 'no such title' AND author <> 'Somebody Else' AND NOT EXISTS (FROM clash c WHERE c.file = k.file AND c.row = k.row)),
books AS (SELECT file, {_section('file')} AS section, position, isbn13 FROM fine
  UNION ALL SELECT p.file, {_section('p.file + 1')}, 1, {sql_isbn13('p.k')} FROM published p WHERE EXISTS (FROM fine f WHERE f.file = p.file) AND NOT EXISTS (FROM kept k WHERE k.file = p.file AND k.l_partkey = p.k)),
empty AS (SELECT DISTINCT file, 1 AS row, 5 AS stage, 1 AS rule, 'file' AS field, 'No valid rows were available to preview.' AS message FROM kept WHERE file NOT IN (SELECT file FROM fine)
  UNION ALL SELECT DISTINCT file, 1, 2, 2, 'file', 'The CSV contains no books.' FROM import_rows WHERE file NOT IN (SELECT file FROM kept))
"""


@query(
    _IMPORTED + "SELECT 'book' AS kind, file, section, position AS row, isbn13 AS field, '' AS message FROM books UNION ALL SELECT 'error', file, "
        "NULL, row, field, message FROM (FROM early UNION ALL FROM late UNION ALL FROM empty)"
)
def catalog_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.import_rows(spark, sf_dir).withColumns({"slug": F.col("file").cast("string"), "section": F.when(F.col("file") % 2 == 0,
        "popular").otherwise("upcoming")})
    other = F.when(F.col("file") % 2 == 0, "upcoming").otherwise("popular")
    k = F.col("k")
    published = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.max("l_partkey").alias("k")).select(
        F.col("file").cast("string").alias("slug"), other.alias("section"), F.lit(1).alias("position"), v.isbn13(k).alias("isbn13"),
            F.lit("").alias("source_book_id"), F.lit("").alias("title"), F.array(F.lit("")).alias("authors"), F.lit("").alias("description"),
        F.lit("").alias("cover_url"), F.lit("").alias("publisher"), v.named_identifiers(v.isbn10(k), v.isbn13(k)).alias("identifiers"),
            F.lit("").alias("published_date"), F.lit(None).cast("date").alias("release_date"),
    )
    draft, errors, _ = catalog.import_catalog(rows, *[v.metadata_rows(spark, sf_dir, n) for n in ("cache", "library", "volumes")], published)
    books = draft.select(F.lit("book").alias("kind"), "file", "section", F.col("position").alias("row"), F.col("isbn13").alias("field"),
        F.lit("").alias("message"))
    return books.unionByName(errors.select(F.lit("error").alias("kind"), "file", F.lit(None).cast("string").alias("section"), "row", "field", "message"))


_SECTIONED = f"""
WITH {v.CATALOG_BOOKS}, {v.BATCHES}, latest AS (SELECT genre_slug, arg_max(batch_id, (published_at, batch_id)) AS batch_id, max(published_at) AS published_at FROM batches WHERE status = 'Published' GROUP BY genre_slug),
s AS (SELECT * FROM latest, (VALUES ('popular'), ('upcoming')) x(section))
"""


@query(_SECTIONED + f"SELECT s.genre_slug, s.batch_id, s.section, {sql_stamp('s.published_at')} AS published_at, coalesce(string_agg(isbn13, ',' "
    f"ORDER BY position), '') AS isbns FROM s LEFT JOIN catalog_books b ON s.batch_id = b.batch_id AND s.section = b.section GROUP BY ALL")
def catalog_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = windows.latest_published(v.batches(spark, sf_dir))
    with_books = joins.batches_with_books(latest.select("batch_id"), v.catalog_books(spark, sf_dir))
    rows = catalog.assemble_sections(latest, with_books)
    return rows.select("genre_slug", "batch_id", "section", stamp("published_at").alias("published_at"),
        F.array_join(F.transform("books", lambda b: b["isbn13"]), ",").alias("isbns"))


@query(f"WITH {v.CATALOG_BOOKS}, {v.BATCHES} SELECT b.batch_id, count(isbn13) AS books, count(isbn13) = 0 AS empty FROM batches b LEFT JOIN (FROM "
    f"catalog_books WHERE position > 2) c ON b.batch_id = c.batch_id GROUP BY ALL")
def batch_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of each batch behind the first two of a section; a batch without any stays, with none."""
    books = v.catalog_books(spark, sf_dir).where("position > 2")
    rows = joins.batches_with_books(v.batches(spark, sf_dir).select("batch_id"), books)
    return rows.groupBy("batch_id").agg(F.count("isbn13").alias("books")).select("batch_id", "books", (F.col("books") == 0).alias("empty"))


@query(
    f"WITH {v.BATCHES}, p AS (SELECT genre_slug, max(batch_id) AS id FROM batches WHERE status IN ('Draft', 'Published') AND batch_id % 3 = 0 GROUP "
        f"BY genre_slug) SELECT batch_id, genre_slug, CASE WHEN batch_id = id THEN 'Published' WHEN status = 'Published' THEN 'Archived' ELSE status "
        f"END AS status, "
    f"{sql_stamp('CASE WHEN batch_id = id THEN TIMESTAMP ' + chr(39) + '2024-06-01' + chr(39) + ' ELSE published_at END')} AS published_at FROM "
        f"batches LEFT JOIN p USING (genre_slug)"
)
def catalog_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = v.batches(spark, sf_dir)
    requests = batches.where("batch_id % 3 = 0").select("genre_slug", "batch_id", F.lit("2024-06-01").cast("timestamp").alias("at"))
    return catalog.publish(batches, requests).withColumn("published_at", stamp("published_at"))


_SQL_DRAFT = f"""
WITH {v.CATALOG_BOOKS}, gone AS (SELECT batch_id, section, source_key FROM catalog_books WHERE position = 1), touched AS (SELECT DISTINCT batch_id, section FROM gone),
rest AS (SELECT b.batch_id, b.section, row_number() OVER (PARTITION BY b.batch_id, b.section ORDER BY b.position) AS position, b.isbn13 FROM catalog_books b WHERE b.position > 1),
ask AS (SELECT DISTINCT batch_id, CASE WHEN batch_id % 2 = 0 THEN 'popular' ELSE 'upcoming' END AS section, batch_id % (SELECT count(*) FROM part) AS k FROM rest),
new AS (SELECT a.batch_id, a.section, {sql_isbn13('a.k')} AS isbn13 FROM ask a WHERE a.k % 5 <> 4 AND NOT EXISTS (FROM rest r WHERE r.batch_id = a.batch_id AND r.isbn13 = {sql_isbn13('a.k')}))
SELECT batch_id, section, position, isbn13, CASE WHEN isbn13 IN (SELECT {sql_isbn13('p_partkey')} FROM part WHERE p_partkey % 50 = 0) THEN ' new cover ' ELSE 'cover' END AS cover_url FROM (FROM rest UNION ALL
SELECT n.batch_id, n.section, coalesce((SELECT max(position) FROM rest r WHERE r.batch_id = n.batch_id AND r.section = n.section), 0) + 1, n.isbn13 FROM new n)
"""


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(draft, errors, metadata) after the first books are taken out, a book is asked for in each draft, and covers of every fiftieth part are set where drafts hold it."""
    kept = saved(v.catalog_books(spark, sf_dir).select("batch_id", "section", "position", "source_key"), "books")
    books = kept.select("batch_id", "section", "position", v.isbn13(F.col("source_key")).alias("isbn13"), F.lit("cover").alias("cover_url"))
    rest = saved(catalog.remove_books(books, books.where("position = 1")), "rest")
    drop_saved(kept)
    n_parts = read(spark, sf_dir, "part").agg(F.count("*")).scalar()
    ask = rest.select("batch_id").distinct().withColumn("k", F.col("batch_id") % n_parts).select(F.col("batch_id").alias("request_id"), "batch_id",
        F.when(F.col("batch_id") % 2 == 0, "popular").otherwise("upcoming").alias("section"), v.isbn10(F.col("k")).alias("isbn"))
    meta = [v.metadata_rows(spark, sf_dir, n).withColumns({"cover_url": F.lit("cover"), "cover_override_url": F.lit(None).cast("string")})
        for n in ("cache", "library", "volumes")]
    draft, errors = catalog.add_books(rest, ask, *meta)
    draft = saved(draft, "draft")
    drop_saved(rest)
    all_meta = meta[0].unionByName(meta[1]).unionByName(meta[2])
    parts = read(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(v.isbn13(F.col("p_partkey")).alias("isbn13"), F.lit(" new cover ").alias("url"))
    asked = draft.join(parts, "isbn13").select("batch_id", "isbn13", "url", F.col("batch_id").alias("request_id"))
    blank = asked.select("batch_id", "isbn13", F.lit(" ").alias("url"), (F.col("request_id") - 1).alias("request_id"))  # taken away before it is set
    nowhere = parts.select(F.lit(-1).cast("long").alias("batch_id"), "isbn13", F.lit("no draft has it").alias("url"), F.lit(2**60).alias("request_id"))
    return *joins.apply_cover_overrides(draft, all_meta, asked.unionByName(blank).unionByName(nowhere)), errors


@query(_SQL_DRAFT)
def draft_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir)[0].select("batch_id", "section", "position", "isbn13", "cover_url")


@query(
    _SQL_DRAFT[: _SQL_DRAFT.index("SELECT batch_id, section, position")] + f"SELECT {sql_isbn13('p_partkey')} AS isbn13, CASE WHEN p_partkey % 50 = 0 AND {sql_isbn13('p_partkey')} IN (SELECT isbn13 FROM rest "
        f"UNION SELECT isbn13 FROM new) THEN ' new cover ' END AS cover_override_url FROM part WHERE p_partkey % 5 <> 4"
)
def cover_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata after the overrides: only books of a draft have one."""
    return _edited(spark, sf_dir)[1].select("isbn13", "cover_override_url")


@query(
    f"WITH {v.CATALOG_BOOKS}, {v.BATCHES}, ask AS (SELECT l_orderkey * 100 + l_partkey % 7 * 10 + l_linenumber AS request_id, l_orderkey AS batch_id, l_partkey + l_linenumber // 3 AS k, l_linenumber FROM "
        f"(SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY l_partkey) = 1), "
    f"named AS (SELECT *, l_linenumber <> 7 AS valid, {sql_isbn13('k')} AS isbn13, k % 5 <> 4 AND EXISTS (FROM part WHERE p_partkey = k) AS known, EXISTS (FROM batches b WHERE b.batch_id = a.batch_id AND status = 'Draft') "
        f"AS is_draft FROM ask a), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY batch_id, k, valid ORDER BY request_id) AS n, EXISTS (FROM catalog_books c WHERE c.batch_id = a.batch_id AND c.isbn13 = a.isbn13) AS there FROM named a) "
    "SELECT request_id, CASE WHEN NOT valid THEN 'Enter a valid ISBN-10 or ISBN-13.' WHEN NOT is_draft THEN 'Draft catalog not found.' WHEN there OR known AND n > 1 THEN 'This ISBN is already in the draft.' ELSE "
        "'No book metadata was found for this ISBN.' END AS message FROM n WHERE NOT valid OR NOT is_draft OR there OR n > 1 OR NOT known"
)
def draft_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of books that are asked for: parts of orders and their neighbours, with cut ISBNs (line 7)."""
    from pyspark.sql import Window

    books = v.catalog_books(spark, sf_dir).select("batch_id", "section", "position", "isbn13", F.lit("cover").alias("cover_url"))
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    ask = line.withColumn("request_id", F.col("l_orderkey") * 100 + F.col("l_partkey") % 7 * 10 + F.col("l_linenumber"))
    ask = ask.withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy("l_partkey"))).where("n = 1")
    full = v.isbn13((F.col("l_partkey") + F.floor(F.col("l_linenumber") / 3)).cast("long"))
    ask = ask.select("request_id", F.col("l_orderkey").alias("batch_id"), F.lit("popular").alias("section"), F.when(F.col("l_linenumber") == 7, F.substring(full, 1, 9)).otherwise(full).alias("isbn"))
    meta = [v.metadata_rows(spark, sf_dir, n) for n in ("cache", "library", "volumes")]
    return catalog.add_books(books, ask, *meta, batches=v.batches(spark, sf_dir))[1]


_RULES = " UNION ALL ".join(f"SELECT '{g}' AS genre_slug, '{p}' AS pattern" for g, p in v.TEST_RULES.items())


@query(f"WITH rules AS ({_RULES}) SELECT p_partkey, genre_slug FROM part, rules WHERE regexp_matches(lower(p_name || ' ' || p_type), pattern)")
def genre_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.books import classify

    return classify(v.volumes(spark, sf_dir), v.TEST_RULES).select(F.col("pos").alias("p_partkey"), "genre_slug")


@query(f"WITH rules AS ({_RULES}) SELECT p_partkey, genre_slug FROM part, rules WHERE regexp_matches(lower(p_name || ' ' || p_type), pattern)")
def genre_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same classes by rules that are a table of terms."""
    from ..functions.books import classify_by_terms, terms_of

    rules = spark.createDataFrame([(g, t) for g, p in v.TEST_RULES.items() for t in terms_of(p)], "genre_slug string, term string")
    return classify_by_terms(v.volumes(spark, sf_dir), rules, ["pos"]).select(F.col("pos").alias("p_partkey"), "genre_slug")


@query(
    f"WITH k AS (SELECT DISTINCT l_partkey AS p_partkey FROM lineitem) SELECT {sql_isbn13('p_partkey')} AS isbn13, {v.SQL_PROVIDER} AS provider, p_partkey % 5 BETWEEN 1 AND 3 AS is_new, false AS new_again "
    "FROM k JOIN part USING (p_partkey) WHERE p_partkey % 5 < 4"
)
def metadata_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata found by a first import, saved, and found by a second one: all come from the cache then."""
    wanted = saved(read(spark, sf_dir, "lineitem").select("l_partkey").distinct().select(v.isbn13(F.col("l_partkey")).alias("isbn13")), "wanted")
    cached, library, volumes = (v.metadata_rows(spark, sf_dir, n) for n in ("cache", "library", "volumes"))
    cache = joins.MetadataCache(spark)
    cache.save(cached)
    found, new, _ = joins.resolve_metadata(wanted, cache.read(), library, volumes)
    rows = saved(found.join(new.select("isbn13", F.lit(True).alias("is_new")), "isbn13", "left").select("isbn13", "provider", F.coalesce("is_new", F.lit(False)).alias("is_new")), "found")
    cache.save(new)
    again, new, _ = joins.resolve_metadata(wanted, cache.read(), library, volumes)
    flags = again.select("isbn13", "provider").join(new.select("isbn13", F.lit(True).alias("new_again")), "isbn13", "left")
    return rows.join(flags, ["isbn13", "provider"]).select("isbn13", "provider", "is_new", F.coalesce("new_again", F.lit(False)).alias("new_again"))


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes dealt to the genres by key; the genre colours' feed comes in two responses, so it is combined first."""
    vol = v.volumes(spark, sf_dir).withColumn("genre_slug", F.when(F.col("pos") % 4 == 0, "colours").when(F.col("pos") % 4 == 1, "hardware").otherwise("sizes"))
    return catalog.combine_feeds(vol, vol.where("pos % 8 = 0"), group=["genre_slug"]).drop("src_rank", "identity")


_MERGED = f"""
WITH rules AS ({_RULES}),
feed AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'colours' WHEN 1 THEN 'hardware' ELSE 'sizes' END AS genre_slug FROM part),
best AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)),
fits AS (SELECT b.p_partkey, f.genre_slug FROM best b JOIN feed f USING (p_partkey) UNION SELECT p_partkey, genre_slug FROM best, rules WHERE regexp_matches(lower(p_name || ' ' || p_type), pattern)),
chosen AS (FROM fits UNION SELECT b.p_partkey, a.genre_slug FROM best b JOIN (SELECT DISTINCT genre_slug, p_brand FROM fits JOIN best USING (p_partkey)) a USING (p_brand)),
rows AS (SELECT genre_slug, 0 AS src, p_partkey AS pos, CASE WHEN p_partkey % 2 = 1 THEN {sql_isbn10('p_partkey')} ELSE {sql_isbn13('p_partkey')} END AS identity, p_partkey % 5 <> 0 AS cover FROM chosen
  UNION ALL SELECT genre_slug, 1, p_partkey, {sql_isbn13('p_partkey')}, p_size % 3 <> 0 FROM feed),
uniq AS (SELECT *, row_number() OVER (PARTITION BY genre_slug, identity ORDER BY src, pos) AS n FROM rows),
merged AS (SELECT genre_slug, src, pos, identity, row_number() OVER (PARTITION BY genre_slug ORDER BY cover DESC, src, pos) AS rank FROM uniq WHERE n = 1)
"""


@query(_MERGED + "SELECT genre_slug, CASE src WHEN 0 THEN 'bestsellers' ELSE 'volumes' END AS feed, pos, identity, rank, count(*) OVER (PARTITION BY "
    "genre_slug) AS total FROM merged")
def genre_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = catalog.genre_merge(_feed(spark, sf_dir), v.bestsellers(spark, sf_dir), v.TEST_RULES)
    return merged.join(catalog.merge_totals(merged), "genre_slug").select("genre_slug", "feed", "pos", "identity", "rank", "total")


@query(_MERGED + "SELECT genre_slug, identity FROM merged WHERE genre_slug <> 'sizes' UNION ALL SELECT 'sizes', " + sql_isbn13("p_partkey")
    + " FROM part WHERE p_size = 50")
def genre_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = catalog.genre_merge(_feed(spark, sf_dir), v.bestsellers(spark, sf_dir), v.TEST_RULES).select("genre_slug", "identity")
    curated = read(spark, sf_dir, "part").where("p_size = 50").select(F.lit("sizes").alias("genre_slug"), v.isbn13(F.col("p_partkey")).alias("identity"))
    return joins.genre_listing(curated, merged)


@query("SELECT l_returnflag || l_linestatus AS list_name, count(*) AS n, count(*) - 1 AS max FROM lineitem GROUP BY 1")
def list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_sizes(read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("list_name")))


_HAS = lambda c, x: f"(contains(lower({c}), '{x}'))::int"


@query(
    "WITH f AS ((SELECT *, 0 AS src FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'ring') ORDER BY 'part-' || p_partkey "
        "LIMIT 40) UNION ALL (SELECT *, 1 FROM part WHERE contains(lower(p_brand), 'red') AND contains(lower(p_brand), 'ring') ORDER BY 'part-' || "
        "p_partkey LIMIT 40)), "
    "u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY src) = 1), "
    f"s AS (SELECT *, CASE WHEN p_name = 'red ring' THEN 1000 WHEN starts_with(p_name, 'red ring') THEN 600 WHEN contains(p_name, 'red ring') THEN "
        f"400 ELSE 0 END + round(({_HAS('p_name', 'red')} + {_HAS('p_name', 'ring')}) / 2 * 200)::int + round(({_HAS('p_brand', 'red')} "
        f"+ {_HAS('p_brand', 'ring')}) / 2 * 180)::int + 20 + CASE WHEN p_size % 3 <> 0 THEN 10 ELSE 0 END AS score FROM u) "
    "SELECT 'part-' || p_partkey AS id, score, row_number() OVER (ORDER BY score DESC, src, 'part-' || p_partkey) AS rank FROM s"
)
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search as it is shown: the page of each field's results (40 rows at most), ranked together."""
    from pyspark.sql import Window

    found = search.search(v.volumes(spark, sf_dir), "Red  Ring")
    return found.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "pos")).alias("rank"))  # two pages at most


_MANY = """
WITH ask AS (SELECT DISTINCT 'name ' || split_part(p_name, ' ', 1) AS query_id, split_part(p_name, ' ', 1) AS q FROM part UNION SELECT DISTINCT 'brand ' || p_brand, p_brand FROM part UNION SELECT 'two', 'red ring'),
t AS (SELECT query_id, trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g')) AS q, string_split(lower(q), ' ') AS terms FROM ask),
b AS (SELECT 'part-' || p_partkey AS id, lower(p_name) AS title, lower(p_brand) AS author, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS nt, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS na, p_size FROM part),
f AS (SELECT query_id, id, 0 AS src FROM t, b WHERE len(list_filter(terms, lambda x: NOT contains(title, x))) = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 40
  UNION ALL SELECT query_id, id, 1 FROM t, b WHERE len(list_filter(terms, lambda x: NOT contains(author, x))) = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 40),
u AS (SELECT query_id, id, min(src) AS src FROM f GROUP BY ALL),
w AS (SELECT u.*, q, nt, na, p_size, string_split(q, ' ') AS ws FROM u JOIN t USING (query_id) JOIN b USING (id)),
s AS (SELECT *, CASE WHEN nt = q THEN 1000 WHEN starts_with(nt, q) THEN 600 WHEN contains(nt, q) THEN 400 ELSE 0 END + CASE WHEN na = q THEN 900 WHEN starts_with(na, q) THEN 550 WHEN contains(na, q) THEN 350 ELSE 0 END
  + round(len(list_filter(ws, lambda x: contains(nt, x))) / len(ws) * 200)::int + round(len(list_filter(ws, lambda x: contains(na, x))) / len(ws) * 180)::int + 20 + CASE WHEN p_size % 3 <> 0 THEN 10 ELSE 0 END AS score FROM w)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src, id) AS rank FROM s
"""


@query(_MANY)
def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for the first word of each part's name and for each brand, which are the authors, all in one plan."""
    part = read(spark, sf_dir, "part")
    word = F.split("p_name", " ")[0]
    ask = part.select(F.concat(F.lit("name "), word).alias("query_id"), word.alias("query")).union(part.select(F.concat(F.lit("brand "), "p_brand"), F.col("p_brand"))).distinct()
    ask = ask.union(spark.createDataFrame([("two", "red ring")], "query_id string, query string"))
    return search.search_many(v.volumes(spark, sf_dir), ask)


@query("SELECT 'part-' || p_partkey AS id, p_name AS title FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_brand), 'bra')")
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by title and author through the trigram index."""
    index = SearchIndex(spark, work_dir(spark, "search-index"))
    index.build(v.volumes(spark, sf_dir), rows=1000)
    return index.search(intitle="ring", inauthor="bra", limit=False).select("id", "title")


@query("SELECT p_partkey, n AS readinglog_count FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey "
    "WHERE p_type = 'ECONOMY' ORDER BY n DESC, 'part-' || p_partkey LIMIT 60")
def popular_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    readers = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pos")).agg(F.count("*").alias("readinglog_count"))
    return search.popular_by_subject(v.volumes(spark, sf_dir).join(readers, "pos"), "economy").select(F.col("pos").alias("p_partkey"), "readinglog_count")
