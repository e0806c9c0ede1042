"""DuckDB SQL with the rows of the queries that SQL can express on whole tables.

Left out: learned models (6, 7, 10), estimates by repeated steps (3), flows (4), graph scores (5) and markup (9); of 3, 4 and 5 it has the columns that SQL can express.
"""

from __future__ import annotations

from .mixing import BUDGET, MOST_COPIES, WEIGHTS

_LOWER = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + (i // 4) * 5, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int), 1)), '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM m
"""

_WORDS = "regexp_extract_all(" + _LOWER.format(c="coalesce(text, '')") + ", '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS g FROM items, unnest(range(greatest(1, len(w) - 9))) AS t(i) WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT r, i, k, array_to_string(w[i + 1 : i + k], ' ') AS g FROM docs, (SELECT DISTINCT k FROM windows), unnest(range(len(w) - k + 1)) AS t(i)),
hits AS (SELECT r, i, grams.k AS k, item_id FROM grams JOIN windows USING (k, g)),
n AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT r, i, k FROM hits), unnest(range(k)) AS t(j) GROUP BY r),
f AS (SELECT r, count(*) AS n_items, string_agg(item_id::varchar, ',' ORDER BY item_id::varchar) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN n USING (r) LEFT JOIN f USING (r)
"""

JACCARD = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER.format(c="coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM w, unnest(range(greatest(1, len(w) - 4))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
names AS (SELECT doc_id, any_value(n) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS name FROM s JOIN sizes USING (doc_id) GROUP BY doc_id),
classes AS (SELECT name, min(doc_id) AS rep, any_value(n) AS n FROM names GROUP BY name),
cs AS (SELECT rep, n, g FROM classes JOIN s ON rep = doc_id),
pairs AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS common FROM cs a JOIN cs b ON a.g = b.g AND a.rep < b.rep AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 75 * (total - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT rep, rep FROM classes UNION SELECT r.a, e.b FROM r JOIN both_ways e ON r.b = e.a) SELECT a, min(b) AS root FROM r GROUP BY a)
SELECT w.doc_id, coalesce(names.n, 0) AS n_shingles, coalesce(root, w.doc_id) AS component_id FROM w LEFT JOIN names USING (doc_id) LEFT JOIN classes ON names.name = classes.name LEFT JOIN reach ON rep = a
"""


#: Shares of quotas: the water level at which targets, none above MOST_COPIES times its source, use up the budget.
TARGETS = f"""
WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
src AS (SELECT s, sum(size)::bigint AS source_size, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY s) - 1) % {len(WEIGHTS)} + 1] AS weight FROM d GROUP BY s),
full_from AS (SELECT *, {MOST_COPIES} * source_size / weight AS level FROM src),
levels AS (SELECT *, sum({MOST_COPIES} * source_size) OVER (ORDER BY level, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS capped, sum(weight) OVER (ORDER BY level DESC, s DESC) AS open_weight FROM full_from),
water AS (SELECT level, s, {BUDGET} * (SELECT sum(source_size) FROM src)::double - coalesce(capped, 0) AS rest, open_weight FROM levels WHERE ({BUDGET} * (SELECT sum(source_size) FROM src) - coalesce(capped, 0)) / open_weight <= level ORDER BY level, s LIMIT 1),
goal AS (SELECT f.s, source_size, CASE WHEN f.level < w.level OR (f.level = w.level AND f.s < w.s) THEN {MOST_COPIES} * source_size ELSE w.rest * weight / open_weight END::double AS target FROM full_from f, water w)
SELECT doc_id, d.size::bigint AS size, source_size, target FROM d JOIN goal USING (s)
"""

_BASE = {"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "ip": "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+", "card": "[0-9](?:[ -]?[0-9])+",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]"}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN substr({_DIGITS}, i::int, 1)::int ELSE (2 * substr({_DIGITS}, i::int, 1)::int) // 10 + (2 * substr({_DIGITS}, i::int, 1)::int) % 10 END)) % 10 = 0"
_VALID = {"email": "true", "ip": "list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND ('0' || right(p, "
    "4))::int <= 255))", "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}", "phone": f"length({_DIGITS}) BETWEEN 10 AND 15"}


def _kind(rank: int, kind: str) -> str:
    """Matches of a kind by row, in order: the gaps between them and they themselves, in turn, give their places."""
    return f"""
f{rank} AS (SELECT r, regexp_extract_all(t, '{_BASE[kind]}') AS f, string_split_regex(t, '{_BASE[kind]}') AS g FROM d),
m{rank} AS (SELECT r, unnest(f) AS v, unnest(g[1:len(f)]) AS gap, unnest(range(len(f))) AS i FROM f{rank}),
p{rank} AS (SELECT r, v, (sum(length(gap) + length(v)) OVER (PARTITION BY r ORDER BY i))::bigint AS e FROM m{rank}),
k{rank} AS (SELECT r, {rank} AS rank, '{kind}' AS kind, e - length(v) AS s, e FROM p{rank} WHERE {_VALID[kind]}),"""


PERSONAL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),{"".join(_kind(i, k) for i, k in enumerate(_BASE))}
x AS (FROM k0 UNION ALL FROM k1 UNION ALL FROM k2 UNION ALL FROM k3),
n AS (SELECT r, {", ".join(f"count(*) FILTER (WHERE rank = {i}) AS n_{k}" for i, k in enumerate(_BASE))}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS l FROM x GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _BASE)}, sha256(coalesce(l, '')) AS base_sha256 FROM d LEFT JOIN n USING (r)
"""

#: Words under repeated 5-word windows: a window that occurs before or after in its text covers five places.
STATISTICS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i + 1 : i + 5], ' ') AS x FROM d, unnest(range(len(w) - 4)) AS u(i)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(5) AS u(j) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
b AS (SELECT doc_id, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN l USING (r) LEFT JOIN c USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b
"""

_TERMS = "regexp_extract_all(" + _LOWER.format(c="coalesce(text, '')") + ", '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
size AS (SELECT r, doc_id, len(w)::bigint AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*)::bigint AS docs, sum(n)::bigint AS length FROM size),
tf AS (SELECT r, t, count(*)::bigint AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
asked AS (SELECT q, item_id, unnest(list_distinct(w)) AS t FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark))),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM tf, total WHERE t IN (SELECT t FROM asked) GROUP BY t),
scores AS (SELECT q, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::bigint AS score FROM asked JOIN tf USING (t) JOIN weights USING (t) JOIN size USING (r), total GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r))::int AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b))::int AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5
"""
