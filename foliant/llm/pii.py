"""Personal data and secrets by expressions and by bootstrapped contexts, with DataFrame operations only.

Seeds are what expressions are sure of: the base entities (e-mail, IP, card, phone) and long keys that mix letters and digits (secret). Candidates are of no
kind and of any form: runs of tokens with a digit or an at sign that are no seeds. Each mention of either gives lexical patterns, the one to three
tokens before it and the one or two behind it. On the graph of patterns and instances Spark iterates: a pattern's confidence in a kind is the share
of its instances that are seeds of that kind or (with their score) accepted ones; patterns with CONFIDENCE and with SUPPORT different seeds accept the candidates
beside them whose characters agree with the seeds of the kind; an accepted instance's score is the best confidence of its patterns. Accepted instances are
found wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import table

KINDS = ("email", "ip", "card", "phone")
#: The kinds of spans, in the order in which they are listed.
LISTED = (*KINDS, "secret")
#: The base expressions, with possessive forms that match the same and can't run away on long runs of one class.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Keys of 16 characters or more in which letters and digits change places at least twice, and a cloud provider's key ids.
SECRET = r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|(?=[A-Za-z]*+[0-9]++[A-Za-z]++[0-9])[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])"
#: What stands for the characters of a seed where candidates are looked for.
_FILL = "\u0001"
_INSIDE = r"[^\s\x01\"'=<>,;|]"
#: One or more tokens with a digit or an at sign, a space between them.
CANDIDATE = r"(?<!{c})(?:{n}*+[0-9@]{c}*+)(?: {n}*+[0-9@]{c}*+)*+".format(c=_INSIDE, n=_INSIDE[:-1] + "0-9@]")
_TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
#: CONTEXT: so many code points beside a mention are read for its patterns.
CONFIDENCE, SUPPORT, ROUNDS, CONTEXT = 0.9, 8, 5, 64
_OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"
_MENTIONS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string,left:string,right:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, zero: int, join: Callable[[Column, Column], Column], chunk: int = 256) -> Column:
    """The values up to each one joined: within chunks, then over chunks, as appending to one long array would cost its square."""
    start = F.array(F.lit(zero).cast("bigint"))
    add = lambda a, x: F.array_append(a, join(F.element_at(a, -1), x))
    chunks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / chunk).cast("int"))
    inner = F.transform(chunks, lambda c: F.aggregate(F.slice(values, c * chunk + 1, chunk), start, add))

    def whole(parts: Column) -> Column:
        before = F.aggregate(parts, start, lambda a, w: add(a, F.element_at(w, -1)))
        return _let(before, lambda b: F.flatten(F.transform(parts, lambda w, c: F.transform(F.slice(w, 2, chunk), lambda x: join(F.get(b, c), x)))))

    return F.when(F.size(values) > 0, _let(inner, whole)).otherwise(F.array().cast("array<bigint>"))


def _mentions(text: Column, kind: str | None, pattern: str, beside: bool = True) -> Column:
    """Matches of a pattern with their places in code points (gaps between matches and matches, summed up) and, if wanted, the line's text beside them."""
    rank = F.lit(LISTED.index(kind) if kind else len(LISTED))

    def one(v: Column, i: Column, gaps: Column, ends: Column) -> Column:
        end = F.get(ends, i)
        span = [(end - F.length(v)).alias("start"), rank.alias("rank"), end.alias("end"), F.lit(kind).cast("string").alias("kind"), v.alias("value")]
        if beside:
            before = F.concat(F.when(i > 0, F.lit(_FILL)).otherwise(F.lit("")), F.right(F.get(gaps, i), F.lit(CONTEXT)))
            behind = F.left(F.get(gaps, i + 1), F.lit(CONTEXT))
            span += [F.substring_index(before, "\n", -1).alias("left"), F.substring_index(behind, "\n", 1).alias("right")]
        return F.struct(*span)

    def placed(x: Column) -> Column:
        sizes = F.transform(x["f"], lambda v, i: (F.length(v) + F.length(F.get(x["g"], i))).cast("bigint"))
        return _let(_running(sizes, 0, lambda a, b: a + b), lambda ends: F.transform(x["f"], lambda v, i: one(v, i, x["g"], ends)))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f"), F.split(text, pattern, -1).alias("g"))
    return _let(both, placed).cast(_MENTIONS if beside else _SPANS)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.rlike(_OCTET))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _needs(text: Column, kind: str) -> Column:
    """A cheap test that a text without passes by."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][ -]?[0-9]"), "phone": text.contains("+")}[kind]


def _none(kind: str = _MENTIONS) -> Column:
    return F.array().cast(kind)


def _base(text: Column, beside: bool) -> Column:
    none = _none(_MENTIONS if beside else _SPANS)

    def one(k: str) -> Column:
        return F.when(_needs(text, k), F.filter(_mentions(text, k, BASE[k], beside), lambda s: _valid(k, s["value"]))).otherwise(none)

    return F.when(text.rlike("[0-9@]"), F.sort_array(F.concat(*[one(k) for k in KINDS]))).otherwise(none)


def _plain(mentions: Column) -> Column:
    """Mentions as spans, without the text beside them."""
    return F.transform(mentions, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "value")])).cast(_SPANS)


def base_spans(text: Column) -> Column:
    """All base entities of a text, by start, then kind."""
    return _base(text, beside=False)


def _covered(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """The text with the characters of valid matches replaced, each by one."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f"), F.split(text, pattern, -1).alias("g"))
    fill = lambda v: F.when(valid(v), F.repeat(F.lit(_FILL), F.length(v))).otherwise(v)
    return _let(both, lambda x: F.array_join(F.transform(x["g"], lambda g, i: F.concat(g, F.coalesce(fill(F.get(x["f"], i)), F.lit("")))), ""))


def _without(text: Column, kind: str) -> Column:
    """The text without the base entities of a kind, if `base` has some."""
    return F.when(F.exists("base", lambda s: s["kind"] == kind), _covered(text, BASE[kind], lambda v: _valid(kind, v))).otherwise(text)


def _trimmed(m: Column) -> Column:
    """A candidate without the punctuation around it."""
    lead = F.length(m["value"]) - F.length(F.regexp_replace(m["value"], r"^(?:[^\p{L}\p{N}(+]|\((?=[^)]*$))*+", ""))
    tail = F.length(m["value"]) - F.length(F.regexp_replace(m["value"], r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", ""))
    value = m["value"].substr((lead + 1).cast("int"), (F.length(m["value"]) - lead - tail).cast("int"))
    return F.struct(
        (m["start"] + lead).alias("start"), m["rank"].alias("rank"), (m["end"] - tail).alias("end"), m["kind"].alias("kind"), value.alias("value"),
        F.concat(m["left"], F.left(m["value"], lead)).alias("left"), F.concat(F.right(m["value"], tail), m["right"]).alias("right"),
    )


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"[^0-9]", ""))


def _letters(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"[^\p{L}]", ""))


def _ats(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit("@"), F.lit("")))


def with_mentions(rows: DataFrame, text: str) -> DataFrame:
    """Adds `base` and `sure` (secrets), the seeds, and `loose`, the candidates, of the column text (not null), as mentions. No shuffle."""
    kept, t = rows.columns, F.col(text)
    rows = rows.withColumn("base", _base(t, beside=True))
    rest = t
    for k in KINDS:  # what is valid in itself is covered, kind by kind
        rows = rows.withColumn("__rest", _without(rest, k))
        rest = F.col("__rest")
    rows = rows.withColumn("sure", F.when(rest.rlike("[A-Za-z0-9]{16}"), _mentions(rest, "secret", SECRET)).otherwise(_none()))
    rows = rows.withColumn("__rest", F.when(F.size("sure") > 0, _covered(rest, SECRET, lambda v: F.lit(True))).otherwise(rest))
    likely = lambda m: (_digits(m["value"]) >= 4) | (_ats(m["value"]) > 0)
    found = F.filter(F.transform(F.filter(_mentions(rest, None, CANDIDATE), likely), _trimmed), likely).cast(_MENTIONS)
    rows = rows.withColumn("loose", F.when(rest.rlike(r"@|(?:[0-9][^0-9]{0,8}){4}"), found).otherwise(_none()))
    # one row each: conditions on what is found aren't pushed below this, where all of it would be found again for them
    return rows.select(*kept, F.inline(F.array(F.struct("base", "sure", "loose"))))


def _patterns(m: Column) -> Column:
    """The lexical patterns of a mention: tokens before it (marked <) and behind it (>), in lower case."""
    left, right = (F.regexp_extract_all(F.lower(m[side]), F.lit(_TOKEN), F.lit(0)) for side in ("left", "right"))

    def named(t: Column, mark: str, most: int, start) -> Column:
        one = lambda n: F.when(F.size(t) >= n, F.concat(F.lit(mark), F.array_join(F.slice(t, start(n), n), " ")))
        return F.array(*[one(n) for n in range(1, most + 1)])

    before = _let(left, lambda t: named(t, "<", 3, lambda n: F.lit(-n)))
    behind = _let(right, lambda t: named(t, ">", 2, lambda n: F.lit(1)))
    return F.filter(F.concat(before, behind), lambda p: p.isNotNull())


def _instance(value: Column) -> Column:
    """What makes two mentions the same identifier."""
    return F.when(value.rlike(r"[\p{L}@]"), F.regexp_replace(F.lower(value), r"\s", "")).otherwise(F.regexp_replace(value, "[^0-9.:]", ""))


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, `th` (a digest of the text), `base`, `sure` and `loose` as spans, and `edges`: kind (null for candidates), instance, value and patterns of each mention. No shuffle."""
    rows = with_mentions(docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t")), "__t")
    known = lambda m: F.struct(m["kind"].alias("kind"), _instance(m["value"]).alias("instance"), m["value"].alias("value"),
        _patterns(m).alias("patterns"))
    every = F.concat("base", "sure", "loose")
    rows = rows.withColumn("edges", F.when(F.size(every) > 0, F.transform(every, known)))
    return rows.withColumns({"base": _plain(F.col("base")), "sure": _plain(F.col("sure")), "loose": _plain(F.col("loose")), "th": F.md5("__t")}).drop("__t")


def _agrees(bounds: dict[str, tuple]) -> Column:
    """Whether a row's candidate is made of as many digits, letters and at signs as seeds of its kind, or up to half or twice as many."""
    out = F.lit(False)
    for kind, (d0, d1, l0, l1, a0, a1) in bounds.items():
        fits = F.col("digits").between(d0 // 2, 2 * d1) & F.col("letters").between(l0 // 2, 2 * l1) & F.col("ats").between(a0, a1)
        out = out | ((F.col("kind") == kind) & fits)
    return out


def graph(scanned: DataFrame) -> DataFrame:
    """The distinct edges of patterns and instances: pattern, kind (null for candidates), instance, digits, letters, ats. Summed on the map side."""
    rows = scanned.where("edges is not null").select(F.explode("edges").alias("e")).select("e.kind", "e.instance", F.col("e.value").alias("v"),
        F.explode("e.patterns").alias("pattern"))
    return rows.groupBy("pattern", "kind", "instance").agg(F.min(_digits(F.col("v"))).alias("digits"), F.min(_letters(F.col("v"))).alias("letters"),
        F.min(_ats(F.col("v"))).alias("ats"))


def accepted_patterns(edges: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, confidence) of the accepted patterns and (kind, instance, score) of the candidates that they accept, after the last round that accepts more, or `rounds`."""
    seeds = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= support)
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    able = table(seeds.join(sizes, "pattern"), "pii-able")
    least_most = [f(c).alias(f"{c}{i}") for c in ("digits", "letters", "ats") for i, f in enumerate((F.min, F.max))]
    bounds = {r["kind"]: tuple(r)[1:] for r in edges.where("kind is not null").groupBy("kind").agg(*least_most).collect()}  # a row a kind
    open_ = edges.where("kind is null").drop("kind").join(able, "pattern").where(_agrees(bounds))
    open_ = table(open_.select("pattern", "kind", "instance"), "pii-open")
    scores, before = None, -1
    for _ in range(rounds):
        won = F.lit(0.0)
        now = able
        if scores is not None:
            gained = open_.join(scores, ["kind", "instance"]).groupBy("pattern", "kind").agg(F.sum("score").alias("gained"))
            now, won = able.join(gained, ["pattern", "kind"], "left"), F.coalesce("gained", F.lit(0.0))
        good = table(now.select("pattern", "kind", F.round((F.col("seeds") + won) / F.col("n"), 9).alias("confidence")).where(
            F.col("confidence") >= confidence), "pii-patterns")
        scores = table(open_.join(good, ["pattern", "kind"]).groupBy("kind", "instance").agg(F.max("confidence").alias("score")), "pii-scores")
        count = scores.count()
        if count == before:
            break
        before = count
    return good, scores


def discovered(scanned: DataFrame, **options) -> DataFrame:
    """Candidates that accepted patterns have found: instance and its best kind."""
    _, scores = accepted_patterns(table(graph(scanned), "pii-edges"), **options)
    order = F.create_map(*[F.lit(x) for i, k in enumerate(LISTED) for x in (k, -i)])
    return scores.groupBy("instance").agg(F.max_by("kind", F.struct("score", order[F.col("kind")])).alias("found"))


def held_back(docs: DataFrame, text: str = "text", share: float = 0.05, **options) -> DataFrame:
    """How well contexts find what expressions don't know: of each kind a share of the seeds (by hash) loses its kind, and the rest bootstraps. What is hidden counts against
    its patterns, so a share near 1 - CONFIDENCE or above it hides all contexts too.

    kind, seeds, hidden, reachable (hidden ones that stand in a context which the other seeds get accepted) and found (hidden ones that are accepted as their kind).
    """
    edges = table(graph(scan(docs, [], text)), "pii-edges")
    hide = F.col("kind").isNotNull() & (F.pmod(F.xxhash64("kind", "instance"), F.lit(1_000)) < int(share * 1_000))
    blind = edges.withColumn("kind", F.when(~hide, F.col("kind")))
    blind = blind.groupBy("pattern", "kind", "instance").agg(*[F.min(c).alias(c) for c in ("digits", "letters", "ats")])
    good, scores = accepted_patterns(table(blind, "pii-blind"), **options)
    seeds = edges.where("kind is not null").select("kind", "instance", hide.alias("hidden")).distinct()
    near = edges.where(hide).join(good.select("pattern", "kind"), ["pattern", "kind"], "left_semi").select("kind", "instance").distinct()
    yes = lambda df, name: df.select("kind", "instance").distinct().withColumn(name, F.lit(True))
    both = seeds.join(yes(near, "near"), ["kind", "instance"], "left").join(yes(scores, "won"), ["kind", "instance"], "left")
    count = lambda c, name: F.count_if(F.col("hidden") & c).alias(name)
    return both.groupBy("kind").agg(F.count("*").alias("seeds"), count(F.lit(True), "hidden"), count(F.col("near"), "reachable"), count(F.col("won"), "found"))


def found_spans(docs: DataFrame, keep: list[str], text: str = "text", **options) -> DataFrame:
    """`keep`, base (array of spans) and spans (base ones, secrets and discovered ones; start, rank, end, kind, value; by start, then kind, then end).

    Whole texts are read; a null text counts as empty and has no spans. Positions are code points, end exclusive. Repeated rows get the same spans; an
    empty table gives an empty one. Base kinds are looked for apart, so their spans may overlap; secrets and discovered spans don't overlap base spans but
    where base spans of two kinds overlap. Very long texts with many spans cost little more than their length.
    """
    source = docs.select(*keep, F.col(text).cast("string").alias("__text"), F.struct(*keep).alias("__row"))
    scanned = table(scan(source, ["__row"], "__text"), "pii-scan")
    added = added_spans(scanned, table(discovered(scanned, **options), "pii-found"))
    sure = F.sort_array(F.concat("base", "sure"))
    plain = scanned.where(F.size("loose") == 0).select("__row.*", "base", sure.alias("spans"))
    rest = scanned.where(F.size("loose") > 0).join(added, "th", "left")
    return plain.unionByName(rest.select("__row.*", "base", F.sort_array(F.concat("base", "sure", F.coalesce("added", F.array().cast(_SPANS)))).alias("spans")))


def added_spans(scanned: DataFrame, found: DataFrame) -> DataFrame:
    """Spans of discovered instances for each distinct text that has some: th, added."""
    texts = scanned.where(F.size("loose") > 0).groupBy("th").agg(F.first("loose").alias("loose"))
    mentions = texts.select("th", F.explode("loose").alias("s")).withColumn("instance", _instance(F.col("s.value"))).join(found, "instance")
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(LISTED) for x in (k, i)])
    span = F.struct(F.col("s.start").alias("start"), rank[F.col("found")].alias("rank"), F.col("s.end").alias("end"), F.col("found").alias("kind"),
        F.col("s.value").alias("value"))
    return mentions.groupBy("th").agg(F.collect_list(span).cast(_SPANS).alias("added"))  # no more than a text has


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the kind of its first one in brackets."""
    block = 1024  # the text is cut into blocks first: to count off characters from its start for each span would cost the square of its length

    def cut(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / block).cast("int")
        whole = F.array_join(F.slice(blocks, first + 1, F.floor(end / block).cast("int") - first + 1), "")
        return whole.substr((start - first * block + 1).cast("int"), (end - start).cast("int"))

    def pieces(upto: Column, blocks: Column) -> Column:
        """upto: the greatest end of the spans up to each; a span that begins before it belongs to the same run."""
        before = lambda i: F.when(i > 0, F.get(upto, i - 1)).otherwise(F.lit(0))
        runs = F.filter(F.transform(spans, lambda s, i: F.struct(before(i).alias("from"), s["start"].alias("start"), s["kind"].alias("kind"))),
            lambda r: r["start"] >= r["from"])
        piece = lambda r: F.concat(cut(blocks, r["from"], r["start"]), F.lit("["), F.upper(r["kind"]), F.lit("]"))
        return F.concat(F.array_join(F.transform(runs, piece), ""), cut(blocks, F.element_at(upto, -1), F.length(text)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / block).cast("int")), lambda i: text.substr(i * block + 1, F.lit(block)))
    ends = _running(F.transform(spans, lambda s: s["end"]), -1, F.greatest)
    return F.when(F.size(spans) > 0, _let(ends, lambda e: _let(blocks, lambda b: pieces(e, b)))).otherwise(text)


def mask_documents(docs: DataFrame, text: str = "text", length: str | None = None, **options) -> DataFrame:
    """docs with personal data in the text masked and, if named, the column of its length; all other columns stay. Texts without candidates aren't shuffled. A null text stays null."""
    columns = docs.columns
    scanned = table(scan(docs, [], text), "pii-scan")
    added = table(added_spans(scanned, table(discovered(scanned, **options), "pii-found")), "pii-added")
    whole = F.struct(*columns).alias("__doc")
    rows = with_mentions(docs.select(whole, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t")), "__t")
    rows = rows.withColumn("__sure", F.concat(_plain(F.col("base")), _plain(F.col("sure")))).withColumn("__open", F.size("loose") > 0).drop("base",
        "sure", "loose")
    known = added.select(F.col("th").alias("__th"), F.col("added").alias("__added"))
    plain = rows.where(~F.col("__open")).withColumn("__all", F.sort_array("__sure"))
    rest = rows.where("__open").withColumn("__th", F.md5("__t")).join(known, "__th", "left").withColumn("__all",
        F.sort_array(F.concat("__sure", F.coalesce("__added", F.array().cast(_SPANS)))))
    both = plain.select("__doc", "__t", "__all").unionByName(rest.select("__doc", "__t", "__all"))
    hidden = F.when(F.col(f"__doc.`{text}`").isNotNull(), masked(F.col("__t"), F.col("__all")))
    out = both.select("__doc.*", hidden.alias("__hidden")).withColumn(text, F.col("__hidden")).drop("__hidden").select(*columns)
    return out.withColumn(length, F.coalesce(F.length(text), F.col(length)).cast(docs.schema[length].dataType)) if length in columns else out
