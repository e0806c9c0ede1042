"""Mixing overlapping sources to target weights by min-cost flow.

A text that several sources hold overlaps: its membership pattern is the set of its sources. Patterns are summed up (words of different texts, and words
of each source's documents). On the driver, a flow network routes each pattern's words to the quotas of its sources: the first use of a text is
free, each further one, by whatever source, costs more (convex), so repetition is used only where single uses can't fill a quota, and a source takes
shared texts only where others don't need them more. All patterns take part, however many there are and however many sources hold a text. The driver gets a
few numbers for each cell (pattern and source), never documents or texts; rows carry the digest of their pattern, not its sources. More than MAX_SOURCES
sources are an error, as a network of that size needs another solver.

The documents of a pattern in a source are a cell. All of a cell take its whole copies; those below a threshold on a seeded hash take one more. The
threshold comes from two histograms of sizes over hash digits (never a sorted group). What the cells of a source fall short of goes to the one with most room, whose rest is
filled by the largest documents that fit. If the source is still short of its quota by more than TOLERANCE it goes on past what didn't fit: thresholds are set anew over the documents left that
fit, until none fits. If that isn't enough (small documents can't stand in for a long one), its choice is drawn again behind its largest document that fits, and the better
one is kept. What a document takes depends on its own row and its cell's thresholds alone, so the choice is applied without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from itertools import cycle

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import divided, table

WEIGHTS, BUDGET, MOST_COPIES, MAX_SOURCES, FILLS = (3.0, 1.0, 2.0), 1.5, 2, 50_000, 4
#: Plans of up to so many cells are broadcast (about 150 bytes each); more are joined by shuffle.
MAX_BROADCAST = 100_000
#: The part of its quota that a source may be short of without another search.
TOLERANCE = 0.01
_DIGITS = 3
#: So many uses of a text each cost one more than the one before.
STEPS = 64
#: So many cells of a source, those with most room, make up for what the others fall short of.
TURNS = 3


def n_words(text: Column) -> Column:
    """Runs of anything but white space (0x20, 0x09 to 0x0D); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_key(source: Column) -> Column:
    """Sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(sizes: dict[str, int], total: int, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST_COPIES) -> dict[str, float]:
    """Quotas by weight of budget x total tokens; none above `most` times its source's size, the excess reshared by weight."""
    names = sorted(sizes)
    weight = dict(zip(names, cycle(weights), strict=False))
    out: dict[str, float] = {}
    rest, open_ = budget * total, names
    while open_:
        whole = sum(weight[s] for s in open_)
        full = [s for s in open_ if rest * weight[s] / whole > most * sizes[s]]
        if not full:
            out |= {s: rest * weight[s] / whole for s in open_}
            break
        for s in full:
            out[s] = float(most * sizes[s])
        rest -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


Pattern = tuple[str, ...]


def route(words: dict[Pattern, int], rows: dict[tuple[Pattern, str], int], quota: dict[str, int], most: int = MOST_COPIES) -> dict[tuple[Pattern, str], int]:
    """flows() by names: words of a pattern's different texts, words of a cell's documents, and the words that each cell (pattern and source) gives."""
    patterns, sources, cells = {p: i for i, p in enumerate(words)}, {s: i for i, s in enumerate(quota)}, list(rows)
    got = flows(list(words.values()), list(quota.values()), [patterns[p] for p, _ in cells], [sources[s] for _, s in cells], list(rows.values()), most)
    return dict(zip(cells, got, strict=True))


def flows(words: list[int], quota: list[int], pattern: list[int], source: list[int], rows: list[int], most: int = MOST_COPIES) -> list[int]:
    """Min-cost flow from patterns to sources: the words that each cell, numbered like its pattern, source and rows, gives.

    words: of a pattern's different texts; a pattern's first so many words cost nothing, each further lot one more than the lot before. rows: words of a cell's
    documents, which give `most` times as much at most. From STEPS lots on, costs rise with each doubling only, so that a text which is repeated a million times takes few
    rounds. Costs grow with the lot and are the same for all patterns, so cheapest paths first means: raise every pattern's supply by one lot at a time, and send along
    shortest augmenting paths (over given-back flow too) until there are none. All paths of one length go at once (blocking flows), so the work is cells times lengths.
    """
    most_of = [most * n for n in rows]
    flow, given, need, room = [0] * len(rows), [0] * len(words), list(quota), [0] * len(words)
    of_pattern: list[list[int]] = [[] for _ in words]
    of_source: list[list[int]] = [[] for _ in quota]
    for c, (p, s) in enumerate(zip(pattern, source, strict=True)):
        of_pattern[p].append(c)
        of_source[s].append(c)
        room[p] += most_of[c]
    lots, live = 0, [p for p, n in enumerate(words) if n > 0 and room[p] > 0]
    spare = [0] * len(words)
    while live and any(x > 0 for x in need):
        lots = lots + 1 if lots < STEPS else 2 * lots
        for p in live:
            spare[p] = lots * words[p] - given[p]
        while near := _distances(spare, need, pattern, source, most_of, flow, of_pattern, of_source):
            _send(*near, spare, need, given, pattern, source, most_of, flow, of_pattern, of_source)
        if all(spare[p] > 0 for p in live):
            break  # more supply would help none
        live = [p for p in live if given[p] < room[p]]
    return flow


def _distances(spare, need, pattern, source, most_of, flow, of_pattern, of_source) -> tuple[dict[int, int], dict[int, int], list[int]] | None:
    """Lengths of the shortest paths of patterns and of sources to a need, as far as the first patterns with spare words, and those patterns; None if none gets there."""
    at_source = {s: 0 for s, n in enumerate(need) if n > 0}
    at_pattern: dict[int, int] = {}
    edge, length = list(at_source), 0
    while edge:
        reached = []
        for s in edge:
            for c in of_source[s]:
                if (p := pattern[c]) not in at_pattern and flow[c] < most_of[c]:
                    at_pattern[p] = length + 1
                    reached.append(p)
        if first := sorted(p for p in reached if spare[p] > 0):
            return at_pattern, at_source, first
        edge = []
        for p in reached:
            for c in of_pattern[p]:
                if (s := source[c]) not in at_source and flow[c] > 0:
                    at_source[s] = length + 2
                    edge.append(s)
        length += 2
    return None


def _send(at_pattern, at_source, first, spare, need, given, pattern, source, most_of, flow, of_pattern, of_source) -> None:
    """A blocking flow: along shortest paths until each is cut. A path is cells by turns: one gives more, the next gives back what its source had of another pattern."""
    next_p, next_s = dict.fromkeys(at_pattern, 0), dict.fromkeys(at_source, 0)
    for start in first:
        path: list[int] = []
        while spare[start] > 0:
            if len(path) % 2 == 0:  # at a pattern, which looks for a source that is nearer
                p = pattern[path[-1]] if path else start
                cells, i = of_pattern[p], next_p[p]
                while i < len(cells) and not (flow[c := cells[i]] < most_of[c] and at_source.get(source[c], -1) == at_pattern[p] - 1):
                    i += 1
                next_p[p] = i
                if i < len(cells):
                    path.append(cells[i])
                elif path:
                    path.pop()
                    next_s[source[path[-1]]] += 1
                else:
                    break
                continue
            s = source[path[-1]]
            if at_source[s] == 0:
                if need[s] <= 0:
                    next_p[pattern[path.pop()]] += 1
                    continue
                x = min(spare[start], need[s], *(flow[c] if i % 2 else most_of[c] - flow[c] for i, c in enumerate(path)))
                for i, c in enumerate(path):
                    flow[c] += -x if i % 2 else x
                spare[start] -= x
                given[start] += x
                need[s] -= x
                path = []
                continue
            cells, i = of_source[s], next_s[s]
            while i < len(cells) and not (flow[c := cells[i]] > 0 and at_pattern.get(pattern[c], -1) == at_source[s] - 1):
                i += 1
            next_s[s] = i
            if i < len(cells):
                path.append(cells[i])
            else:
                next_p[pattern[path.pop()]] += 1


def pattern_of(sources: Column) -> Column:
    """A digest of the set of sources that hold a text; null if it is only one."""
    return F.when(F.size(F.array_distinct(sources)) > 1, F.md5(F.to_json(F.array_sort(F.array_distinct(sources)))))


def cell_of(pattern: Column, source: Column) -> Column:
    """One string for a cell: its source, and the digest of its pattern."""
    return F.to_json(F.array(source, F.coalesce(pattern, F.lit(""))))


def _with_cell(sized: DataFrame, seed: int) -> DataFrame:
    pattern = F.col("pattern") if "pattern" in sized.columns else pattern_of(F.col("sources"))
    return sized.withColumn("pattern", pattern).withColumn("cell", cell_of(F.col("pattern"), F.col("source"))).withColumns(dict(zip(("hash", "h1", "h2"),
        _digits(seed), strict=True)))


def _small(cells: DataFrame, n: int) -> DataFrame:
    """A table with a row for each of n cells as the side of a join: broadcast if it is small."""
    return F.broadcast(cells) if n <= MAX_BROADCAST else cells


def plan(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST_COPIES, seed: int = 0, redraw: bool = True) -> DataFrame:
    """Of a table with columns row (what tells rows apart), source, pattern (or sources, the keys of all sources that hold the text), text (its digest) and size: a row for each cell with what its documents take.

    Columns: cell, source_size, target, copies, d1, d2 (hash digits below which one copy more is taken), extra (rows' digests with one
    more), more (size limits, each with hash digits of its own, below which documents up to the limit take one more). Without `redraw` no choice is drawn again (see above).
    """
    spark = sized.sparkSession
    base = _with_cell(sized, seed).select("source", "pattern", "text", "size", "cell", "hash", "h1", "h2")
    cells = base.groupBy("cell").agg(F.first("source").alias("source"), F.first("pattern").alias("pattern"), F.sum("size").alias("size")).orderBy("cell").toArrow()
    texts = base.where("text is not null").groupBy("text", F.coalesce("pattern", F.concat(F.lit("="), "source")).alias("pattern")).agg(F.max("size").alias("size"))
    different = texts.groupBy("pattern").agg(F.sum("size").alias("size")).toArrow()
    names, source_of, size_of = (cells[c].to_pylist() for c in ("cell", "source", "size"))
    pattern_of_cell = [p or f"={s}" for p, s in zip(cells["pattern"].to_pylist(), source_of, strict=True)]
    words = dict.fromkeys(pattern_of_cell, 0) | dict(zip(different["pattern"].to_pylist(), different["size"].to_pylist(), strict=True))
    rows_of, source = dict(zip(names, size_of, strict=True)), dict(zip(names, source_of, strict=True))
    sizes: dict[str, int] = defaultdict(int)
    for s, size in zip(source_of, size_of, strict=True):
        sizes[s] += size
    goal = targets(sizes, sum(sizes.values()), weights, budget, most)
    number, place = {p: i for i, p in enumerate(words)}, {s: i for i, s in enumerate(sizes)}
    flow = dict(zip(names, flows(list(words.values()), [round(goal.get(s, 0.0)) for s in sizes], [number[p] for p in pattern_of_cell], [place[s] for s in source_of],
        size_of, most), strict=True))
    rows: dict[str, list] = {}
    got: dict[str, int] = {}
    by_source: dict[str, list[str]] = defaultdict(list)
    for c in sorted(rows_of, key=lambda c: (flow[c] - most * rows_of[c], -rows_of[c], c)):
        by_source[source[c]].append(c)  # the cell with most room first

    schema = "cell string, source_size long, target double, copies int, d1 int, d2 int, left long, extra array<string>, more array<struct<cap:long,d1:int,d2:int>>"

    def small(names: Iterable[str]) -> DataFrame:
        some = [(k, *rows[k]) for k in names]
        return _small(spark.createDataFrame(some, schema), len(some))  # a row a cell

    def settle(given: dict[str, int], close: bool) -> None:
        """Lets cells give so many words, as near as whole documents allow; a cell that closes its source goes on with fills and finer searches."""
        single = {}
        for c, x in given.items():
            size = rows_of[c]
            copies = min(most, x // size) if size else 0
            single[c] = x - copies * size if copies < most else 0
            rows[c] = [sizes[source[c]], goal.get(source[c], 0.0), copies, 0, 0, single[c], [], []]
        some = [c for c in given if single[c] > 0]  # the others take whole copies only
        if not some:
            got.update({c: x - rows[c][5] for c, x in given.items()})
            return
        mine = base.join(_small(spark.createDataFrame([(k,) for k in some], "cell string"), len(some)), "cell", "left_semi")
        _thresholds(mine, rows, lambda: small(some))
        if close:
            for _ in range(FILLS):
                later = mine.join(small(some), "cell").where((F.col("size") > 0) & (F.col("size") <= F.col("left")) & ~_chosen())
                for r in later.groupBy("cell").agg(F.max(F.struct("size", "hash")).alias("best")).collect():
                    row = rows[r["cell"]]
                    row[5] -= r["best"]["size"]
                    row[6].append(r["best"]["hash"])
            _refine(mine, rows, small, single, {c: round(goal[source[c]]) for c in some}, redraw)
        for c, x in given.items():
            got[c] = x - rows[c][5]

    if shared := {c: flow[c] for cs in by_source.values() for c in cs[1:]}:
        settle(shared, close=False)
    for turn in range(TURNS):  # what small cells fall short of goes to the cell with most room, what that falls short of to the next one
        closing = {}
        for s, cs in by_source.items():
            short = round(goal[s]) - sum(got.get(c, 0) for c in cs)
            if turn < len(cs) and (turn == 0 or short > TOLERANCE * goal[s]):
                closing[cs[turn]] = min(most * rows_of[cs[turn]], got.get(cs[turn], 0) + short)
        if closing:
            settle(closing, close=True)
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], schema)


def _thresholds(base: DataFrame, rows: dict[str, list], small: Callable[[], DataFrame]) -> None:
    """Sets the hash digits of cells: as many documents in the order of their hash as fit."""
    for level, digit in enumerate(("d1", "d2")):
        inside = base.join(small().select("cell", F.col("d1").alias("at1"), "left"), "cell").where(F.col("left") > 0)
        if level:
            inside = inside.where(F.col("h1") == F.col("at1"))
        hist = inside.groupBy("cell", "left", F.col(f"h{level + 1}").alias("h")).agg(F.sum("size").alias("size"))
        by_cell = hist.groupBy("cell", "left").agg(F.array_sort(F.collect_list(F.struct("h", "size"))).alias("bins"))  # 4,096 bins at most
        for r in _walked(by_cell).collect():
            row = rows[r["cell"]]
            row[3 + level] = r["at"]["h"] if r["at"]["h"] >= 0 else 16**_DIGITS
            row[5] = r["at"]["left"]


def _walked(by_cell: DataFrame) -> DataFrame:
    """For each cell the first bin that doesn't fit (-1: all fit), and what is left before it."""
    return by_cell.select("cell", F.aggregate("bins", F.struct(F.lit(-1).alias("h"), F.col("left").alias("left")), lambda a,
        b: F.when((a["h"] >= 0) | (b["size"] > a["left"]), F.struct(F.when(a["h"] >= 0, a["h"]).otherwise(b["h"]).cast("int").alias("h"),
        a["left"].alias("left"))).otherwise(F.struct(F.lit(-1).alias("h"), (a["left"] - b["size"]).alias("left")))).alias("at"))


def _refine(base: DataFrame, rows: dict[str, list], small: Callable[[Iterable[str]], DataFrame], single: dict[str, int], quota: dict[str, int], redraw: bool) -> None:
    """Goes on with cells whose source is short of their quota by more than TOLERANCE; `single` is what their documents are to give once more."""
    short = {p for p in quota if rows[p][5] > TOLERANCE * quota[p]}
    if not short:
        return
    _more(base, rows, small, short, quota)
    short = {p for p in short if rows[p][5] > TOLERANCE * quota[p]}
    if not short or not redraw:
        return
    before = {p: list(rows[p]) for p in short}
    for p in short:
        rows[p][3:] = [0, 0, single[p], [], []]
    first = base.join(small(sorted(short)), "cell").where((F.col("size") > 0) & (F.col("size") <= F.col("left")))
    for r in first.groupBy("cell").agg(F.max(F.struct("size", "hash")).alias("best")).collect():
        rows[r["cell"]][5] -= r["best"]["size"]
        rows[r["cell"]][6] = [r["best"]["hash"]]
    _more(base, rows, small, short, quota)
    for p in short:
        if before[p][5] <= rows[p][5]:
            rows[p][:] = before[p]


def _more(base: DataFrame, rows: dict[str, list], small: Callable[[Iterable[str]], DataFrame], names: set[str], quota: dict[str, int]) -> None:
    """Sets thresholds anew over the documents that fit into what is left, until what is left is within TOLERANCE or no round adds any."""
    going = {p for p in names if rows[p][5] > TOLERANCE * quota[p]}
    while going:
        left = {p: rows[p][5] for p in going}
        fits = base.join(small(sorted(going)), "cell").where((F.col("size") > 0) & (F.col("size") <= F.col("left"))
            & ~_chosen()).select("cell", "size", "h1", "h2")
        at: dict[str, list[int]] = {}
        for level in (1, 2):
            spark = base.sparkSession
            now = _small(spark.createDataFrame([(p, at.get(p, [0])[0], rows[p][5]) for p in sorted(going)], "cell string, at1 int, left long"), len(going))
            inside = fits.join(now, "cell")
            if level == 2:
                inside = inside.where(F.col("h1") == F.col("at1"))
            hist = inside.groupBy("cell", "left", F.col(f"h{level}").alias("h")).agg(F.sum("size").alias("size"))
            for r in _walked(hist.groupBy("cell", "left").agg(F.array_sort(F.collect_list(F.struct("h", "size"))).alias("bins"))).collect():
                at.setdefault(r["cell"], []).append(r["at"]["h"] if r["at"]["h"] >= 0 else 16**_DIGITS)
                rows[r["cell"]][5] = r["at"]["left"]
        for p, digits in at.items():
            rows[p][7].append((left[p], digits[0], digits[1] if len(digits) > 1 else 0))
        going = {p for p in at if rows[p][5] < left[p] and rows[p][5] > TOLERANCE * quota[p]}


def _digits(seed: int) -> list[Column]:
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("row")))
    part = lambda i: F.conv(F.substring(h, 1 + i * _DIGITS, _DIGITS), 16, 10).cast("int")
    return [h.alias("hash"), part(0).alias("h1"), part(1).alias("h2")]


def _chosen() -> Column:
    """Whether a row joined with its cell takes one copy more."""
    below = lambda d1, d2: (F.col("h1") < d1) | ((F.col("h1") == d1) & (F.col("h2") < d2))
    return below(F.col("d1"), F.col("d2")) | F.array_contains("extra", F.col("hash")) | F.exists("more", lambda m: (F.col("size") <= m["cap"])
        & below(m["d1"], m["d2"]))


def taken(sized: DataFrame, planned: DataFrame, seed: int = 0) -> DataFrame:
    """Rows of sized (row, source, pattern or sources, size, and any other columns) with source_size, target, n_copies and taken. The plan has a row a cell."""
    copies = F.when(F.col("size") > 0, F.col("copies") + _chosen().cast("int")).otherwise(F.lit(0))
    return _with_cell(sized, seed).join(_small(planned, planned.count()), "cell").withColumn("n_copies", copies).withColumn("taken", F.col("size") * F.col(
        "n_copies")).drop("cell", "pattern", "hash", "h1", "h2", "copies", "d1", "d2", "left", "extra", "more")


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds `row`, which tells rows apart: of `digest` and, where whole rows repeat, their number. Equal rows may take each other's number, which changes no result.

    A group of equal rows is numbered within each partition first, so none goes to one task. Only rows that may repeat are shuffled.
    """
    again = table(rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("k1")), "repeated")
    named = lambda df, nth: df.withColumn("row", F.concat_ws(":", F.col("digest").cast("string"), nth.cast("string")))
    if again.isEmpty():
        return named(rows, F.lit(0))
    once, maybe = divided(rows, F.col("digest"), again)
    maybe = table(maybe.withColumn("__part", F.spark_partition_id()), "repeated-rows")
    sums = maybe.groupBy("digest", "__part").agg(F.count("*").alias("__n"))
    before = sums.withColumn("__before", F.sum("__n").over(Window.partitionBy("digest").orderBy("__part")) - F.col("__n")).drop("__n")
    inner = F.row_number().over(Window.partitionBy("digest", "__part").orderBy("digest")) - 1
    numbered = maybe.withColumn("__inner", inner).join(before, ["digest", "__part"])
    return named(once, F.lit(0)).unionByName(named(numbered, F.col("__inner") + F.col("__before")).drop("__part", "__inner", "__before"))


def _sized(docs: DataFrame, kept: list[Column]) -> DataFrame:
    """`kept`, source, text (digest; null without words), size, and `digest` of the whole row."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    size = n_words(F.col("text"))
    return docs.select(*kept, source_key(F.col("source")).alias("__source"), F.when(size > 0, F.md5("text")).alias("__text"), size.alias("__size"),
        F.xxhash64(*plain).alias("digest"))


def shared_texts(sized: DataFrame) -> DataFrame:
    """text, sources (a sorted array) and pattern of the texts that several sources hold. Sums are made on the map side; a set has MAX_SOURCES keys at most."""
    held = sized.where("text is not null").groupBy("text").agg(F.array_sort(F.collect_set("source")).alias("sources")).where(F.size("sources") > 1)
    return held.withColumn("pattern", pattern_of(F.col("sources")))


def with_patterns(sized: DataFrame, shared: DataFrame) -> DataFrame:
    """Adds `pattern` to rows with source and text: that of a shared text, else null. Only rows whose text may be a shared one are shuffled."""
    own, maybe = divided(sized, F.xxhash64("text"), shared.select(F.xxhash64("text").alias("k1")))
    return own.withColumn("pattern", F.lit(None).cast("string")).unionByName(maybe.join(shared.select("text", "pattern"), "text", "left"))


def _planned(sized: DataFrame, seed: int, redraw: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with row and pattern, the plan, the shared texts) of rows of _sized, without their `__`."""
    n = sized.agg(F.count_distinct("source")).first()[0]
    if n > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: too many for the flow network")
    shared = table(shared_texts(sized), "shared-texts")
    rows = table(with_patterns(_numbered(sized), shared), "mixing-rows")
    return rows, plan(rows, seed=seed, redraw=redraw), shared


_NAMES = {"__source": "source", "__text": "text", "__size": "size"}


def mix(docs: DataFrame, seed: int = 0, redraw: bool = True, names: bool = True) -> DataFrame:
    """What a mix takes of each document: id, source (its key), size, source_size, target, n_copies, taken and, with `names`, sources (of all that hold its text).

    A null or empty text has size 0 and is never taken. A null source is a source of its own, the last. Rows are told apart by all their columns, and whole
    rows that repeat by a number, so repeated and null ids are taken apart like others. An empty table gives an empty one. Very long texts are one document
    like others, taken whole or not.
    """
    sized = table(_sized(docs, [F.col("doc_id").alias("id")]).withColumnsRenamed(_NAMES), "mixing")
    rows, planned, shared = _planned(sized, seed, redraw)
    if names:
        rows = rows.join(shared.select("text", "sources"), "text", "left").withColumn("sources", F.coalesce("sources", F.array("source")))
    return taken(rows, planned, seed).drop("row", "text", "digest")


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents that a mix takes, with all their columns, and how often (`copies`; a column of that name in docs is left out)."""
    columns = [c for c in docs.columns if c.lower() != "copies"]
    light = table(_sized(docs, []).withColumnsRenamed(_NAMES), "mixing")
    _, planned, shared = _planned(light, seed)
    whole = F.struct(*columns).alias("doc")
    rows = with_patterns(_numbered(_sized(docs, [whole]).withColumnsRenamed(_NAMES)), shared)
    return taken(rows, planned, seed).where(F.col("taken") > 0).select("doc.*", F.col("n_copies").alias("copies"))
