"""Jaccard self-join of 5-word shingle sets with signature trees.

1. Each text becomes the set of its shingle hashes, named by a 128-bit hash of the set; equal sets are one class from here on.
2. Candidates. All sets are read in one order of shingles: frequent ones (from a sample of documents; any choice is right) last, else by hash. Two sets
   of a similarity of 3/4 share at least a fifth of the smaller one's shingles among the first 45 % of each (see `long_prefix`). So a set stays only
   if it shares as many of its own first 45 % with any sets of a fitting size; most sets don't. Of those that stay, two similar ones share one of the
   first quarter of the larger and of the first seventh of the smaller. These rows meet by shingle, sorted by size, and each is tied to the one
   before it that may be similar by size: a chain instead of all pairs. Components of these ties are blocks; no link leaves its block.
3. Links. Sets of a block are put into a signature tree: a node holds the OR of its sets' bitmaps and their range of sizes. The tree is traversed against
   itself; pairs of nodes whose greatest possible overlap, by common bits and sizes, is too small are left out, and so are nodes that are already in one
   component. What is left is compared by the sets themselves.
4. A block above BIG shingles is cut into chunks by size class and hash. Chunks are first joined alone, then by one set a component, and of the pairs of
   chunks only those that still hold several components are traversed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import divided, drop_table, map_bits, map_texts, member_map, on_map, ship, table
from ._text import NON_SPACE, Words, mix
from .components import components

WIDTH, BIG, SAMPLE_EVERY, FREQUENT, MOST_FREQUENT = 5, 4_000_000, 32, 3, 1_000_000
LEAF, FAN = 16, 8
#: Bytes of text that are shingled at a time.
SLICE = 500_000


def sets_of(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Fewer words than `width`: the whole sequence as one; none: empty."""
    w = Words(texts, NON_SPACE, lower=True)
    grams, _ = w.grams(width)
    out = []
    for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for x in w.hash[a:b]:
                h = mix(np.array([h], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + x)[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def names_of(sets: list[np.ndarray]) -> list[tuple[int, int] | None]:
    """A 128-bit name of each set, as two signed longs; none for an empty set."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out: list[tuple[int, int] | None] = [None] * len(sets)
    if full:
        size = np.array([len(sets[i]) for i in full])
        at = np.cumsum(size) - size
        h = np.concatenate([sets[i] for i in full])
        a = mix(np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at) + size.astype(np.uint64)).view(np.int64)
        b = mix(np.add.reduceat(mix(h * np.uint64(0xDA942042E4DD58B5) + np.uint64(1)), at)).view(np.int64)
        for i, x, y in zip(full, a.tolist(), b.tolist(), strict=True):
            out[i] = (x, y)
    return out


def _each_set(width: int):
    """For a task: name and set of each distinct set of a slice that the task hasn't met before."""
    seen: set[tuple[int, int]] = set()

    def new(texts: pa.Array) -> Iterator[tuple[int, tuple[int, int], np.ndarray]]:
        sets = sets_of(texts, width)
        for i, (name, s) in enumerate(zip(names_of(sets), sets, strict=True)):
            if name is not None and name not in seen:
                seen.add(name)
                yield i, name, s

    return new


def _stream(df: DataFrame, schema: str, start) -> DataFrame:
    """mapInArrow over texts; start() gives a function from a text array to columns, once for each task."""
    from ._spark import slices

    ship(df.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        fn = start()
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                yield pa.RecordBatch.from_arrays(fn(part.column(0)), names=names)

    return df.mapInArrow(run, schema)


def named(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and the set's name k1, k2 (null for empty sets)."""

    def names(texts: pa.Array) -> dict:
        sets = sets_of(texts, width)
        both = [name or (None, None) for name in names_of(sets)]
        return {"n_shingles": np.array([len(s) for s in sets], np.int64), "k1": [x[0] for x in both], "k2": [x[1] for x in both]}

    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"], "n_shingles long, k1 long, k2 long",
        names, SLICE)


def frequent_shingles(body: DataFrame, width: int, every: int = SAMPLE_EVERY, least: int = FREQUENT, most: int = MOST_FREQUENT) -> np.ndarray:
    """Shingles found `least` times or more in one of `every` sets. `least` goes up until they are `most` at most."""

    def start():
        new = _each_set(width)

        def fn(texts):
            picked = [s for _, (k, _), s in new(texts) if k % every == 0]
            return [pa.array(np.concatenate([*picked, np.zeros(0, np.uint64)]).view(np.int64))]

        return fn

    counts = table(_stream(body, "h long", start).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least), "frequent")
    by_count = sorted(((r["n"], r["m"]) for r in counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("m")).collect()), reverse=True)
    total, cut = 0, 10_001
    for n, m in by_count:
        if total + m > most:
            break
        total, cut = total + m, n
    got = counts.where(F.col("n") >= cut).select("h").toArrow().column(0).to_numpy()
    drop_table(counts)
    return np.sort(got.view(np.uint64))


def _ordered(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A sorted set in the order of all: frequent shingles last."""
    if not len(frequent):
        return s
    late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    return np.concatenate([s[~late], s[late]])


def prefix(s: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The first quarter of a set, of which a similar set has one, and how many of them a larger set may meet."""
    n = len(s)
    return _ordered(s, frequent)[: n - (3 * n + 3) // 4 + 1], n - (6 * n + 6) // 7 + 1


def fifth(n: int) -> int:
    return 1 + n // 5


def long_prefix(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first n - ceil(3 n / 4) + fifth(n) shingles of a set of n.

    Sets a and b of a similarity of 3/4 have 3/4 of the larger in common. Say a's prefix ends first in the order. All but ceil(3 |a| / 4) - fifth(|a|) of
    what they share is in a's prefix and so in b's: fifth(|a|) shingles or more. As |b| is 3/4 of |a| or more, either set shares
    fifth(ceil(3 n / 4)) shingles of its prefix at least.
    """
    n = len(s)
    return _ordered(s, frequent)[: n - (3 * n + 3) // 4 + fifth(n)]


def _prefix_rows(body: DataFrame, width: int, frequent: np.ndarray, wanted: np.ndarray | None) -> DataFrame:
    """Rows h (shingle), n, k (first half of the name), sorted by shingle, size and name: long prefixes of all sets (n: size), or the short ones of sets that the
    map `wanted` has (n: 2 x size, + 1 for shingles that a larger set may meet)."""
    shared = body.sparkSession.sparkContext.broadcast((frequent, wanted))

    def start():
        new = _each_set(width)

        def fn(texts):
            often, names = shared.value
            h, k, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, (k1, _), s in new(texts):
                if names is None:
                    p = long_prefix(s, often)
                    n.append(np.full(len(p), len(s)))
                elif _marked(names, k1):
                    p, first = prefix(s, often)
                    n.append(2 * len(s) + (np.arange(len(p)) < first))
                else:
                    continue
                h.append(p)
                k.append(np.full(len(p), k1))
            return [pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(n)), pa.array(np.concatenate(k))]

        return fn

    return _stream(body, "h long, n long, k long", start).repartition("h").sortWithinPartitions("h", "n", "k")


def survivors(body: DataFrame, width: int, frequent: np.ndarray) -> DataFrame:
    """Names (k1) of sets that share enough of their long prefix with sets of a fitting size."""
    rows = _prefix_rows(body, width, frequent, None)

    def run(batches):
        def fitting(h, n, k, since, to):
            """A row for each shingle that a set shares; Spark counts them, on the map side first."""
            same = (h[1:] == h[:-1]) & (4 * n[:-1] >= 3 * n[1:])  # a row and the next one fit
            shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            at = np.arange(len(h))
            on = shared & (at >= since) & (at < to)
            return pa.RecordBatch.from_arrays([pa.array(k[on]), pa.array(n[on])], names=["k1", "n"])

        held, done = None, 0  # rows of the batch before: the last two, of which the last one still waits for its next
        for batch in batches:
            if not batch.num_rows:
                continue
            h, n, k = (batch.column(i).to_numpy() for i in range(3))
            if held is not None:
                h, n, k = (np.concatenate([a, b]) for a, b in zip(held, (h, n, k), strict=True))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (n[1:] != n[:-1]) | (k[1:] != k[:-1])])  # tasks send copies of a set each
            h, n, k = h[new], n[new], k[new]
            yield fitting(h, n, k, done, len(h) - 1)
            held, done = (h[-2:], n[-2:], k[-2:]), min(1, len(h) - 1)
        if held is not None:
            yield fitting(*held, done, len(held[0]))

    counted = rows.mapInArrow(run, "k1 long, n long").groupBy("k1").agg(F.min("n").alias("n"), F.count("*").alias("shared"))
    return counted.where(F.col("shared") >= 1 + F.floor(F.ceil(3 * F.col("n") / 4) / 5)).select("k1")


def ties(body: DataFrame, width: int, frequent: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """Edges a, b (first halves of names) that tie each set to others which share a first shingle and may be similar by size."""
    rows = _prefix_rows(body, width, frequent, wanted)

    def run(batches):
        joined = Forest()
        last = None  # the last row that may be met, for a shingle that goes on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            h, n, k = (batch.column(i).to_numpy() for i in range(3))
            if last is not None:
                h, n, k = (np.concatenate([[x], y]) for x, y in zip(last, (h, n, k), strict=True))
            size, first = n >> 1, (n & 1) == 1
            at = np.arange(len(h))
            before = np.concatenate([[-1], np.maximum.accumulate(np.where(first, at, -1))[:-1]])
            ok = (before >= 0) & (h[before] == h) & (4 * size[before] >= 3 * size)
            root = np.maximum.accumulate(np.where(ok, -1, at))
            a, b = k[ok], k[root[ok]]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
            new = [(x, y) for x, y in pairs.tolist() if joined.join(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in new], pa.int64()), pa.array([y for _, y in new], pa.int64())], names=["a", "b"])
            i = int(np.maximum.accumulate(np.where(first, at, -1))[-1])
            last = (h[i], n[i], k[i]) if i >= 0 and h[i] == h[-1] else None

    return rows.mapInArrow(run, "a long, b long")


class Forest:
    """Union-find over any keys."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        y = up.get(x, x)
        while y != (z := up.get(y, y)):
            y = z
        while x != y:
            up[x], x = y, up.get(x, x)
        return y

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


class Tree:
    """A signature tree: levels[0] holds the leaves. For each node: OR-combined bitmap, least and greatest size, greatest slack (size less set bits)."""

    def __init__(self, sets: list[np.ndarray]):
        n = np.array([len(s) for s in sets])
        bits = int(min(14, max(8, np.ceil(np.log2(4 * np.median(n) + 1)))))
        self.maps = np.zeros((len(sets), 1 << (bits - 6)), np.uint64)
        for i, s in enumerate(sets):
            pos = np.unique(s >> np.uint64(64 - bits)).astype(np.int64)
            np.bitwise_or.at(self.maps[i], pos >> 6, np.uint64(1) << (pos & 63).astype(np.uint64))
        self.n = n
        self.slack = n - np.bitwise_count(self.maps).sum(1).astype(np.int64)
        self.levels = [self._up(self.maps, n, n, self.slack, LEAF)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._up(*self.levels[-1], FAN))

    @staticmethod
    def _up(maps, low, high, slack, fan):
        at = np.arange(0, len(maps), fan)
        return np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a similarity of 75 % or more."""
    if len(a) > len(b):
        a, b = b, a
    i = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[i] == a).sum())
    return 100 * common >= 75 * (len(a) + len(b) - common)


def links_within(sets: list[np.ndarray], labels: list[int], side: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that span the components of links among sets.

    labels: sets with the same label are already in one component. side: if given, only pairs of sets of different sides are looked at. Sets are ordered by
    size class and least shingle, so that similar ones share nodes.
    """
    order = sorted(range(len(sets)), key=lambda i: (side[i] if side else 0, len(sets[i]).bit_length(), int(sets[i][0]), len(sets[i])))
    sets, labels = [sets[i] for i in order], [labels[i] for i in order]
    sides = np.array([side[i] for i in order]) if side else None
    forest, out = Forest(), []
    first: dict[int, int] = {}
    for i, label in enumerate(labels):
        forest.join(i, first.setdefault(label, i))
    if len(sets) < 2:
        return []
    tree = Tree(sets)
    one: dict[tuple[int, int], int] = {}  # nodes known to be in one component, with a member

    def span(level: int, node: int) -> range:
        width = LEAF * FAN**level
        return range(node * width, min(len(sets), (node + 1) * width))

    def single(level: int, node: int) -> int | None:
        if (member := one.get((level, node))) is not None:
            return forest.root(member)
        if level == 0:
            roots = {forest.root(i) for i in span(0, node)}
        else:
            roots = set()
            for child in range(node * FAN, min(len(tree.levels[level - 1][0]), (node + 1) * FAN)):
                r = single(level - 1, child)
                roots.add(r)
                if r is None or len(roots) > 1:
                    return None
        if len(roots) > 1:
            return None
        one[level, node] = next(iter(roots))
        return forest.root(one[level, node])

    def may(level: int, x: int, y: int) -> bool:
        maps, low, high, slack = tree.levels[level]
        if 3 * low[y] > 4 * high[x] or 3 * low[x] > 4 * high[y]:
            return False
        common = int(np.bitwise_count(maps[x] & maps[y]).sum()) if x != y else int(high[x])
        return 7 * (common + min(slack[x], slack[y])) >= 3 * (low[x] + low[y])

    def leaves(x: int, y: int) -> None:
        a, b = span(0, x), span(0, y)
        common = np.bitwise_count(tree.maps[a.start : a.stop, None] & tree.maps[None, b.start : b.stop]).sum(2)
        na, nb = tree.n[a.start : a.stop, None], tree.n[None, b.start : b.stop]
        most = common + np.minimum(tree.slack[a.start : a.stop, None], tree.slack[None, b.start : b.stop])
        good = (7 * most >= 3 * (na + nb)) & (4 * na >= 3 * nb) & (4 * nb >= 3 * na)
        if sides is not None:
            good &= sides[a.start : a.stop, None] != sides[None, b.start : b.stop]
        for i, j in np.argwhere(good).tolist():
            i, j = i + a.start, j + b.start
            if i < j and forest.root(i) != forest.root(j) and linked(sets[i], sets[j]):
                forest.join(i, j)
                out.append((order[i], order[j]))

    todo = [(len(tree.levels) - 1, 0, 0)]
    while todo:
        level, x, y = todo.pop()
        if (r := single(level, x)) is not None and r == single(level, y):
            continue
        if not may(level, x, y):
            continue
        if level == 0:
            leaves(x, y)
            continue
        last = len(tree.levels[level - 1][0])
        xs, ys = (range(v * FAN, min(last, (v + 1) * FAN)) for v in (x, y))
        pairs = [(level - 1, i, j) for i in xs for j in ys if x != y or i <= j]
        todo += sorted(pairs, key=lambda p: p[1] != p[2], reverse=True)  # a node with itself comes first
    return out


def _by_group(rows: DataFrame, group: list[str], fn) -> DataFrame:
    """Streams rows (rep, label, side, grams) sorted by group through fn, a group at a time; gives edges a, b between reps."""
    ordered = rows.repartition(*group).sortWithinPartitions(*group).select(F.concat_ws(":", *group).alias("g"), "rep", "label", "side", "grams")

    def run(batches):
        key, held = None, {}

        def done():
            got = fn(list(held.values())) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["a", "b"])

        for batch in batches:
            for g, rep, label, side, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != key:
                    if held:
                        yield done()
                    key, held = g, {}
                held[rep] = (rep, label, side, np.frombuffer(grams, np.uint64))  # tasks send a copy of a set each
        if held:
            yield done()

    return ordered.mapInArrow(run, "a long, b long")


def _alone(rows: list[tuple]) -> list[tuple[int, int]]:
    return [(rows[i][0], rows[j][0]) for i, j in links_within([r[3] for r in rows], [r[1] for r in rows])]


def _across(rows: list[tuple]) -> list[tuple[int, int]]:
    return [(rows[i][0], rows[j][0]) for i, j in links_within([r[3] for r in rows], [r[1] for r in rows], [r[2] for r in rows])]


def _names_map(names: DataFrame) -> np.ndarray:
    """A bitmap of the first halves of names; a set bit only means that a document's set is worth sending."""
    return member_map(names, "k1", map_bits(names.count()))


def _marked(names: np.ndarray, k1: int) -> bool:
    return bool(on_map(names, np.array([k1 % 2**64], np.uint64))[0])


def class_links(docs: DataFrame, classes: DataFrame, text: str = "text", width: int = WIDTH, big: int = BIG) -> DataFrame:
    """Edges a, b between the numbers of classes, enough to span all components of links. classes: a table of k1, k2, n (shingles) and rep (a number of its own) of each set."""
    body = docs.select(F.col(text).cast("string").alias("text"))
    classes = classes.select("k1", "k2", "rep", "n")
    frequent = frequent_shingles(body, width)
    stay = table(survivors(body, width, frequent), "survivors")
    blocks = components(ties(body, width, frequent, _names_map(stay))).select(F.col("node").alias("k1"), F.col("root").alias("block"))
    blocks = table(blocks, "blocks")
    members = table(classes.join(blocks, "k1").select("k1", "k2", "rep", "n", "block"), "members")
    sums = members.groupBy("block").agg(F.sum("n").alias("sum"))
    # chunks of a large block: size classes of 4/3, each cut by hash
    large = members.join(sums.where(F.col("sum") > big).select("block"), "block", "left_semi").withColumn("class",
        F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int"))
    cuts = table(large.groupBy("block", "class").agg(F.ceil(F.sum("n") / (big / 2)).cast("int").alias("parts")), "cuts")
    chunked = large.join(cuts, ["block", "class"]).withColumn("part", F.pmod(F.xxhash64("k2"), F.col("parts")).cast("int")).select("k1", "k2", "rep",
        "block", "class", "part")
    small = members.join(sums.where(F.col("sum") <= big).select("block"), "block", "left_semi").select("k1", "k2", "rep", "block",
        F.lit(0).alias("class"), F.lit(0).alias("part"))
    some_large = not cuts.isEmpty()
    dealt = table(small.unionByName(chunked) if some_large else small, "dealt")

    wanted = body.sparkSession.sparkContext.broadcast(_names_map(blocks))

    def start():
        new = _each_set(width)

        def fn(texts):
            k1, k2, grams = [], [], []
            for _, (a, b), s in new(texts):
                if _marked(wanted.value, a):
                    k1.append(a)
                    k2.append(b)
                    grams.append(s.tobytes())
            return [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(grams, pa.binary())]

        return fn

    sets = _stream(body, "k1 long, k2 long, grams binary", start).join(dealt, ["k1", "k2"])
    if not some_large:
        return table(_by_group(sets.select("block", "rep", F.col("rep").alias("label"), F.lit(0).alias("side"), "grams"), ["block"], _alone), "links")
    sets = table(sets, "sets")
    chunk = ["block", "class", "part"]
    links = table(_by_group(sets.select(*chunk, "rep", F.col("rep").alias("label"), F.lit(0).alias("side"), "grams"), chunk, _alone), "links")
    return _cross_chunks(sets.join(cuts, ["block", "class"]), cuts, links)


def _cross_chunks(sets: DataFrame, cuts: DataFrame, links: DataFrame) -> DataFrame:
    """Adds links between chunks of large blocks: first between one set of each component in each chunk, then in pairs of chunks that hold several components."""
    light, whole = sets.drop("grams"), sets.select("rep", "grams")  # pairs are chosen without the shingles, which only the sets of chosen ones follow
    for reps_only in (True, False):
        roots = components(links)
        rows = light.join(roots.select(F.col("node").alias("rep"), F.col("root").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        if reps_only:
            rows = rows.groupBy("block", "class", "part", "label").agg(F.min("rep").alias("rep"))
        # a chunk goes to its own class's later and earlier parts, and to all parts of the next class either way
        other = cuts.select("block", F.col("class").alias("other"), F.col("parts").alias("other_parts"))
        to = rows.join(other, "block").where(F.abs(F.col("other") - F.col("class")) <= 1).withColumn("other_part",
            F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
        me, you = F.struct(F.col("class").alias("c"), F.col("part").alias("p")), F.struct(F.col("other").alias("c"), F.col("other_part").alias("p"))
        pairs = to.where(me != you).select("block", F.to_json(F.least(me, you)).alias("x"), F.to_json(F.greatest(me, you)).alias("y"), "rep", "label",
            (me > you).cast("int").alias("side"))
        several = pairs.groupBy("block", "x", "y").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").drop("lo", "hi")
        chosen = pairs.join(several, ["block", "x", "y"], "left_semi").join(whole, "rep")
        links = table(links.unionByName(_by_group(chosen, ["block", "x", "y"], _across)), "links")
    return links


def _judged(docs: DataFrame, doc_id: str, text: str, width: int, big: int) -> tuple[DataFrame, DataFrame]:
    """(named(docs), the classes of equal sets with the number of each one's component, root, and its component_id), as tables."""
    light = table(named(docs, doc_id, text, width), "names")
    classes = light.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"))
    classes = table(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    links = class_links(docs.select(F.col(text).alias("text")), classes, "text", width, big)
    roots = table(components(links), "roots")
    found = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    # as a table, so that the next join has two plain inputs, and a class with a third of all rows is split
    return light, table(found.join(least, "root").select("k1", "k2", "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, big: int = BIG) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) for each row of docs. Ids are of any type that sorts.

    Null texts and texts without words have empty sets, link with nothing and are their own component. Rows with the same text are linked; rows that
    repeat an id are listed each, and rows of one id with texts that don't link stay in components of their own. Texts of any length are shingled whole; a set is an array
    in the memory of one task. A component whose rows all have a null id gets a null component_id. An empty table gives an empty one; other columns aren't read.
    """
    light, found = _judged(docs, doc_id, text, width, big)
    rows = light.join(found, ["k1", "k2"], "left")
    return rows.select(F.col("doc_id"), "n_shingles", F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, big: int = BIG) -> DataFrame:
    """docs, all columns, with one row of each component: that with the least id; where several rows have it, one of them, by the sets and then the columns.

    Rows without a word link with nothing and all stay. Whether a row goes is decided by its id and its set, so rows of one id with different texts are judged
    apart. Only rows whose id may have to go are shuffled: a bitmap of hashed ids, of fixed size, tells the others, which stay where they are. Rows
    whose id is null or repeated have their sets named again, and follow these names.
    """
    light, found = _judged(docs, doc_id, text, width, big)
    # A component keeps its least id's least set. An id may be the least one of several components.
    rows = light.where("k1 is not null").join(found, ["k1", "k2"])
    first = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("k1", "k2")).alias("k"), F.first("component_id").alias("__id"))
    keep, nameless = first.where("__id is not null").select("__id", "k.k1", "k.k2"), first.where("__id is null").select("k.k1", "k.k2")
    several = table(light.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    single = rows.where("doc_id is not null and doc_id <> component_id").select("doc_id")
    gone = table(single.distinct(), "gone")
    columns = docs.columns
    touched = gone.unionByName(several).select(F.xxhash64("doc_id").alias("k1")).distinct()
    stay, maybe = divided(docs.where(F.col(doc_id).isNotNull()), F.xxhash64(F.col(doc_id)), table(touched, "touched"))
    of = lambda ids: ids.select(F.col("doc_id").alias("__id"))
    is_id = F.col(doc_id) == F.col("__id")
    once = maybe.join(of(gone.unionByName(several)), is_id, "left_anti")
    again = maybe.join(of(several), is_id, "left_semi").unionByName(docs.where(F.col(doc_id).isNull()))
    renamed = [f"c{i}" for i in range(len(columns))]  # names of sets clash with nothing
    plain = again.toDF(*renamed)
    mine, words = (renamed[[c.lower() for c in columns].index(c.lower())] for c in (doc_id, text))
    both = _named_rows(plain, words, width)
    chosen = both.join(keep, (both[mine] == F.col("__id")) & (both["k1"] == keep["k1"]) & (both["k2"] == keep["k2"]), "left_semi")
    chosen = chosen.unionByName(both.where(F.col(mine).isNull()).join(nameless, ["k1", "k2"], "left_semi").select(both.columns))
    kept = chosen.groupBy(F.col(mine).alias("__id"), "k1", "k2").agg(F.min_by(F.struct(*renamed), F.to_json(F.struct(*renamed))).alias("r")).select("r.*")
    kept = kept.unionByName(both.where("k1 is null").select(*renamed))
    return stay.unionByName(once).unionByName(kept.toDF(*columns))


def _named_rows(rows: DataFrame, text: str, width: int) -> DataFrame:
    """rows, with the name k1, k2 of each row's set."""

    def names(texts: pa.Array) -> dict:
        both = [name or (None, None) for name in names_of(sets_of(texts, width))]
        return {"k1": [x[0] for x in both], "k2": [x[1] for x in both]}

    return map_texts(rows, text, rows.columns, "k1 long, k2 long", names, SLICE)
