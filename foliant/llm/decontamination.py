"""Benchmark decontamination by winnowing.

Test items and documents are cut into words; of every w neighbouring k-gram hashes the least one is kept as a fingerprint. A document and an
item that share w + k - 1 words in a row share a fingerprint, so with w + k - 1 = window no shared window is missed. Each fingerprint carries the
window - k words on either side of it. Spark joins the fingerprints of documents and items by hash, and each hit is extended to both sides, word by word:
where the shared run has a window, its words are hit. A run that is longer than what one fingerprint carries has more fingerprints.

Tokens are read once, where the documents lie: a bitmap of the items' fingerprints (of bounded size) leaves only those that an item may have, so
documents without one are never shuffled. Fingerprints of an item that have the same words around them are one, and so are equal texts: cost is linear in repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import divided, map_bits, map_texts, member_map, on_map, table
from ._text import ALNUM, Words, mix

WINDOW, K = 10, 5
#: Fingerprints of items up to so many (some 150 bytes each) are broadcast; more are joined by shuffle.
MAX_BROADCAST = 300_000
_PRINTS = "array<struct<h:bigint,n:int,p:bigint,l:array<bigint>,r:array<bigint>>>"


def winnow(words: Words, k: int, w: int) -> np.ndarray:
    """Positions of the fingerprints: the last least k-gram hash of each w neighbours within a text.

    A text with fewer than w grams may get none; it is too short for a shared window.
    """
    grams, ok = words.grams(k)
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    grams = np.where(ok, grams, np.uint64(2**64 - 1))
    best = np.arange(n)
    least, span = grams.copy(), 1
    while span < w:  # doubling: the least of `span` neighbours becomes the least of up to twice as many
        step = min(span, w - span)
        other, where = least[step:], best[step:]
        take = other <= least[: n - step]
        least = np.concatenate([np.where(take, other, least[: n - step]), least[n - step :]])
        best = np.concatenate([np.where(take, where, best[: n - step]), best[n - step :]])
        span += step
    full = np.zeros(n, bool)
    count = np.maximum(words.n - k + 1, 0)
    first = words.at[:-1]
    last = first + np.maximum(count - w, 0)
    texts = words.text_of()
    full = (np.arange(n) <= last[texts]) & (count[texts] > 0)
    kept = np.unique(best[full])
    return kept[ok[kept]]


def fingerprints(w: Words, short: tuple[int, ...], window: int, k: int, marks: np.ndarray | None = None, items: bool = False) -> list[list[dict]]:
    """Of each text its fingerprints: hash h, words n of the gram, place p, and the hashes of the words to its left (nearest first) and right, window - k at most.

    Items have the fingerprints of their length only: an item of fewer words than a window is one gram of all its words (n < window, nothing beside it). Texts
    have those of windows, and all grams of the lengths `short`. marks: a bitmap; fingerprints that aren't on it are left out.
    """
    out: list[list[dict]] = [[] for _ in w.n]
    text = w.text_of()
    signed = w.hash.view(np.int64)
    for n in (0, *short):
        if n:
            h, ok = w.grams(n)
            pos = np.flatnonzero(ok)
            if items:
                pos = pos[w.n[text[pos]] == n]
        else:
            pos, h = winnow(w, k, window - k + 1), w.grams(k)[0]
            pos = pos[w.n[text[pos]] >= window]
        found = mix(h[pos] ^ np.uint64(n + 1))
        if marks is not None:
            on = on_map(marks, found)
            pos, found = pos[on], found[on]
        t = text[pos]
        first, last, side = w.at[t], w.at[t + 1], 0 if n else window - k
        size = n or k
        for p, hash_, i, a, b in zip(pos.tolist(), found.view(np.int64).tolist(), t.tolist(), first.tolist(), last.tolist(), strict=True):
            left, right = signed[max(a, p - side) : p][::-1], signed[p + size : min(b, p + size + side)]
            out[i].append({"h": hash_, "n": size, "p": p - a, "l": left.tolist(), "r": right.tolist()})
    return out


def _item_prints(benchmark: DataFrame, item_id: str, text: str, window: int, k: int) -> tuple[DataFrame, tuple[int, ...]]:
    """The distinct fingerprints of items (item, h, n, l, r), and the lengths of items that are shorter than a window."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("__words")).where("__words is not null")
    sized = map_texts(items, "__words", [], "n long", lambda t: {"n": Words(t, ALNUM, lower=True).n})
    short = tuple(sorted(r["n"] for r in sized.where(F.col("n").between(1, window - 1)).distinct().collect()))  # window - 1 at most
    prints = map_texts(items, "__words", ["item"], f"prints {_PRINTS}", lambda t: {"prints": fingerprints(Words(t, ALNUM, lower=True), short, window,
        k, items=True)})
    return table(prints.select("item", F.explode("prints").alias("f")).select("item", "f.h", "f.n", "f.l", "f.r").distinct(), "item-prints"), short


def _same(a: Column, b: Column) -> Column:
    """How many words agree from the start of two lists."""
    agree = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(agree, False)
    return F.when(first == 0, F.size(agree)).otherwise(first - 1)


def _hits(prints: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """Of rows with __key and __prints (equal keys have equal ones): __key, __spans and __items of each key with a hit."""
    once = prints.where(F.size("__prints") > 0).groupBy("__key").agg(F.first("__prints").alias("__prints"))
    mine = once.select("__key", F.explode("__prints").alias("f")).select("__key", "f.h", "f.p", F.col("f.l").alias("dl"), F.col("f.r").alias("dr"))
    pairs = mine.join(F.broadcast(items) if items.count() <= MAX_BROADCAST else items, "h")
    runs = pairs.select("__key", "item", "p", "n", _same(F.col("dl"), F.col("l")).alias("before"), _same(F.col("dr"), F.col("r")).alias("behind"),
        F.size("l").alias("nl"), F.size("r").alias("nr"))
    whole = (F.col("before") + F.col("n") + F.col("behind") >= window) | ((F.col("nl") == 0) & (F.col("nr") == 0))
    hits = table(runs.where(whole).select("__key", "item", (F.col("p") - F.col("before")).alias("start"), (F.col("p") + F.col("n")
        + F.col("behind")).alias("end")).distinct(), "hits")
    # overlapping and adjoining ranges of a text become one
    in_order = Window.partitionBy("__key").orderBy("start", "end")
    upto = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.select("__key", "start", "end").distinct().withColumn("new", F.coalesce(F.col("start") > upto, F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("__key", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))  # no more than a text has words
    named = hits.groupBy("__key").agg(F.sort_array(F.collect_set("item")).alias("__items"))
    return table(spans.join(named, "__key"), "hit-texts")


def _printed(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str, item_id: str, item_text: str, window: int, k: int) -> tuple[
    DataFrame, DataFrame]:
    """(rows of docs as `keep`, __key (a digest of the text), __n and __prints, distinct fingerprints of the items)."""
    items, short = _item_prints(benchmark, item_id, item_text, window, k)
    marks = docs.sparkSession.sparkContext.broadcast(member_map(items, "h", map_bits(items.count())))
    source = docs.select(*keep, F.col(text).cast("string").alias("__body"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("__key"))

    def found(texts: pa.Array) -> dict:
        w = Words(texts, ALNUM, lower=True)
        return {"__n": w.n, "__prints": fingerprints(w, short, window, k, marks.value)}

    return map_texts(source, "__body", [*keep, "__key"], f"`__n` long, `__prints` {_PRINTS}", found), items


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, k: int = K) -> DataFrame:
    """For each row of docs: the columns `keep`, n_words, spans (array of hit word ranges, end exclusive) and items (sorted distinct ids as strings).

    Null or empty text: 0 words, no spans. Items without words, and null items, match nothing; an item with a null id counts for spans but isn't
    listed. Repeated rows are judged alike. An empty benchmark hits nothing. Other columns of docs aren't read, whatever their names. Texts and items of
    any length are read whole, and words that repeat cost no more than others.
    """
    rows, items = _printed(docs, benchmark, keep, text, item_id, item_text, window, k)
    rows = table(rows, "decontamination")
    hits = _hits(rows, items, window)
    spans, names = "array<struct<start:bigint,end:bigint>>", "array<string>"
    some = F.size("__prints") > 0
    clean = rows.where(~some).withColumns({"__spans": F.array().cast(spans), "__items": F.array().cast(names)})
    rest = rows.where(some).join(hits, "__key", "left")
    both = clean.select(*keep, "__n", "__spans", "__items").unionByName(rest.select(*keep, "__n", F.coalesce("__spans", F.array().cast(spans)).alias(
        "__spans"), F.coalesce("__items", F.array().cast(names)).alias("__items")))
    return both.select(*keep, F.col("__n").alias("n_words"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def hit_words(spans) -> F.Column:
    """Words in the union of spans."""
    ordered = F.array_sort(spans)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(
        ordered, zero,
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).cast("long").alias("n"),
            F.greatest(a["to"], s["end"]).cast("long").alias("to")),
        lambda a: a["n"],
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, k: int = K) -> DataFrame:
    """docs without the documents that have a window of an item; all columns stay as they are. Only rows whose text may be one of the hit ones are shuffled."""
    rows, items = _printed(docs, benchmark, [], text, item_id, item_text, window, k)
    hits = _hits(table(rows.where(F.size("__prints") > 0), "decontamination"), items, window)
    digest = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    stay, maybe = divided(docs, F.xxhash64(digest), hits.select(F.xxhash64("__key").alias("k1")))
    return stay.unionByName(maybe.withColumn("__key", digest).join(hits.select("__key"), "__key", "left_anti").select(*docs.columns))
