"""Ranked lexical search: the best documents of each item by the Best Position Algorithm over impact lists.

Documents are split into shards of consecutive rows. In a shard each term has a list of its documents by falling impact, and the same list by document for
direct access. For an item, the lists of its terms are read side by side from the top; each new document's places in all lists are looked up and marked
as seen. A list's best position is the last one before its first unseen place, so impacts there, summed, bound all documents not met yet; reading stops when
that sum is strictly below the kth score, so that documents with equal scores are all met. A task keeps the best documents of each item from shard to
shard, and only those leave it: no list, however common its term, is ever gathered beyond a shard.

Items are taken in batches of BATCH_BYTES of text, whose terms go to the tasks; each batch passes over the documents once. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ._spark import map_texts, ship, table
from ._text import ALNUM, Words

#: Postings and documents of a shard, about; bytes of items' texts that one pass takes.
SHARD_POSTINGS, SHARD_DOCS, BATCH_BYTES = 2_000_000, 1 << 16, 16 << 20
#: Places read from each list in the first round of an item; each later round reads twice as many.
FIRST_READ = 16


class Items(NamedTuple):
    """Terms (sorted hashes) of a batch of items, and the terms of each item: terms[at[i] : at[i + 1]]."""

    vocabulary: np.ndarray
    terms: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Items:
        words = Words(pa.array(texts, pa.string()), ALNUM, lower=True)
        each = [np.unique(words.hash[a:b]) for a, b in itertools.pairwise(words.at.tolist())]
        vocabulary = np.unique(words.hash)
        terms = np.concatenate([np.zeros(0, np.uint64), *each])
        return cls(vocabulary, np.searchsorted(vocabulary, terms).astype(np.int32), np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64))


class Statistics(NamedTuple):
    """Of all documents: how many have a term, terms with repeats, and the weight of each term of the vocabulary."""

    documents: int
    length: int
    weights: np.ndarray


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, stats: Statistics) -> np.ndarray:
    """Of terms with these weights that occur tf times in documents of n terms."""
    m = 10 + 90 * n * stats.documents // stats.length
    return weights * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive parts of an array of 32-bit numbers, as bytes."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values, np.int32).tobytes())])


def postings(docs: DataFrame, vocabulary: np.ndarray, id: str, text: str) -> DataFrame:
    """id, n (terms with repeats), and as 32-bit numbers the terms of the vocabulary that a document holds and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(texts: pa.Array) -> dict:
        words, known = Words(texts, ALNUM, lower=True), shared.value
        place = np.searchsorted(known, words.hash)
        at = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == words.hash) if len(known) else np.zeros(0, np.int64)
        keys, tf = np.unique(words.text_of()[at] * len(known) + place[at], return_counts=True)
        ends = np.searchsorted(keys, np.arange(1, len(texts) + 1) * len(known))
        return {"n": words.n, "terms": _binary(keys % max(1, len(known)), ends), "tfs": _binary(tf, ends)}

    return map_texts(docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")), "text", ["id"], "n long, terms binary, tfs binary", count)


def _numbers(column: pa.Array) -> np.ndarray:
    """The 32-bit numbers of binary rows, one after the other."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.int32)[offsets[0] // 4 : offsets[-1] // 4] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.int32)


def statistics(rows: DataFrame, size: int) -> Statistics:
    """Of a table of postings(). The frequency of a term is summed in its tasks first; a number for each term of the vocabulary comes to the driver."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0)), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["term", "df"])

    n, length = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = np.zeros(size, np.int64)
    for r in rows.select("terms").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        found[r["term"]] = r["df"]
    return Statistics(n, max(1, length), np.array([weight(n, x) for x in found.tolist()], np.int64))


class Shard:
    """Impact lists of some documents: rows are numbered by ascending id."""

    def __init__(self, batches: list[pa.RecordBatch], stats: Statistics):
        ids = pa.chunked_array([b.column(0) for b in batches]).combine_chunks()
        self.ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        order = pc.sort_indices(self.ids).to_numpy()  # nulls last
        self.ids = self.ids.take(pa.array(order))
        self.n_docs = len(order)
        row = np.empty(len(order), np.int64)
        row[order] = np.arange(len(order))
        n = np.concatenate([b.column(1).to_numpy() for b in batches])
        each = np.concatenate([pc.binary_length(b.column(2)).to_numpy() // 4 for b in batches])
        term, tf = (np.concatenate([_numbers(b.column(i)) for b in batches]) for i in (2, 3))
        impact = impacts(stats.weights[term], tf.astype(np.int64), np.repeat(n, each), stats)
        doc = np.repeat(row, each)
        by_doc = np.argsort(term.astype(np.int64) * self.n_docs + doc, kind="stable")
        self.doc, self.impact, term = doc[by_doc].astype(np.int32), impact[by_doc], term[by_doc]
        self.at = np.searchsorted(term, np.arange(len(stats.weights) + 1))
        self.top = np.lexsort((self.doc, -self.impact, term))  # places by falling impact
        self.place = np.empty_like(self.top)
        self.place[self.top] = np.arange(len(self.top))
        self.seen, self.met = np.zeros(len(term), bool), np.zeros(self.n_docs, bool)

    def best(self, terms: np.ndarray, k: int, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers) and scores of the best k that may stand among the best k of these and of others with the given scores."""
        spans = [(a, b) for a, b in zip(self.at[terms].tolist(), self.at[terms + 1].tolist(), strict=True) if a < b and self.impact[self.top[a]] > 0]
        best = [0] * len(spans)
        docs, got = np.zeros(0, np.int32), np.zeros(0, np.int64)
        lo, read = 0, FIRST_READ
        while any(a + lo < b for a, b in spans):
            tops = [self.top[a + lo : min(b, a + lo + read)] for a, b in spans]
            for (a, b), _ in zip(spans, tops, strict=True):
                self.seen[a + lo : min(b, a + lo + read)] = True
            new = self.doc[np.concatenate(tops)]
            new = np.unique(new[~self.met[new]])
            self.met[new] = True
            score = np.zeros(len(new), np.int64)
            for a, b in spans:
                at = np.searchsorted(self.doc[a:b], new) + a
                at[at == b] = a
                hit = np.flatnonzero(self.doc[at] == new)
                score[hit] += self.impact[at[hit]]
                self.seen[self.place[at[hit]]] = True
            docs, got = np.concatenate([docs, new]), np.concatenate([got, score])
            keep = np.lexsort((docs, -got))[:k]
            docs, got = docs[keep], got[keep]
            bound = 0
            for i, (a, b) in enumerate(spans):
                rest = self.seen[a + best[i] : b]
                best[i] += len(rest) if rest.all() else int(rest.argmin())
                bound += 0 if a + best[i] == b else int(self.impact[self.top[a + best[i] - 1]])
            known = np.sort(np.concatenate([got, scores]))[::-1]
            if len(known) >= k and known[k - 1] > bound:
                break
            lo, read = lo + read, read * 2
        self.met[:] = False
        for a, b in spans:
            self.seen[a:b] = False
        return docs, got


def _ranked(rows: DataFrame, items: Items, stats: Statistics, k: int) -> DataFrame:
    """item (its number), id, score: the best k of each item in each task."""
    shared = rows.sparkSession.sparkContext.broadcast((items, stats))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, stats = shared.value
        tops: list[tuple[pa.Array, np.ndarray]] | None = None

        def take(shard: Shard) -> None:
            nonlocal tops
            tops = tops or [(shard.ids.slice(0, 0), np.zeros(0, np.int64))] * (len(items.at) - 1)
            for i in range(len(tops)):
                docs, got = shard.best(items.terms[items.at[i] : items.at[i + 1]], k, tops[i][1])
                if len(docs):
                    ids = pa.concat_arrays([tops[i][0], shard.ids.take(pa.array(docs))])
                    score = np.concatenate([tops[i][1], got])
                    keep = pc.sort_indices(pa.table({"id": ids, "score": score}), [("score", "descending"), ("id", "ascending")])[:k]
                    tops[i] = ids.take(keep), score[keep.to_numpy()]

        held, n, total = [], 0, 0
        for batch in batches:
            for part in _parts(batch):
                held.append(part)
                n, total = n + part.num_rows, total + len(_numbers(part.column(2)))
                if n >= SHARD_DOCS or total >= SHARD_POSTINGS:
                    take(Shard(held, stats))
                    held, n, total = [], 0, 0
        if held:
            take(Shard(held, stats))
        for i, (ids, score) in enumerate(tops or []):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(score), pa.int32()), ids, pa.array(score)], names=["item", "id", "score"])

    return rows.mapInArrow(run, f"item int, id {kind}, score long")


def _parts(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0, equal scores by ascending id (null last).

    Each row of items is ranked by itself (rows that agree in id and text count once); rows of documents that share an id each count. A null or empty text has no
    terms, so such an item has no rows and such a document is in none. Texts of any length are read whole. Other columns aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    asked = items.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    n = int((asked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // batch_bytes + 1)
    out = None
    for i in range(n):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()  # about batch_bytes
        batch = Items.of([r["text"] for r in rows])
        counted = table(postings(docs, batch.vocabulary, id, text), "postings")
        stats = statistics(counted, len(batch.vocabulary))
        names = spark.createDataFrame([(j, r["item"]) for j, r in enumerate(rows)], f"item int, item_id {asked.schema['item'].dataType.simpleString()}")
        best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        top = _ranked(counted, batch, stats, k).where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = top.join(names, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        out = found if out is None else out.unionByName(found)
    return out
