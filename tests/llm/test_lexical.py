"""Ranked search against all scores."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SORTS_LAST = 1 << 62


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=10):
    """(item, rank, doc_id, score) by scoring every document."""
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) & set(c))
            if score:
                found.append((-score, SORTS_LAST if i is None else i))
        out += [(item, rank, None if i == SORTS_LAST else i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(rng, n=400):
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 80]))) for _ in range(n)]
    texts += [None, "", " .,", "W1 w1-W2", "ÄB äb ÄB", "w1 " * 30_000, *[texts[0]] * 40, *[texts[1]] * 40]
    docs = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, texts[3]), (7, texts[3])]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 9, 40])))) for i in range(25)]
    return docs, items + [(100, None), (101, ""), (102, "nowhere"), (103, "Äb w1"), (0, items[0][1]), (104, items[0][1])]


@pytest.mark.parametrize("shard", [1, 40, 1 << 16])
def test_search(spark, monkeypatch, shard):
    monkeypatch.setattr(lexical, "FIRST_READ", 1 if shard == 1 else 4)
    docs, items = corpus(random.Random(shard))
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, terms string, rank int, n long").repartition(5)
    asked = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    got = lexical.search(frame, asked, batch_bytes=1500).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == brute(docs, items)


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(items.withColumnRenamed("item_id", "doc_id"), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_shards_stop_early_and_lose_nothing(seed):
    """Shards of random postings against full sums, with equal scores; long lists aren't read to their ends."""
    rng = np.random.default_rng(seed)
    n, v = 3000, 6
    held = [np.flatnonzero(rng.random(v) < 0.4).astype(np.int32) for _ in range(n)]
    tf = np.minimum(rng.zipf(1.6, sum(map(len, held))), 50).astype(np.int32)
    ends = np.cumsum([len(h) for h in held])
    length = rng.integers(5, 40, n)
    stats = lexical.Statistics(n, int(length.sum()), np.array([0, 900, 2500, 400, 7000, 10]))
    ids = rng.permutation(n)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(length), lexical._binary(np.concatenate(held), ends), lexical._binary(tf, ends)], names=["id", "n", "terms", "tfs"])
    shard = lexical.Shard([batch.slice(0, 1000), batch.slice(1000)], stats)
    scores = np.zeros((n, v), np.int64)
    at = np.repeat(np.arange(n), [len(h) for h in held])
    scores[ids[at], np.concatenate(held)] = lexical.impacts(stats.weights[np.concatenate(held)], tf.astype(np.int64), length[at], stats)
    for terms_ in ([4], [1, 2], [0, 3, 4, 5], list(range(6))):
        total = scores[:, terms_].sum(axis=1)
        want = sorted((-s, i) for i, s in enumerate(total.tolist()) if s)[:10]
        docs, got = shard.best(np.array(terms_), 10, np.zeros(0, np.int64))
        assert [(-s, i) for i, s in zip(docs.tolist(), got.tolist(), strict=True)] == want
        docs, got = shard.best(np.array(terms_), 10, np.array([-want[4][0]] * 10))
        assert [x for x in want[:5] if -x[0] > -want[4][0]] == [(-s, i) for i, s in zip(docs.tolist(), got.tolist(), strict=True) if s > -want[4][0]]
    assert not shard.seen.any() and not shard.met.any()
    seen = []
    lexical_read = np.unique
    try:
        np.unique = lambda x, *a, **b: seen.append(len(x)) or lexical_read(x, *a, **b)
        shard.best(np.array([4]), 10, np.zeros(0, np.int64))
    finally:
        np.unique = lexical_read
    assert sum(seen) < len(shard.doc[shard.at[4] : shard.at[5]]) / 2
