"""Supervised subword embeddings for document quality.

A document is the mean of the learned vectors of its features: hashed words, hashed character 3- and 4-grams of the words with their borders, and one
mark for a word that repeats the word before it. A softmax layer reads the mean. Both are trained by stochastic gradient descent in numpy on a bounded
sample of labelled documents (SAMPLE rows). As the softmax is linear in the mean, scoring adds up one number a feature: the vector times the
weights. Distinct words of a slice are looked up once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import map_texts, table
from ._text import NON_SPACE, Words, mix, span_hashes

BITS, DIM = 18, 16
#: At most about so many labelled documents train the model: a hash of the text and id picks them.
SAMPLE = 1_200
#: At most so many bytes of text train a model.
SAMPLE_BYTES = 64_000_000
_REPEAT = 0


def features_of(w: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct words of a slice: index of each word's distinct word, the features of the distinct words in a row, where each begins."""
    hashes, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
    s, e = w.start[first], w.end[first]
    size = (e - s) + 2
    at = np.concatenate([[0], np.cumsum(size)])
    buf = np.full(at[-1], 0x20, np.uint8)  # each distinct word between two spaces
    inner = np.arange(at[-1]) - np.repeat(at[:-1], size)
    body = (inner > 0) & (inner < np.repeat(size, size) - 1)
    buf[body] = w.buf[(np.repeat(s, size) + inner - 1)[body]]
    owner = np.repeat(np.arange(len(size)), size)
    feats, owners = [mix(hashes)], [np.arange(len(hashes))]
    for k in (3, 4):
        if len(buf) >= k:
            ok = np.arange(len(buf)) + k <= np.repeat(at[1:], size)
            pos = np.flatnonzero(ok)
            feats.append(span_hashes(buf, pos, pos + k))
            owners.append(owner[pos])
    feat, owner = np.concatenate(feats), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    ids = (feat[order] >> np.uint64(64 - bits)).astype(np.int64)
    ids[ids == _REPEAT] = 1
    return which, ids, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(hashes)))])


def repeats(w: Words) -> np.ndarray:
    """Whether each word equals the word before it in its text."""
    same = np.zeros(len(w.hash), bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    same[w.at[:-1][w.n > 0]] = False
    return same


class Model:
    """One number a feature (its vector times the weights of class 1 less class 0), and a bias."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of class 1 for each text; a text without words gets the bias alone."""
        w = Words(texts, NON_SPACE)
        total, n = np.zeros(len(w.n)), np.ones(len(w.n))
        if len(w.hash):
            which, ids, at = features_of(w)
            per_word, size = np.add.reduceat(self.value[ids], at[:-1]), np.diff(at)
            rep = repeats(w)
            both = np.concatenate([[0.0], np.cumsum(per_word[which] + rep * self.value[_REPEAT])])
            many = np.concatenate([[0], np.cumsum(size[which] + rep)])
            total, n = np.diff(both[w.at]), np.maximum(1, np.diff(many[w.at]))
        return 1 / (1 + np.exp(-np.clip(total / n + self.bias, -30, 30)))


def train(texts: list[str], labels: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent over small batches of documents: embeddings (hash buckets x dim) and softmax weights."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim))
    weights, bias = np.zeros((dim, 2)), np.zeros(2)
    if not len(texts) or len(set(labels.tolist())) < 2:
        share = float(np.mean(labels)) if len(texts) else 0.5
        return Model(np.zeros(1 << bits), float(np.clip(np.log((share + 1e-3) / (1 - share + 1e-3)), -7, 7)))
    docs = []
    for t in texts:  # features of a document with their shares
        w = Words(pa.array([t]), NON_SPACE)
        if len(w.hash):
            which, ids, at = features_of(w)
            count = np.bincount(which, minlength=len(at) - 1)
            f = np.concatenate([ids, [_REPEAT]])
            c = np.concatenate([np.repeat(count, np.diff(at)), [repeats(w).sum()]])
            f, back = np.unique(f, return_inverse=True)
            c = np.bincount(back, weights=c)
            docs.append((f, c / c.sum()))
        else:
            docs.append((np.zeros(0, np.int64), np.zeros(0)))
    share = np.bincount(labels, minlength=2) / len(labels)
    balance = 0.5 / np.maximum(share, 1e-6)
    steps, step = epochs * ((len(docs) + 15) // 16), 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for b in range(0, len(docs), 16):
            lr = rate * (1 - step / steps)
            step += 1
            rows = order[b : b + 16]
            f = np.concatenate([docs[r][0] for r in rows])
            c = np.concatenate([docs[r][1] for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(docs[r][0]) for r in rows])
            mean = np.zeros((len(rows), dim))
            full = np.unique(owner)
            mean[full] = np.add.reduceat(emb[f] * c[:, None], np.searchsorted(owner, full)) if len(f) else 0
            z = mean @ weights + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = labels[rows]
            g = p.copy()
            g[np.arange(len(rows)), y] -= 1
            g *= balance[y][:, None]
            back = g @ weights.T
            weights -= lr * mean.T @ g
            bias -= lr * 0.1 * g.mean(0)
            if len(f):
                by = np.argsort(f, kind="stable")
                own, at = np.unique(f[by], return_index=True)
                emb[own] -= lr * 20 * np.add.reduceat((back[owner] * c[:, None])[by], at)
    value = emb @ (weights[:, 1] - weights[:, 0])
    raw = np.array([c @ value[f] + bias[1] - bias[0] for f, c in docs])
    shift = _prior_shift(raw, labels)
    return Model(value.astype(np.float64), float(bias[1] - bias[0] + shift))


def _prior_shift(raw: np.ndarray, labels: np.ndarray) -> float:
    """What to add to the logits so that probabilities, trained on balanced classes, have the mean of the labels."""
    lo, hi = -20.0, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if np.mean(1 / (1 + np.exp(-np.clip(raw + mid, -40, 40)))) < labels.mean():
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def below(share: float, *columns: str) -> F.Column:
    """Whether a row's 64-bit hash is among the first `share` of all hashes."""
    return F.xxhash64(*columns) <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))


def bounded(rows: DataFrame, text: str, key: list[str], most_bytes: int, most_rows: int) -> DataFrame:
    """Different rows (by key and text) in the order of their hash, most_rows at most, as long as their texts have `most_bytes` at most in all; a longer text is passed over.

    Only hashes and lengths of most_rows rows go to the driver, whatever ids or texts repeat.
    """
    named = rows.where(F.octet_length(text) <= most_bytes).withColumn("__h", F.xxhash64(*key, text)).dropDuplicates(["__h"])
    sizes = named.select("__h", F.octet_length(text).alias("n")).orderBy("__h").limit(most_rows).collect()
    total, last = 0, None
    for r in sizes:
        if (total := total + r["n"]) > most_bytes:
            break
        last = r["__h"]
    return named.where(F.lit(False) if last is None else F.col("__h") <= last).drop("__h")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and labels that train: labelled rows, but for those with crc32(doc_id) mod 4 = 2 and null labels, at most about `sample` ids by hash, with 2 * sample different texts
    and `most_bytes` of them at most. Rows that agree in id, text and label train once; an id with both labels trains both.

    Training needs no more than these bounds, which is why it may go through the driver. Rows are put in order, so that reruns train alike.
    """
    train_rows = labels.where(f"`{label}` in (0, 1)").select("doc_id", F.col(label).cast("int").alias("__y")).where(~held_out("doc_id")).distinct()
    n = train_rows.count()
    if n > sample:
        train_rows = train_rows.where(below(sample / n, "doc_id"))
    # about `sample` rows: at most two for an id, and ids are chosen by hash
    rows = docs.select("doc_id", F.col("text").cast("string").alias("__t")).where("__t is not null").join(F.broadcast(train_rows), "doc_id")
    got = bounded(table(rows, "labelled"), "__t", ["doc_id", "__y"], most_bytes, 2 * sample).select("__t", "__y").toArrow()
    texts, y = got.column("__t").to_pylist(), np.array(got.column("__y").to_pylist(), np.int64)
    order = sorted(range(len(texts)), key=lambda i: (hash_of(texts[i]), texts[i], y[i]))
    return [texts[i] for i in order], y[order]


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    return train(*labelled_sample(docs, labels, "quality", sample))


def quality_scores(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and `score` (0 to 1, the probability of good quality) for each row; null and empty texts get the score of no words.

    Repeated rows score alike; an empty table gives an empty one; a missing label, or labels of one class only, give a constant score. Texts of any length are
    read whole; a kept column called `score` is left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, text, keep, "`score` double", lambda t: {"score": shared.value.score(t)})


def remove_low_quality(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, text, docs.columns, "`__ok` boolean", lambda t: {"__ok": (take := np.flatnonzero(shared.value.score(t) >= threshold)) >= 0,
        "__take": take}).drop("__ok")
