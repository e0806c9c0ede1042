"""Toxic spans by a linear-chain conditional random field.

Tokens are lower-cased words; a chain is a sentence, of any length. A token's features are hashes of its word and of its first 3 to 6
bytes. Labels come a document at a time, so the tokens that train are labelled first: in toxic documents those whose word or prefix is found in
several toxic documents and next to never in others, elsewhere none. The field (emission weights and a 2 x 2 transition) is fitted in
numpy by gradient steps on its likelihood, over a bounded sample of labelled documents. Forward and backward passes give each token's marginal;
a document's score is a logistic function of its largest marginal and the expected number of toxic tokens, and runs of tokens with a marginal
of 1/2 or more are its spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import map_texts
from ._text import ALNUM, Words, mix, span_hashes
from .quality import labelled_sample

#: Longer chains are passed through in parts of PART tokens at a time: the same marginals in fewer steps.
BITS, PART, SAMPLE = 18, 256, 2_500
_PREFIXES = (3, 4, 5, 6)
_ENDS = np.zeros(256, bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True


class Tokens(Words):
    """Words with their chains: chain holds the first token of each chain (one more at the end)."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts, ALNUM, lower=True)
        n = len(self.start)
        stops = np.concatenate([[0], np.cumsum(_ENDS[self.buf])])
        new = np.zeros(n, bool)
        if n:
            new[1:] = stops[self.start[1:]] != stops[self.start[:-1]]
            new[self.at[:-1][self.n > 0]] = True
        self.chain = np.append(np.flatnonzero(new), n)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the distinct words: the index of each token's distinct word, and a row of features (0 for prefixes that the word is too short for)."""
        hashes, first, which = np.unique(self.hash, return_index=True, return_inverse=True)
        s, e = self.start[first], self.end[first]
        order = np.argsort(s, kind="stable")
        out = np.zeros((len(hashes), 1 + len(_PREFIXES)), np.int64)
        out[:, 0] = self._bucket(hashes, 1)
        for j, k in enumerate(_PREFIXES, 1):
            long = order[(e - s)[order] > k]
            out[long, j] = self._bucket(span_hashes(self.buf, s[long], s[long] + k), k + 1)
        return which, out

    @staticmethod
    def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
        return np.maximum(1, (mix(h + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64))


def _through(x: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The log odds of the next state, given log odds x of this one; step[a, b]: the score of b after a."""
    return np.logaddexp(step[0, 1], x + step[1, 1]) - np.logaddexp(step[0, 0], x + step[1, 0])


def _pass(e: np.ndarray, first: np.ndarray, size: np.ndarray, step: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Log odds of state 1 at each token, given those before it (e: emissions): a step a token over all chains at once. start: log odds before each chain's first token, if there are any (nan: none)."""
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    f = e.copy()
    if start is not None:
        some = ~np.isnan(start[order])
        f[first[some]] = e[first[some]] + _through(start[order][some], step)
    live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")  # chains with at least so many tokens
    for t in range(1, len(live)):
        at = first[: live[t]] + t
        f[at] = e[at] + _through(f[at - 1], step)
    return f


def _forward(e: np.ndarray, chain: np.ndarray, step: np.ndarray) -> np.ndarray:
    """As _pass, with long chains cut into parts. A part turns the log odds before it into those at its end by a 2 x 2 matrix: the matrices of all parts at once, then along the parts of each chain, then the parts."""
    size = np.diff(chain)
    if not len(size) or size.max() <= PART:
        return _pass(e, chain[:-1], size, step)
    parts = -(-size // PART)
    of = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = chain[:-1][of] + nth * PART
    length = np.minimum(PART, chain[1:][of] - first)
    m = np.repeat(step[None].astype(float), len(first), 0)  # log weights of (state before, state at the part's end)
    m[:, :, 1] += e[first][:, None]
    for t in range(1, PART):
        on = np.flatnonzero(length > t)
        if not len(on):
            break
        a = m[on]
        m[on, :, 0] = np.logaddexp(a[:, :, 0] + step[0, 0], a[:, :, 1] + step[1, 0])
        m[on, :, 1] = np.logaddexp(a[:, :, 0] + step[0, 1], a[:, :, 1] + step[1, 1]) + e[first[on] + t][:, None]
        m[on] -= m[on].max(axis=(1, 2), keepdims=True)
    start = np.full(len(first), np.nan)
    at = np.flatnonzero(nth == 0)
    odds = _pass(e, first[at], length[at], step)[first[at] + length[at] - 1]  # at the end of each chain's first part
    for k in range(1, int(parts.max())):
        more = parts[of[at]] > k
        at, odds = at[more] + 1, odds[more]
        start[at] = odds
        odds = np.logaddexp(m[at, 0, 1], odds + m[at, 1, 1]) - np.logaddexp(m[at, 0, 0], odds + m[at, 1, 0])
    return _pass(e, first, length, step, start)


def marginals(e: np.ndarray, chain: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of state 1 for each token by forward and backward passes over all chains at once; and the forward and backward parts."""
    f = _forward(e, chain, step)
    n = len(e)
    b = _forward(e[::-1], n - chain[::-1], step.T)[::-1] - e  # the same, read from the end
    return f + b, f, b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Field:
    def __init__(self):
        self.weight, self.bias = np.zeros(1 << BITS), -4.0
        self.step = np.zeros((2, 2))
        self.scale = np.array([0.0, 0.0, 0.0])

    def emissions(self, tokens: Tokens) -> np.ndarray:
        if not len(tokens.hash):
            return np.zeros(0)
        which, feats = tokens.features()
        return (self.weight[feats].sum(1) + self.bias)[which]

    def evidence(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """For each text: the largest log odds of a token, and the log of 1 + the expected number of toxic tokens; and each token's marginal."""
        n = len(tokens.n)
        odds = marginals(self.emissions(tokens), tokens.chain, self.step)[0] if len(tokens.hash) else np.zeros(0)
        p = _sigmoid(odds)
        most, many = np.full(n, -12.0), np.zeros(n)
        full = np.flatnonzero(tokens.n > 0)
        if len(full):
            most[full] = np.clip(np.maximum.reduceat(odds, tokens.at[:-1][full]), -12, 12)
            many[full] = np.log1p(np.add.reduceat(p, tokens.at[:-1][full]))
        return np.stack([np.ones(n), most, many], 1), p

    def score(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        x, p = self.evidence(tokens)
        return _sigmoid(x @ self.scale), p


def _token_labels(tokens: Tokens, y: np.ndarray, least: int = 3, purity: float = 0.97) -> tuple[np.ndarray, np.ndarray]:
    """0 or 1 for each token, and whether its text trains: toxic texts without a token of label 1 don't."""
    which, feats = tokens.features()
    doc = tokens.text_of()
    pairs = np.unique(np.stack([doc, which], 1), axis=0)
    toxic = np.zeros((2, 1 << BITS))
    for c in range(2):
        rows = pairs[y[pairs[:, 0]] == c]
        flat = np.unique(np.repeat(rows[:, 0], feats.shape[1]) * (1 << BITS) + feats[rows[:, 1]].ravel()) % (1 << BITS)
        toxic[c] = np.bincount(flat, minlength=1 << BITS)
    share = toxic[1] / np.maximum(1, toxic[0] + toxic[1])
    # of two features that say the same, chance ones have few texts: at a share q of toxic texts, n of n by chance is q ** n
    base = min(0.5, max(0.01, float(y.mean())))
    need = max(least, int(np.ceil(np.log(1e-7) / np.log(base))))
    sure = (share >= purity) & (toxic[1] >= need)
    sure[0] = False
    label = sure[feats].any(1)[which] & (y[doc] == 1)
    has = np.zeros(len(y), bool)
    has[doc[label]] = True
    return label.astype(float), has | (y == 0)


def train(texts: list[str], labels: np.ndarray, epochs: int = 12, rate: float = 0.5) -> Field:
    """Fits the field (AdaGrad on its log likelihood, whole documents in small batches), then the document scale."""
    field = Field()
    if not len(texts) or len(set(labels.tolist())) < 2:
        share = float(np.mean(labels)) if len(texts) else 0.5
        field.scale[0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return field
    tokens = Tokens(pa.array(texts))
    if not len(tokens.hash):
        field.scale[0] = np.log(labels.mean() / (1 - labels.mean()))
        return field
    gold, trains = _token_labels(tokens, labels)
    which, feats = tokens.features()
    doc = tokens.text_of()
    chain_doc = doc[tokens.chain[:-1]]
    sums, step_sums = np.full(1 << BITS, 1e-2), np.full((2, 2), 1.0)
    bias_sum = 1.0
    docs = np.flatnonzero(trains & (tokens.n > 0))
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(docs), max(1, len(docs) // 64)):
            mine = np.zeros(len(labels), bool)
            mine[part] = True
            chains = np.flatnonzero(mine[chain_doc])
            size = tokens.chain[chains + 1] - tokens.chain[chains]
            chain = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(tokens.chain[chains] - chain[:-1], size) + np.arange(chain[-1])
            f = feats[which[at]]
            e = field.weight[f].sum(1) + field.bias
            odds, fw, bw = marginals(e, chain, field.step)
            p, y = _sigmoid(odds), gold[at]
            g = p - y
            grad = np.bincount(f.ravel(), weights=np.repeat(g, f.shape[1]), minlength=1 << BITS) / len(part)
            grad[0] = 0
            sums += grad**2
            field.weight -= rate * grad / np.sqrt(sums)
            bg = g.sum() / len(part)
            bias_sum += bg**2
            field.bias -= rate * bg / np.sqrt(bias_sum)
            inner = np.setdiff1d(np.arange(1, chain[-1]), chain[1:-1], assume_unique=True)
            if len(inner):  # expected and given transitions
                a, b = fw[inner - 1], bw[inner] + e[inner]
                z = np.stack([np.zeros_like(a) + field.step[0, 0], b + field.step[0, 1], a + field.step[1, 0], a + b + field.step[1, 1]], 1)
                z = np.exp(z - z.max(1, keepdims=True))
                want = (z / z.sum(1, keepdims=True)).sum(0)
                given = np.bincount((2 * y[inner - 1] + y[inner]).astype(int), minlength=4)
                sg = ((want - given) / len(part)).reshape(2, 2)
                step_sums += sg**2
                field.step -= rate * 0.2 * sg / np.sqrt(step_sums)
    x, _ = field.evidence(tokens)
    w = np.array([0.0, 0.5, 0.0])
    for _ in range(30):  # Newton steps of a lightly held logistic regression
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(3) * 0.1
        w -= np.linalg.solve(h, x.T @ (p - labels) + 0.1 * w)
    field.scale = w
    return field


def toxicity_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    return train(*labelled_sample(docs, labels, "toxic", sample))


def toxicity_scores(docs: DataFrame, field: Field, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, `score` (0 to 1) and `spans` (start and end in code points, end exclusive, and the largest marginal p of each toxic run).

    Whole texts of any length are read. Null and empty texts have no spans and the score of no evidence; repeated rows score alike; an empty table gives an
    empty one. Kept columns called `score` or `spans` are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return map_texts(docs, text, keep, "`score` double, `spans` array<struct<start:long,end:long,p:double>>", lambda t: _scored(shared.value, t))


def _scored(field: Field, texts: pa.Array) -> dict:
    tokens = Tokens(texts)
    score, p = field.score(tokens)
    spans: list[list] = [[] for _ in tokens.n]
    on = p >= 0.5
    if on.any():
        point = np.concatenate([[0], np.cumsum((tokens.buf & 0xC0) != 0x80)])
        doc, last = tokens.text_of(), -2
        for t in np.flatnonzero(on).tolist():
            d = int(doc[t])
            base = int(point[tokens.off[d]])
            if t == last + 1 and spans[d]:
                spans[d][-1]["end"] = int(point[tokens.end[t]]) - base
                spans[d][-1]["p"] = max(spans[d][-1]["p"], float(p[t]))
            else:
                spans[d].append({"start": int(point[tokens.start[t]]) - base, "end": int(point[tokens.end[t]]) - base, "p": float(p[t])})
            last = t
    return {"score": score, "spans": spans}
