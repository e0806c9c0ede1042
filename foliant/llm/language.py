"""Language identification with interpolated Kneser-Ney character models.

Spark counts character n-grams (orders 1 to ORDER) of words, each between two spaces, for each language; the counts of a bounded number of training
documents a language are enough (SAMPLE). The driver turns them into probabilities: an n-gram's discounted count (a discount for each order and language), plus what the discounts leave
times the probability of the next shorter n-gram, whose counts are those of different characters before it. They are stored as sorted arrays of
n-gram hashes with one row of log probabilities a language, and sorted hashes of contexts with one row of back-off weights.

A text's cross-entropy under each language is the mean over its characters; the least wins. Its score is the winner's share of the softmax of the
log likelihoods for so many characters, at most TEMPER. Texts whose best cross-entropy is above the winner's limit, the RELIABLE quantile of
sampled documents that weren't counted (one in CALIBRATION) and a tenth more, are marked as not accepted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import map_texts, table
from ._text import mix

ORDER, SAMPLE, TEMPER, RELIABLE, CALIBRATION = 4, 1_000, 20, 0.999, 5
#: Sampled documents of a language have about so many bytes at most, and none more than a hundredth of it.
SAMPLE_BYTES = 64_000_000
_SPACE = 0x20
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point: 0 if it isn't a letter, else the code point itself."""
    if not _letters:
        s = np.arange(0x110000, dtype="<u4")
        is_letter = np.zeros(0x110000, bool)
        is_letter[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True
        _letters.append(np.where(is_letter, s, 0).astype(np.uint32))
    return _letters[0]


class Chars:
    """Distinct words (runs of lower-cased letters) of a slice of texts, each between two spaces."""

    def __init__(self, texts: pa.Array):
        lists = [(t or "").lower() for t in texts.to_pylist()]
        points = np.frombuffer("\n".join([*lists, ""]).encode("utf-32-le", "replace"), np.uint32)
        text = letters()[np.minimum(points, 0x10FFFF)]
        on = text > 0
        begins, ends = on.copy(), on.copy()
        begins[1:] &= ~on[:-1]
        ends[:-1] &= ~on[1:]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        off = np.cumsum([0, *[len(t) + 1 for t in lists]])
        self.at = np.searchsorted(start, off)
        h = np.zeros(len(start), np.uint64)
        size = end - start
        if len(start):  # hashes of the words: sums of mixed letters times powers
            v = mix(text.astype(np.uint64) + np.uint64(77))
            pos = np.arange(len(text)) - start[np.maximum(0, np.cumsum(begins) - 1)]
            h = np.add.reduceat(np.where(on, v * _odd_powers(pos), np.uint64(0)), start)
        _, first, self.which = np.unique(h, return_index=True, return_inverse=True)
        s, n = start[first], size[first] + 2
        self.word_at = np.concatenate([[0], np.cumsum(n)])
        inner = np.arange(self.word_at[-1]) - np.repeat(self.word_at[:-1], n)
        body = (inner > 0) & (inner < np.repeat(n, n) - 1)
        self.inner = inner
        self.chars = np.full(self.word_at[-1], _SPACE, np.uint32)
        self.chars[body] = text[(np.repeat(s, n) + inner - 1)[body]]
        self.code = mix(self.chars.astype(np.uint64) + np.uint64(1))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n characters that end at each position, and the positions that have as many in their word."""
        h = self.code.copy()
        for j in range(1, n):
            h[j:] = h[j:] + self.code[:-j] * np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        return mix(h + np.uint64(n)), self.inner >= n - 1


_pow: list[np.ndarray] = []


def _odd_powers(pos: np.ndarray) -> np.ndarray:
    top = int(pos.max()) + 1
    if not _pow or len(_pow[0]) < top:
        x = np.full(max(top, 1024), np.uint64(0xA0761D6478BD642F))
        x[0] = 1
        _pow[:] = [np.cumprod(x, dtype=np.uint64)]
    return _pow[0][np.maximum(pos, 0)]


class Models:
    """Log probabilities (n-grams x languages) and back-off weights (contexts x languages) by sorted hash, for each order."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.backs: list[tuple[np.ndarray, np.ndarray]] = []
        self.floor = np.log(1e-6)
        self.limit = np.full(len(langs), np.inf)

    def _word_logs(self, c: Chars) -> np.ndarray:
        """Log probability of each distinct word's letters and last space, a column a language."""
        n, top = len(c.chars), len(self.grams)
        total = np.zeros((n, len(self.langs)))
        open_ = c.inner > 0  # positions without a probability as yet
        for order in range(top, 0, -1):
            h, ok = c.ngrams(order)
            pos = np.flatnonzero(open_ & ok)
            keys, logs = self.grams[order - 1]
            if not len(pos) or not len(keys):
                continue
            i = np.minimum(np.searchsorted(keys, h[pos]), len(keys) - 1)
            hit = keys[i] == h[pos]
            total[pos[hit]] += logs[i[hit]]
            open_[pos[hit]] = False
            if order > 1 and (miss := pos[~hit]).size:
                ctx = c.ngrams(order - 1)[0][miss - 1]
                bk, bw = self.backs[order - 1]
                j = np.minimum(np.searchsorted(bk, ctx), len(bk) - 1)
                seen = bk[j] == ctx
                total[miss[seen]] += bw[j[seen]]
        total[open_] += self.floor
        return np.add.reduceat(total, c.word_at[:-1]) if len(c.word_at) > 1 else np.zeros((0, len(self.langs)))

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character (texts x languages), and the number of characters; 0 for texts without letters."""
        c = Chars(texts)
        size = (np.diff(c.word_at) - 1)[c.which] if len(c.which) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([[0], np.cumsum(size)])[c.at])
        logs = np.zeros((len(c.at) - 1, len(self.langs)))
        if len(c.which):
            words = self._word_logs(c)
            for k in range(len(self.langs)):
                logs[:, k] = np.diff(np.concatenate([[0.0], np.cumsum(words[c.which, k])])[c.at])
        return -logs / np.maximum(1, n)[:, None], n

    def predict(self, texts: pa.Array) -> dict:
        e, n = self.entropies(texts)
        lang, score, entropy, ok = ["und"] * len(n), np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), bool)
        if self.langs and len(n):
            best = e.argmin(1)
            odds = np.exp(-(e - e.min(1, keepdims=True)) * np.minimum(n, TEMPER)[:, None])
            has = n > 0
            lang = [self.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
            score = np.where(has, 1 / odds.sum(1), 0.0)
            entropy = np.where(has, e.min(1), 0.0)
            ok = has & (entropy <= self.limit[best])
        return {"lang_pred": lang, "score": score, "cross_entropy": entropy, "accepted": ok}


def fit(counts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], langs: list[str]) -> Models:
    """counts: for each order the n-grams' hash, context hash (all but the last character), shorter hash (all but the first), language index, count."""
    m = Models(langs)
    size = len(langs)
    lower: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    use: list[tuple] = [None] * len(counts)
    for order in range(len(counts), 0, -1):
        h, ctx, short, lang, n = counts[order - 1]
        if order < len(counts):  # continuation counts: different n-grams of the next order that end in this one
            _, _, up_short, up_lang, _ = counts[order]
            key = np.stack([up_short, up_lang.astype(np.uint64)], 1)
            kinds, many = np.unique(key, axis=0, return_counts=True)
            lookup = dict(zip(map(tuple, kinds.tolist()), many.tolist(), strict=True))
            n = np.array([lookup.get(k, 0) or c for k, c in zip(zip(h.tolist(), lang.tolist(), strict=True), np.minimum(n, 1).tolist(), strict=True)], float)
        use[order - 1] = (h, ctx, short, lang, n.astype(float))
    for order, (h, ctx, short, lang, n) in enumerate(use, 1):
        keys, row = np.unique(h, return_inverse=True)
        table = np.zeros((len(keys), size))
        table[row, lang] = n
        first = np.zeros(len(keys), np.int64)
        first[row] = np.arange(len(h))
        ones, twos = (np.bincount(lang[n == k], minlength=size) for k in (1, 2))
        cut = np.where((ones > 0) & (twos > 0), ones / np.maximum(1, ones + 2 * twos), 0.5)
        ckeys, crow = np.unique(ctx[first], return_inverse=True)
        total, kinds = np.zeros((len(ckeys), size)), np.zeros((len(ckeys), size))
        np.add.at(total, crow, table)
        np.add.at(kinds, crow, table > 0)
        back = np.where(total > 0, cut * kinds / np.maximum(total, 1e-9), 1.0)
        if order == 1:
            below = np.full((len(keys), size), 1e-4)
        else:
            lk, lp = lower[order - 1]
            i = np.minimum(np.searchsorted(lk, short[first]), len(lk) - 1)
            below = np.where((lk[i] == short[first])[:, None], lp[i], np.exp(m.floor))
        p = np.maximum(table - cut, 0) / np.maximum(total[crow], 1e-9) + back[crow] * below
        lower[order] = (keys, p)
        m.grams.append((keys, np.log(np.maximum(p, 1e-9)).astype(np.float32)))
        m.backs.append((ckeys, np.log(np.clip(back, 1e-6, 1)).astype(np.float32)))
    return m


def _counted(texts: pa.Array, langs: pa.Array, order: int) -> list[tuple[str, int, int, int, int, int]]:
    out = []
    names = np.array(langs.to_pylist())
    for name in sorted(set(names.tolist())):
        c = Chars(texts.filter(pa.array(names == name)))
        times = np.bincount(c.which, minlength=len(c.word_at) - 1)
        owner = np.repeat(np.arange(len(times)), np.diff(c.word_at))
        for n in range(1, order + 1):
            h, ok = c.ngrams(n)
            pos = np.flatnonzero(ok & (c.inner > 0))
            less = c.ngrams(n - 1)[0] if n > 1 else np.zeros(len(h), np.uint64)
            keys, first, back = np.unique(h[pos], return_index=True, return_inverse=True)
            many = np.bincount(back, weights=times[owner[pos]]).astype(np.int64)
            p = pos[first]
            out.append((name, n, keys, less[p - 1] if n > 1 else less[p], less[p], many))
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, sample: int = SAMPLE, key: list[str] | None = None,
    sample_bytes: int = SAMPLE_BYTES) -> Models:
    """Fits the models on rows of docs with a language: of each language about `sample` documents, picked by a hash of `key` (doc_id if there is one) and text, for counts need no more. Of these a part is set aside to calibrate; only a
    language with too few documents for that calibrates on those it counts."""
    from ._spark import ship
    from .quality import below

    spark = docs.sparkSession
    ship(spark)
    key = key or (["doc_id"] if "doc_id" in docs.columns else [text, lang])
    rows = docs.select(F.xxhash64(*key, text).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where(
        "t is not null and l is not null")
    rows = rows.where(F.octet_length("t") <= max(1, sample_bytes // 100))
    sizes = {r["l"]: (r["n"], r["b"]) for r in rows.groupBy("l").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("b")).collect(
        )}  # a model has a column a language
    langs = sorted(sizes)
    if not langs:
        return Models([])
    limit = lambda n, b: min(2**63 - 1, int(min(1.0, sample / n, sample_bytes / max(1, b)) * 2**64) - 2**63)
    limits = spark.createDataFrame([(k, limit(n, b)) for k, (n, b) in sizes.items()], "l string, most long")
    sampled = table(rows.join(F.broadcast(limits), "l").where(F.xxhash64("k") <= F.col("most")).select("t", "l",
        (F.pmod(F.xxhash64("k", F.lit(1)), F.lit(CALIBRATION)) == 0).alias("held")), "language-sample")
    parts = sampled.groupBy("l").agg(F.count_if("held").alias("h"), F.count_if(~F.col("held")).alias("p")).where("h = 0 or p = 0")
    few = F.col("l").isin([r["l"] for r in parts.collect()])  # languages with too few documents to set some aside
    held, picked = (sampled.where(few | F.col("held") if of_held else few | ~F.col("held")).select("t", "l") for of_held in (True, False))

    def run(batches):
        for b in batches:
            for name, n, h, ctx, short, many in _counted(b.column(0), b.column(1), order):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(np.full(len(h), n, np.int32)),
                    *[pa.array(x.view(np.int64)) for x in (h, ctx, short)], pa.array(many)], names=["l", "n", "h", "c", "s", "many"])

    grams = picked.mapInArrow(run, "l string, n int, h long, c long, s long, many long").groupBy("l", "n", "h", "c", "s").agg(F.sum("many").alias("many"))
    got = grams.toArrow()
    index = {name: i for i, name in enumerate(langs)}
    n, li = got.column("n").to_numpy(), np.array([index[x] for x in got.column("l").to_pylist()], np.int64)
    h, c, s = (got.column(x).to_numpy().view(np.uint64) for x in ("h", "c", "s"))
    many = got.column("many").to_numpy()
    if not len(n):
        return Models([])
    counts = []
    for k in range(1, order + 1):
        at = np.flatnonzero(n == k)
        at = at[np.lexsort((li[at], h[at]))]
        counts.append((h[at], c[at], s[at], li[at], many[at]))
    models = fit(counts, langs)
    calibration = predictions(held, models, ["l"], "t").where("l = lang_pred").groupBy("l").agg(F.percentile_approx("cross_entropy", RELIABLE).alias(
        "q")).collect()
    for r in calibration:
        models.limit[index[r["l"]]] = r["q"] * 1.1
    return models


def predictions(docs: DataFrame, models: Models, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, lang_pred, score, cross_entropy (nats a character) and accepted (the calibrated verdict) for each row.

    A null text, and one without a letter, is `und` with score 0; so is every text if no language was learned. Repeated rows are judged alike; of languages that
    tie, the first by name wins. Texts of any length are read whole. An empty table gives an empty one. Kept columns with the name of a new one are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    return map_texts(docs, text, keep, "lang_pred string, score double, cross_entropy double, accepted boolean", lambda t: shared.value.predict(t))
