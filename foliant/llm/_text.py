"""Words and shingles of many texts at once, as numpy arrays over the UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_SEGMENT = 1 << 19

#: Bytes of words that white space ends (0x20, 0x09 to 0x0D).
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of digits, letters and everything above ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Lower-cases A to Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes (the splitmix64 steps)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        x = np.full(max(n, _SEGMENT + 1), np.uint64(base))
        x[0] = 1
        _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers[key]


_BASE = 0xA0761D6478BD642F
_BACK = pow(_BASE, -1, 1 << 64)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more at the end). A null counts as empty."""
    a = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if a.buffers()[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """Words of a slice of texts. start, end: byte positions; at: the first word of each text (one more at the end); hash: 64 bits a word."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray, lower: bool = False):
        self.buf, self.off = utf8(texts)
        if lower:
            self.buf = LOWER[self.buf]
        on = is_word[self.buf]
        begins, ends = on.copy(), on.copy()
        begins[1:] &= ~on[:-1]
        ends[:-1] &= ~on[1:]
        edge = self.off[:-1][np.diff(self.off) > 0]
        begins[edge] = on[edge]
        last = self.off[1:][np.diff(self.off) > 0] - 1
        ends[last] = on[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.at = np.searchsorted(self.start, self.off)
        self.n = np.diff(self.at)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hashes(self.buf, self.start, self.end)
        return self._hash

    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.n)), self.n)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k words in a row for each word position, and which of the positions have k words left in their text."""
        h, n = self.hash, len(self.start)
        if n < k:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        g = h[: n - k + 1].copy()
        for j in range(1, k):
            g *= _GRAM
            g += h[j : n - k + 1 + j]
        g = mix(g + np.uint64(k))
        ok = np.zeros(n, bool)
        ok[: n - k + 1] = np.arange(n - k + 1) + k <= np.repeat(self.at[1:], self.n)[: n - k + 1]
        return np.concatenate([g, np.zeros(k - 1, np.uint64)]), ok


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans must be in order and may overlap within a segment."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + _SEGMENT)))
        lo, hi = int(start[i]), int(end[i:j].max())
        up, down = _power(_BASE, hi - lo + 1), _power(_BACK, hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[buf[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def sums_by(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive positions of at."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[at])


def fnv(text: str) -> int:
    """The hash that Words would give a word."""
    b = np.frombuffer(text.encode(), np.uint8)
    return int(span_hashes(b, np.array([0]), np.array([len(b)]))[0])
