"""Vectorised word hashing over Arrow text buffers.

A word's hash is a polynomial over a table of 64-bit values, one per byte
value, modulo 2^64 with an odd base, read off prefix sums and mixed at the
end; an n-gram's hash is a polynomial over its word hashes.  All of it runs on
whole buffers, never word by word.  Hashes are the same in every process.
"""

from __future__ import annotations

import numpy as np

_M = (1 << 64) - 1
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD1342543DE82EF95 | 1
_TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = ~_SPACE


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inv)):
                p = np.full(size, base, U)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=U))
        return self.up, self.down


_BYTES, _GRAMS = _Powers(_BASE), _Powers(_GRAM)


def words(data: np.ndarray, off: np.ndarray, fold: bool = False):
    """Words (runs of bytes other than ASCII white space) of the texts in ``data``.

    Returns (hash, start byte, end byte) per word and the word offsets per
    text.  ``fold`` hashes A-Z as a-z.  No word crosses a text boundary.
    """
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return np.zeros(0, U), e, e, np.zeros(len(off), np.int64)
    isw = _WORD[data]
    brk = np.zeros(n + 1, bool)
    brk[off] = True
    first = isw.copy()
    first[1:] &= ~isw[:-1] | brk[1:n]
    last = isw.copy()
    last[:-1] &= ~isw[1:] | brk[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _BYTES.get(n + 1)
    acc = np.zeros(n + 1, U)
    np.cumsum((_FOLDED if fold else _TABLE)[data] * up[:n], out=acc[1:])
    h = mix((acc[e] - acc[s]) * down[s])
    return h, s, e, np.searchsorted(s, off)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k hashes starting at each position, len(h) - k + 1 of them."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    if k <= 12:
        up, _ = _GRAMS.get(k)
        out = h[:m].copy()
        for j in range(1, k):
            out += h[j:j + m] * up[j]
        return mix(out)
    up, down = _GRAMS.get(len(h) + 1)
    acc = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[:len(h)], out=acc[1:])
    return mix((acc[k:] - acc[:m]) * down[:m])


def span_hash(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of h[a:b] for each pair of positions."""
    up, down = _GRAMS.get(len(h) + 1)
    acc = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[:len(h)], out=acc[1:])
    return mix((acc[b] - acc[a]) * down[a] + (b - a).astype(U))


def text_of(wo: np.ndarray, n_words: int) -> np.ndarray:
    """Index of the text each word belongs to."""
    return np.repeat(np.arange(len(wo) - 1), np.diff(wo))[:n_words]


def shingles(h: np.ndarray, wo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes per text, sorted; offsets per text.

    A text of 1 to k-1 words has its whole sequence as its one shingle; an
    empty text has none.
    """
    n = len(wo) - 1
    cnt = np.diff(wo)
    doc, vals = [], []
    g = grams(h, k)
    if len(g):
        owner = text_of(wo, len(h))
        ok = owner[:len(g)] == owner[k - 1:]
        vals.append(g[ok])
        doc.append(owner[:len(g)][ok])
    few = np.flatnonzero((cnt > 0) & (cnt < k))
    if len(few):
        vals.append(span_hash(h, wo[few], wo[few + 1]))
        doc.append(few)
    if not vals:
        return np.zeros(0, U), np.zeros(n + 1, np.int64)
    v, d = np.concatenate(vals), np.concatenate(doc)
    order = np.lexsort((v, d))
    v, d = v[order], d[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[keep], d[keep]
    return v, np.searchsorted(d, np.arange(n + 1))
