"""Words of many texts at once: one byte array, word limits and 64-bit word hashes, all in numpy.

Words are maximal runs of bytes outside a separator set, after lower-casing A-Z.  Both separator sets in use are
made of ASCII bytes only, so working on UTF-8 bytes and on code points gives the same words.
"""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
# Everything in ASCII but digits and small letters; capitals are lower-cased before.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_CODES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of the bytes between each start and end, finished with a mixer."""
    out = np.empty(len(starts), np.uint64)
    step = 1 << 17  # at a time, so that the byte-wide 64-bit arrays stay small
    for a in range(0, len(out), step):
        s, e = starts[a:a + step], ends[a:a + step]
        low = s.min()
        part = raw[low:e.max()]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODES[part] * _powers(_BASE, len(part)), out=sums[1:])
        inverse = _powers(_BASE_INVERSE, len(part) + 1)
        out[a:a + step] = mix64((sums[e - low] - sums[s - low]) * inverse[s - low] + (e - s).astype(np.uint64))
    return out


class Words:
    """``raw``: lower-cased bytes of all texts; word i is ``raw[start[i]:end[i]]`` and belongs to ``text[i]``;
    the words of text t are ``first[t]`` to ``first[t + 1]``."""

    def __init__(self, texts, separators: np.ndarray = SPACES):
        # A separator byte after each text keeps words of different texts apart.
        data = [("" if t is None else t).encode("utf-8", "surrogatepass") for t in texts]
        self.raw = _LOWER[np.frombuffer(b" ".join(data) + b" ", np.uint8)] if data else np.zeros(0, np.uint8)
        limits = np.cumsum([len(d) + 1 for d in data], dtype=np.int64)
        inside = np.concatenate(([False], ~separators[self.raw], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.concatenate(([0], np.searchsorted(self.start, limits))).astype(np.int64)
        self.n = np.diff(self.first)
        self.text = np.repeat(np.arange(len(data)), self.n)

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of all words, or of other limits inside them."""
        return hashed(self.raw, self.start if start is None else start, self.end if end is None else end)

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i]:self.end[i]].tobytes()


def shingle_sets(texts, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all shingles, text by text, and the offsets of each text in them.

    A text of fewer words is one shingle of its whole sequence; one without words has the empty set.
    """
    words = Words(texts)
    h, n, first = words.hashes(), words.n, words.first
    many = np.maximum(n - width + 1, 0)
    starts = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    full = np.zeros(len(starts), np.uint64)
    for t in range(width):
        full = mix64(full + h[starts + t])
    owner = np.repeat(np.arange(len(n)), many)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        single = np.zeros(len(short), np.uint64)
        for t in range(width):
            has = n[short] > t
            single[has] = mix64(single[has] + h[first[short][has] + t])
        single = mix64(single ^ n[short].astype(np.uint64))
        full, owner = np.concatenate((full, single)), np.concatenate((owner, short))
    order = np.lexsort((full, owner))
    full, owner = full[order], owner[order]
    if len(full):
        new = np.concatenate(([True], (full[1:] != full[:-1]) | (owner[1:] != owner[:-1])))
        full, owner = full[new], owner[new]
    return full, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(n))))).astype(np.int64)
