"""Double-array tries over small whole-number codes, built and walked with numpy.

A state ``s`` has the child of code ``c`` at ``base[s] + c`` if ``check`` of that place is ``s``.  Codes start at 1; the
root is state 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TRIES = 12       # windows of free places that are looked through before a family goes behind all others
WINDOW = 512


@dataclass(frozen=True)
class DoubleArray:
    base: np.ndarray
    check: np.ndarray

    @property
    def states(self) -> int:
        return len(self.base)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none.  States must be live, codes in range or 0 for 'unknown'."""
        at = self.base[states] + codes
        return np.where((codes > 0) & (self.check[at] == states), at, -1)


def digits(numbers: np.ndarray, highest: int) -> np.ndarray:
    """Numbers from 0 to ``highest`` as codes from 1 to 256, one column a digit: small families pack closely."""
    size = max(1, -(-int(highest).bit_length() // 8))
    return np.stack([(numbers >> (8 * i) & 255) + 1 for i in reversed(range(size))], axis=-1).astype(np.int64)


class _Places:
    """Taken places, in an array that grows."""

    def __init__(self, codes: int):
        self.codes, self.top = codes, 1
        self.taken = np.zeros(4 * codes + 1024, bool)
        self.taken[0] = True
        self.low = 1  # nearly all places below are taken

    def reserve(self, most: int) -> None:
        if most >= len(self.taken):
            grown = np.zeros(max(2 * len(self.taken), most + 1), bool)
            grown[:len(self.taken)] = self.taken
            self.taken = grown

    def family(self, codes: np.ndarray) -> int:
        """A base at which all (sorted) codes are free."""
        start = max(self.low, int(codes[0]))
        for _ in range(TRIES):
            if start >= self.top:
                break
            free = start + np.flatnonzero(~self.taken[start:start + WINDOW])
            if len(free):
                self.reserve(int(free[-1] + codes[-1]))
                fits = ~self.taken[(free - codes[0])[:, None] + codes[None, :]].any(axis=1)
                if fits.any():
                    return self._take(int(free[fits.argmax()] - codes[0]), codes)
            if start == self.low and len(free) < WINDOW // 16:
                self.low += WINDOW
            start += WINDOW
        return self._take(max(self.top - int(codes[0]), 0), codes)

    def _take(self, base: int, codes: np.ndarray) -> int:
        self.reserve(base + int(codes[-1]))
        self.taken[base + codes] = True
        self.top = max(self.top, base + int(codes[-1]) + 1)
        return base

    def singles(self, codes: np.ndarray) -> np.ndarray:
        """A base for each family of one child; the children fill the holes."""
        self.reserve(self.top + self.codes + len(codes))
        first = max(self.low, self.codes)
        free = first + np.flatnonzero(~self.taken[first:])[:len(codes)]
        if len(free) < len(codes):
            size = len(self.taken)
            self.reserve(size + len(codes))
            free = np.concatenate((free, np.arange(size, size + len(codes) - len(free))))
        self.taken[free] = True
        self.top = max(self.top, int(free[-1]) + 1)
        return free - codes


def build(paths: np.ndarray, codes: int) -> tuple[DoubleArray, np.ndarray]:
    """The trie of the distinct ``paths`` (rows of codes from 1 to ``codes``, of one length) and each path's last state."""
    rows, depth = paths.shape
    order = np.lexsort(paths.T[::-1])
    ordered = paths[order]
    places = _Places(codes)
    parents, links = [], []          # (state, base) and (child, state), level by level
    state = np.zeros(rows, np.int64)  # of each ordered path, so far
    new = np.zeros(rows, bool)
    new[:1] = True
    for level in range(depth):
        opens = new.copy()           # first path of each parent
        new[1:] |= ordered[1:, level] != ordered[:-1, level]
        child_at = np.flatnonzero(new)
        child_code, parent = ordered[child_at, level], state[child_at]
        family_at = np.flatnonzero(opens[child_at])
        size = np.diff(np.append(family_at, len(child_at)))
        base = np.empty(len(family_at), np.int64)
        for f in np.argsort(-size, kind="stable"):
            if size[f] == 1:
                break
            base[f] = places.family(child_code[family_at[f]:family_at[f] + size[f]])
        one = np.flatnonzero(size == 1)
        if len(one):
            base[one] = places.singles(child_code[family_at[one]])
        child = np.repeat(base, size) + child_code
        parents.append((parent[family_at], base))
        links.append((child, parent))
        state = child[np.cumsum(new) - 1]
    full = places.top + codes + 1
    bases, checks = np.zeros(full, np.int32), np.full(full, -1, np.int32)
    for at, base in parents:
        bases[at] = base
    for at, parent in links:
        checks[at] = parent
    ends = np.empty(rows, np.int64)
    ends[order] = state
    return DoubleArray(bases, checks), ends
