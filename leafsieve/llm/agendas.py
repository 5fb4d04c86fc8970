"""Merging the symbols of many words in step, with array operations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: The rank of a candidate that is none.
NONE = np.int32(1 << 30)
#: Widths by which words are worked off together; words with more letters are for others.
WIDTHS = (4, 8, 12, 20, 36, 64)
_K = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """A number for each pair of symbols, in an open hash table with few collisions, looked up for many pairs at once."""

    def __init__(self, pairs: dict[int, int]):
        """``pairs``: left << 32 | right to a number from 0 on."""
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, -1, dtype=np.int32)
        for (key, value), at in zip(pairs.items(), self._slot(np.fromiter(pairs, dtype=np.int64, count=len(pairs))).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.values[at] = key, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _K) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair, or -1."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        odd = np.flatnonzero((there != keys) & (there >= 0))
        while len(odd):
            at[odd] = (at[odd] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at[odd]] == keys[odd]
            out[odd[hit]] = self.values[at[odd[hit]]]
            odd = odd[~hit & (self.keys[at[odd]] >= 0)]
        return out


#: (words, place of the left symbol, left and right symbols) to (rank, symbol that they make).
Candidates = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def in_step(symbol: np.ndarray, sizes: np.ndarray, candidates: Candidates) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that are left of each word, one word after the other, and how many each has.

    ``symbol`` is (words, width). In each step every word makes its next merge, that of the least rank, the leftmost of equals.
    A symbol stays at the place of its first letter, and links lead to the symbols beside it, so a step writes a
    few cells a word.
    """
    words, width = symbol.shape
    columns = np.arange(width, dtype=np.int32)
    alive = columns < sizes[:, None]
    rank, piece = np.full(symbol.shape, NONE, dtype=np.int32), np.zeros(symbol.shape, dtype=np.int32)
    r, c = np.nonzero(alive[:, 1:])
    rank[r, c], piece[r, c] = candidates(r, c, symbol[r, c], symbol[r, c + 1])
    after, before = (np.tile(columns + np.int32(d), (words, 1)) for d in (1, -1))
    after[np.arange(words), sizes - 1] = width
    symbol, after, before, alive, piece, flat = (x.reshape(-1) for x in (symbol, after, before, alive, piece, rank))
    rows = np.arange(words)  # of ``rank``, which holds the words that have candidates
    while len(rows):
        at = rank.argmin(axis=1)
        go = np.flatnonzero(rank[np.arange(len(rows)), at] < NONE)
        if len(go) < 0.7 * len(rows):
            rows, rank, at = rows[go], rank[go], at[go]
            flat, go = rank.reshape(-1), np.arange(len(rows))
        else:
            at = at[go]
        row, own = rows[go] * width, go * width
        i = row + at
        j = after[i]
        beyond, ahead = after[row + j], before[i]
        symbol[i], after[i], alive[row + j], flat[own + j] = piece[i], beyond, False, NONE
        flat[own + at] = NONE
        right, left = np.flatnonzero(beyond < width), np.flatnonzero(ahead >= 0)
        before[row[right] + beyond[right]] = at[right]
        # The merged symbol meets the one after it, and the one before.
        of = np.concatenate((right, left))
        start = np.concatenate((at[right], ahead[left]))
        other = np.concatenate((beyond[right], at[left]))
        flat[own[of] + start], piece[row[of] + start] = candidates(rows[go[of]], start, symbol[row[of] + start], symbol[row[of] + other])
    return symbol[alive], alive.reshape(-1, width).sum(axis=1)
