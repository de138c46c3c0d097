"""FM-index over the words of one shard, with numpy.

The shard is a sequence of symbols: words of the phrase vocabulary are 1, 2, ...; 0 is a break that
no phrase crosses. Each break counts as a symbol of its own, smaller than all words and ordered by
place, so a suffix is decided at the next break at the latest.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling over those that are still tied. The last symbol must be
    a break."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (ranked[1:] != ranked[:-1]) | (ranked[1:] == 0)
    heads = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = heads
    tied = ~fresh
    tied[:-1] |= ~fresh[1:]
    rows = np.flatnonzero(tied)  # places in the order whose group has several suffixes
    step = 1
    while len(rows):
        at = order[rows]
        head = rank[at]
        key = head * (n + 1) + rank[at + step]
        by = np.argsort(key, kind="stable")
        at, head, key = at[by], head[by], key[by]
        order[rows] = at
        fresh = np.ones(len(rows), bool)
        fresh[1:] = key[1:] != key[:-1]
        heads = rows[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]
        rank[at] = heads
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        rows = rows[tied]
        step *= 2
    return order


class WaveletMatrix:
    """Rank of any symbol in a sequence: one bit vector per bit of the symbols, with its counts."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.n = len(symbols)
        self.bits = max(1, int(largest).bit_length())
        self.ones, self.zeros = [], []
        rest = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (rest >> level) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            one = bit.astype(bool)
            rest = np.concatenate([rest[~one], rest[one]])
        every = np.arange(largest + 1)
        self.base = np.zeros(largest + 1, np.int64)
        self.base = self._walk(every, np.zeros(largest + 1, np.int64))

    def _walk(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            before = ones[ends].astype(np.int64)
            ends = np.where((symbols >> level) & 1, zeros + before, ends - before)
        return ends

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the place given with it."""
        return self._walk(symbols, ends) - self.base[symbols]


class FMIndex:
    def __init__(self, symbols: np.ndarray, largest: int, every: int = 16):
        suffixes = suffix_array(symbols)
        self.last = symbols[suffixes - 1]  # the symbol before each suffix
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=largest + 1))])
        self.ranks = WaveletMatrix(self.last, largest)
        kept = (suffixes % every == 0) | (self.last == 0)
        self.kept = kept
        self.kept_before = np.cumsum(kept) - 1
        self.places = suffixes[kept]

    def _step(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.first[symbols] + self.ranks.rank(symbols, rows)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of suffixes that begin with each phrase (a matrix with a phrase per row), as first
        and end."""
        count, length = phrases.shape
        low, high = np.zeros(count, np.int64), np.full(count, len(self.last), np.int64)
        alive = np.arange(count)
        for column in range(length - 1, -1, -1):
            symbols = phrases[alive, column]
            low[alive] = self._step(symbols, low[alive])
            high[alive] = self._step(symbols, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of each suffix: steps back to the next sampled one. All steps stay between two
        breaks, because the first suffix after a break is always sampled."""
        rows, found = rows.copy(), np.empty(len(rows), np.int64)
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            hit = self.kept[rows[open_]]
            done = open_[hit]
            found[done] = self.places[self.kept_before[rows[done]]] + steps
            open_ = open_[~hit]
            rows[open_] = self._step(self.last[rows[open_]], rows[open_])
            steps += 1
        return found
