"""FM-index over a row of integers in numpy: wavelet matrix, backward search, locating by sampled suffix positions.

All steps take many patterns or rows at a time.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of text (numbers from 0), by prefix doubling; only ties are sorted again."""
    n = len(text)
    _, number, times = np.unique(text, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - times)[number]
    order = np.argsort(rank, kind="stable")
    tied = np.arange(n)
    length = 1
    while True:
        same = rank[order[tied]]
        again = np.zeros(len(tied), bool)
        if len(tied) > 1:
            equal = same[1:] == same[:-1]
            again[1:] |= equal
            again[:-1] |= equal
        tied = tied[again]
        if not len(tied):
            return order
        at = order[tied]
        after = np.where(at + length < n, rank[np.minimum(at + length, n - 1)], -1)
        by = np.lexsort((after, rank[at]))
        at, after = at[by], after[by]
        order[tied] = at
        # A suffix's rank is its place in the order, or that of the first it equals so far.
        group = rank[at]
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        base = np.empty(len(at), bool)
        base[0] = True
        base[1:] = group[1:] != group[:-1]
        first_of_group = np.maximum.accumulate(np.where(base, np.arange(len(at)), 0))
        first_of_new = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank[at] = group + (first_of_new - first_of_group)
        length *= 2


class WaveletMatrix:
    """rank(c, i): how often c is among the first i symbols. One bit row and its running count for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []
        row = symbols.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = (row >> b) & 1
            ones = np.zeros(len(row) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(row) - int(ones[-1])
            self.levels.append((ones, zeros))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        self.row = row
        """The symbols in the order of the last level: equal ones stand together."""

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        a = np.zeros(len(c), np.int64)
        i = i.astype(np.int64)
        for b, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            bit = (c >> b) & 1 == 1
            a = np.where(bit, zeros + ones[a], a - ones[a])
            i = np.where(bit, zeros + ones[i], i - ones[i])
        return np.where(c < (1 << self.bits), i - a, 0)

    def symbol(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        i = i.astype(np.int64)
        for ones, zeros in self.levels:
            bit = ones[i + 1] - ones[i]
            c = c * 2 + bit
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
        return c


class FMIndex:
    """Index of segments of positive numbers. In the text each segment is followed by a separator, symbol 0.

    Separators sort by their place, below all symbols, so suffixes differ by the end of their segments at the latest. The first
    place of each segment and every sample-th place are kept for locating.
    """

    def __init__(self, segments: list[np.ndarray], sample: int = 16) -> None:
        zero = np.zeros(1, np.int64)
        text = np.concatenate([x for s in segments for x in (s, zero)] or [zero]).astype(np.int64)
        ends = np.flatnonzero(text == 0)
        sortable = text + len(ends)
        sortable[ends] = np.arange(len(ends))
        order = suffix_array(sortable)
        bwt = text[order - 1]
        self.n = len(text)
        self.tree = WaveletMatrix(bwt)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text))))
        kept = np.arange(self.n) % sample == 0
        kept[0] = True
        kept[ends[:-1] + 1] = True
        marked = kept[order]
        self.marked = marked
        self.marks_before = np.concatenate(([0], np.cumsum(marked)))
        self.places = order[marked]

    def _step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.below[np.minimum(c, len(self.below) - 1)] + self.tree.rank(c, i)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows whose suffixes begin with each pattern (a row of patterns, its first lengths entries)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        top = len(self.below) - 1
        for back in range(1, int(lengths.max(initial=0)) + 1):
            at = np.flatnonzero((lengths >= back) & (low < high))
            c = patterns[at, lengths[at] - back]
            low[at], high[at] = np.where(c < top, self._step(c, low[at]), 0), np.where(c < top, self._step(c, high[at]), 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row's suffix: steps back to the next sampled one."""
        rows = rows.astype(np.int64)
        steps, out = np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = self.marked[rows[open_]]
            done = open_[here]
            out[done] = self.places[self.marks_before[rows[done]]] + steps[done]
            open_ = open_[~here]
            rows[open_] = self._step(self.tree.symbol(rows[open_]), rows[open_])
            steps[open_] += 1
        return out
