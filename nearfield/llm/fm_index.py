"""An FM-index over integer symbols, in numpy: suffix order, wavelet matrix, sampled positions.

Symbol 0 parts the text: every 0 counts as a symbol of its own, ordered by place,
so no suffix comparison goes past one and no pattern spans one.
"""

from __future__ import annotations

import numpy as np


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Places of ``s`` (which ends with 0) by the suffix that starts there."""
    n = len(s)
    zeros = np.flatnonzero(s == 0)
    reach = zeros[np.searchsorted(zeros, np.arange(n))] - np.arange(n)  # symbols before the next 0
    bits = max(1, int(s.max()).bit_length())
    depth = max(1, 62 // bits)
    padded = np.concatenate((s, np.zeros(depth, s.dtype))).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key = (key << bits) | np.where(reach >= j, padded[j : j + n], 0)
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    # A suffix whose 0 lies inside the key is placed for good by its place.
    new |= reach[order] < depth
    new[1:] |= reach[order][:-1] < depth
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group
    while True:
        ends = np.concatenate((new[1:], [True]))
        tied = np.flatnonzero(~(new & ends))
        if not len(tied):
            return order
        at = order[tied]
        further = rank[np.minimum(at + depth, n - 1)]
        fine = np.lexsort((at, further, group[tied]))
        order[tied] = at[fine]
        g, f = group[tied][fine], further[fine]
        new[tied] = np.concatenate(([True], (g[1:] != g[:-1]) | (f[1:] != f[:-1])))
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = group
        depth *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, sample: int = 16):
        s = np.asarray(symbols, np.int64)
        n = len(s)
        order = suffix_order(s)
        last = s[order - 1]
        last[order == 0] = 0
        self.n, self.bits = n, max(1, int(s.max()).bit_length())
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=1 << self.bits))))
        self.ones, self.zeros = [], []
        now = last
        for level in range(self.bits):
            bit = (now >> (self.bits - 1 - level)) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        kept = (order % sample == 0) | (last == 0)  # a step never leads over a 0
        self.kept = np.concatenate(([0], np.cumsum(kept, dtype=np.int32)))
        self.places = order[kept]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol of ``c`` stands before row i of the last column."""
        base = np.zeros_like(i)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            bit = ((c >> (self.bits - 1 - level)) & 1) == 1
            i = np.where(bit, zeros + ones[i], i - ones[i])
            base = np.where(bit, zeros + ones[base], base - ones[base])
        return i - base

    def step_back(self, i: np.ndarray) -> np.ndarray:
        """Rows of the suffixes one place further left."""
        c, at, base = np.zeros_like(i), i, np.zeros_like(i)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            bit = ones[at + 1] > ones[at]
            c = (c << 1) | bit
            at = np.where(bit, zeros + ones[at], at - ones[at])
            base = np.where(bit, zeros + ones[base], base - ones[base])
        return self.first[c] + at - base

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the patterns: right-aligned rows of a matrix, of the given lengths."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, width - 1 - k]
            known = c < (1 << self.bits)
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes of ``rows``."""
        out, steps = np.empty(len(rows), np.int64), 0
        todo, at = np.arange(len(rows)), rows
        while len(todo):
            found = self.kept[at + 1] > self.kept[at]
            out[todo[found]] = self.places[self.kept[at[found]]] + steps
            todo, at = todo[~found], self.step_back(at[~found])
            steps += 1
        return out
