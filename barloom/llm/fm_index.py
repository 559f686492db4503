"""Word-level FM-index of one text shard: wavelet-tree ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Ranks and symbols of an integer sequence; levels hold one bit of every symbol, the highest
    first, each level stably parted by the bit before it."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            one = self.ones[k][i]
            i = np.where((symbol >> (self.bits - 1 - k)) & 1, self.zeros[k] + one, i - one)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        return self.walk(symbol, i) - self.walk(symbol, np.zeros_like(i))

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for k in range(self.bits):
            ones, one = self.ones[k], self.ones[k][i]
            bit = ones[i + 1] - one
            symbol = symbol * 2 + bit
            i = np.where(bit, self.zeros[k] + one, i - one)
            start = np.where(bit, self.zeros[k] + ones[start], start - ones[start])
        return symbol, i - start


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of s, in which every 0 is a separator that differs from all others, by its position.
    Prefix doubling that sorts only what is still tied; ties end at the next separator."""
    n, gaps = len(s), int((s == 0).sum())
    key = np.where(s == 0, 0, s + gaps)
    key[s == 0] = np.arange(gaps)
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def renumber(slots: np.ndarray, changed: np.ndarray) -> np.ndarray:
        first = slots[changed]
        rank[sa[slots]] = first[np.cumsum(changed) - 1]
        size = np.diff(np.append(np.flatnonzero(changed), len(slots)))
        return slots[np.repeat(size > 1, size)]

    ordered = key[sa]
    slots = renumber(np.arange(n), np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    step = 1
    while len(slots):
        at = sa[slots]
        pair = rank[at] * n + rank[at + step]
        by = np.argsort(pair, kind="stable")
        sa[slots], pair = at[by], pair[by]
        slots = renumber(slots, np.concatenate([[True], pair[1:] != pair[:-1]]))
        step *= 2
    return sa


class FMIndex:
    """s: positive integers, runs of them between zeros; begins and ends with 0."""

    def __init__(self, s: np.ndarray, rate: int = 16):
        sa = suffix_order(s)
        before = s[sa - 1]
        before[sa == 0] = 0
        counts = np.bincount(s)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.tree = WaveletTree(before, max(1, int(s.max()).bit_length()))
        kept = (before == 0) | (sa % rate == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.positions = sa[kept]
        self.symbols = len(counts)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [low, high) of each pattern (rows filled with 0 behind their length), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.first[-1])
        live = np.flatnonzero((lengths > 0) & (patterns.max(1, initial=0) < self.symbols))
        high[np.setdiff1d(np.arange(len(patterns)), live)] = 0
        for back in range(1, patterns.shape[1] + 1):
            live = live[lengths[live] >= back]
            symbol = patterns[live, lengths[live] - back].astype(np.int64)
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
            live = live[high[live] > low[live]]
        return low, np.maximum(high, low)

    def locate(self, slots: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back until a sampled one. Starts of runs are sampled, so no step crosses a separator."""
        out, at, steps, todo = np.zeros(len(slots), np.int64), slots.copy(), 0, np.arange(len(slots))
        while len(todo):
            i = at[todo]
            found = self.kept_before[i + 1] > self.kept_before[i]
            out[todo[found]] = self.positions[self.kept_before[i[found]]] + steps
            todo = todo[~found]
            symbol, rank = self.tree.symbol_and_rank(at[todo])
            at[todo] = self.first[symbol] + rank
            steps += 1
        return out
