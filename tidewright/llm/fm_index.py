"""An FM-index over a shard of word numbers: suffix order, wavelet ranks, sampled suffix positions.

All queries take arrays, so a shard answers every test phrase in a few vector steps.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of text in order, by prefix doubling; the last symbol is the smallest and unique."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    first = np.r_[True, text[order][1:] != text[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    slots, k = np.arange(n), 1
    while True:
        alone = first & np.r_[first[1:], True]
        slots = slots[~alone]
        if not len(slots):
            return order
        starts = order[slots]
        a, b = rank[starts], rank[np.minimum(starts + k, n - 1)]
        by = np.lexsort((b, a))
        starts, a, b = starts[by], a[by], b[by]
        order[slots] = starts
        first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        rank[starts] = np.maximum.accumulate(np.where(first, slots, 0))
        k *= 2


class Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before i."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Ranks of symbols in a sequence, one bit level a time."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels, self.zeros = [], []
        for level in range(depth - 1, -1, -1):
            ones = (symbols >> level & 1).astype(bool)
            self.levels.append(Bits(ones))
            self.zeros.append(int((~ones).sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands before i."""
        start, depth = np.zeros_like(i), len(self.levels)
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (depth - 1 - k) & 1).astype(bool)
            a, b = bits.ones(start), bits.ones(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it stands before i."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.at(i)
            a, b = bits.ones(start), bits.ones(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
            symbol = symbol << 1 | one
        return symbol, i - start


class FMIndex:
    """Counts and places of phrases in a text of symbols 1 .. top; a 0 is put behind it."""

    def __init__(self, text: np.ndarray, top: int, sample: int = 16):
        text = np.r_[text, 0].astype(np.int64)
        order = suffix_order(text)
        self.n = len(text)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=top + 1))]
        self.wavelet = Wavelet(text[order - 1], max(1, int(top).bit_length()))
        kept = order % sample == 0
        self.kept, self.places = Bits(kept), order[kept]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For phrases of one length, by backward search, the ranges of suffixes that begin with each."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            low[live] = self.before[c] + self.wavelet.rank(c, low[live])
            high[live] = self.before[c] + self.wavelet.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each suffix row, by steps back to a sampled position."""
        out, steps, live = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            found = self.kept.at(rows[live])
            done = live[found]
            out[done] = self.places[self.kept.ones(rows[done])] + steps
            live = live[~found]
            symbol, rank = self.wavelet.access(rows[live])
            rows[live] = self.before[symbol] + rank
            steps += 1
        return out

    def occurrences(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase number, text position) of every occurrence."""
        low, high = self.ranges(phrases)
        sizes = high - low
        which = np.repeat(np.arange(len(phrases)), sizes)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        return which, self.locate(rows)
