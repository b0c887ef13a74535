"""An FM-index over the word symbols of one shard.

The Burrows-Wheeler transform is kept in a wavelet matrix, the balanced wavelet tree stored level by level,
whose bit vectors answer ranks from packed 64-bit words and a count before each word. All queries take
arrays and answer them together.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time ranks."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many ones come before position i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Rank and access over a sequence of symbols below ``2 ** levels``."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels, self.bits, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(int((~bit).sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol occurs before position i."""
        low = np.zeros_like(i)
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            below, upto = bits.ones(low), bits.ones(i)
            low = np.where(one, zeros + below, low - below)
            i = np.where(one, zeros + upto, i - upto)
        return i - low

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at position i, and how often it occurs before."""
        symbol, low, at = np.zeros_like(i), np.zeros_like(i), i
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            one = bits.at(at).astype(bool)
            below, upto = bits.ones(low), bits.ones(at)
            low = np.where(one, zeros + below, low - below)
            at = np.where(one, zeros + upto, at - upto)
            symbol = symbol << 1 | one
        return symbol, at - low


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling; the last symbol must be smaller than all others."""
    n, width = len(symbols), 1
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.diff(key[order]) != 0]).astype(np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Counts and places of patterns in ``symbols`` (all over 0; 0 ends the text)."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, every: int = 8) -> None:
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.size = len(text)
        self.transform = WaveletMatrix(text[order - 1], max(1, int(n_symbols).bit_length()))
        self.first = np.zeros(n_symbols + 2, np.int64)  # rows of smaller symbols
        np.cumsum(np.bincount(text, minlength=n_symbols + 1), out=self.first[1:])
        sampled = order % every == 0
        self.sampled, self.samples = Bits(sampled), order[sampled]

    def search(self, symbols: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns ``symbols[start : start + length]``, by backward search."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.size, np.int64)
        live, back = np.arange(len(start)), 1
        while len(live := live[(lengths[live] >= back) & (low[live] < high[live])]):
            symbol = symbols[start[live] + lengths[live] - back].astype(np.int64)
            low[live] = self.first[symbol] + self.transform.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.transform.rank(symbol, high[live])
            back += 1
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled one."""
        place, steps = np.zeros_like(rows), np.zeros_like(rows)
        left, at = np.arange(len(rows)), rows
        while len(left):
            known = self.sampled.at(at).astype(bool)
            place[left[known]] = self.samples[self.sampled.ones(at[known])] + steps[left[known]]
            left, at = left[~known], at[~known]
            steps[left] += 1
            symbol, before = self.transform.access(at)
            at = self.first[symbol] + before
        return place
