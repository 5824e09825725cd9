"""A wavelet matrix over whole numbers, for many range queries at once.

Each level holds one bit of every number, packed, with counts of the ones before every
64; that is some 1.5 bits a number and level. All queries of a call go down the levels
together, as numpy arrays.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Ones before a place in a string of bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    def __init__(self, values: np.ndarray):
        self.size = len(values)
        top = int(values.max()) if self.size else 0
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones), self.size - int(ones.sum())))
            values = np.concatenate((values[~ones], values[ones]))
        self.limit = 1 << max(1, top.bit_length())

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the numbers at places low to high - 1 are less than value."""
        found = np.where(value >= self.limit, high - low, 0)
        value = np.clip(value, 0, self.limit - 1)
        low, high = low.copy(), high.copy()
        live = found == 0
        for bit, bits, zeros in self.levels:
            a, b = bits.ones(low), bits.ones(high)
            one = (value >> bit & 1).astype(bool)
            found += np.where(one & live, (high - low) - (b - a), 0)
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return found

    def ranked(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The number of that rank, from 0, among those at places low to high - 1.

        With the rank that `below` gives for a value, it is the least number that is
        not less than the value: the range successor.
        """
        low, high, rank = low.copy(), high.copy(), rank.copy()
        found = np.zeros(len(low), np.int64)
        for bit, bits, zeros in self.levels:
            a, b = bits.ones(low), bits.ones(high)
            none = (high - low) - (b - a)
            one = rank >= none
            found |= one.astype(np.int64) << bit
            rank = np.where(one, rank - none, rank)
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return found
