"""A wavelet matrix over a short alphabet, with vectorised rank queries."""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit sequence packed in 64-bit words, with the set bits before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, p: np.ndarray) -> np.ndarray:
        """Set bits among the first ``p``."""
        word, below = p >> 6, (np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Levels from the highest bit of the symbols down; each level deals them stably
    into zeros and ones, so a symbol's occurrences end up side by side."""

    def __init__(self, symbols: np.ndarray, n_bits: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        for bit in range(n_bits - 1, -1, -1):
            ones = (symbols >> bit) & 1 == 1
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
            self.levels.append((bit, BitRank(ones), len(symbols) - int(ones.sum())))

    def rank(self, symbol: int, p: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` among the first ``p`` symbols."""
        low, high = np.zeros(1, np.int64), np.asarray(p, np.int64)
        for bit, bits, zeros in self.levels:
            if symbol >> bit & 1:
                low, high = zeros + bits.ones(low), zeros + bits.ones(high)
            else:
                low, high = low - bits.ones(low), high - bits.ones(high)
        return high - low
