"""An FM-index over integer symbols: suffix array, wavelet matrix, backward search, sampled locate.

All of it is vectorised over numpy arrays; queries go through the index in batches.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Every SAMPLE-th text position has its row marked; a locate walks fewer steps than that.
SAMPLE = 8


def suffix_array(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes. The last symbol must be 0 and occur nowhere else.

    The first sort is by as many symbols as fit one 63-bit key; then prefixes double, over
    the suffixes that are still tied only.
    """
    n, width = len(symbols), max(1, 63 // bits)
    padded = np.concatenate((symbols.astype(np.int64), np.zeros(width, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key)
    ordered = key[order]
    first = np.ones(n, bool)
    first[1:] = ordered[1:] != ordered[:-1]
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    tied = np.flatnonzero(~first | ~np.append(first[1:], True))
    while len(tied):
        suffixes = order[tied]
        both = group[tied] * n + rank[suffixes + width]
        by = np.argsort(both)
        both, suffixes = both[by], suffixes[by]
        order[tied] = suffixes
        first = np.ones(len(tied), bool)
        first[1:] = both[1:] != both[:-1]
        start = np.maximum.accumulate(np.where(first, tied, 0))
        group[tied] = start
        rank[suffixes] = start
        tied = tied[~first | ~np.append(first[1:], True)]
        width *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector a level, high bits first."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.n, self.bits = len(sequence), bits
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(self.n // 64 + 1, U)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(self.n - int(counts[-1]))
            sequence = np.concatenate((sequence[~bit], sequence[bit]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, below = at >> 6, (U(1) << (at & 63).astype(U)) - U(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & below)

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``at`` ends among the symbol's own entries of the last level."""
        for level in range(self.bits):
            ones = self._ones(level, at)
            at = np.where((symbols >> (self.bits - 1 - level)) & 1 == 1, self.zeros[level] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the positions, and where ``descend`` takes these positions for them."""
        symbols = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            bit = (self.words[level][at >> 6] >> (at & 63).astype(U)) & U(1) == 1
            ones = self._ones(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            symbols = symbols * 2 + bit
        return symbols, at


class FMIndex:
    """Index of a text of symbols 1..top; a closing 0 is added."""

    def __init__(self, text: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        text = np.append(text.astype(np.int64), 0)
        order = suffix_array(text, self.bits)
        self.wavelet = WaveletMatrix(text[order - 1], self.bits)
        self.below = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=top + 1), out=self.below[1:])
        self.base = self.wavelet.descend(np.arange(top + 1), np.zeros(top + 1, np.int64))
        marked = order % SAMPLE == 0
        self.marked = marked
        self.nth = np.cumsum(marked) - 1
        self.sampled = order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of right-aligned patterns, by backward search."""
        width = patterns.shape[1]
        lo, hi = self.below[patterns[:, -1]], self.below[patterns[:, -1] + 1]
        for step in range(1, width):
            live = np.flatnonzero((hi > lo) & (lengths > step))
            symbols = patterns[live, width - 1 - step]
            shift = self.below[symbols] - self.base[symbols]
            lo[live] = shift + self.wavelet.descend(symbols, lo[live])
            hi[live] = shift + self.wavelet.descend(symbols, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, walking back to a marked row."""
        positions, steps = np.full(len(rows), -1, np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            hit = self.marked[rows]
            positions[left[hit]] = self.sampled[self.nth[rows[hit]]] + steps
            left, rows = left[~hit], rows[~hit]
            symbols, at = self.wavelet.access(rows)
            rows = self.below[symbols] + at - self.base[symbols]
            steps += 1
        return positions
