"""A compressed FM-index over integer sequences, in numpy: Burrows-Wheeler transform, wavelet matrix of packed bits, backward search of many patterns at once."""

from __future__ import annotations

import numpy as np


class PackedBits:
    """A bit vector of 64-bit words with running counts."""

    __slots__ = ("words", "before", "ones")

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate(([0], np.cumsum(counts[:-1], dtype=np.int64))).astype(np.int32)
        self.ones = int(counts.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, rest = [], symbols
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (rest >> bit) & 1 == 1
            self.levels.append((bit, PackedBits(ones), len(rest) - int(ones.sum())))
            rest = np.concatenate((rest[~ones], rest[ones]))
        self.origin = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbols >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._walk(symbols, at) - self.origin[symbols]


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffixes sorted by their first ``depth`` symbols or more, and the ranks by 1, 2, 4, ... symbols; a missing symbol is least."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank, width, ranks = _dense(symbols[order], order), 1, {}
    while True:
        ranks[width] = rank
        if width >= depth:
            return order, ranks
        key = rank * np.int64(n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        rank, width = _dense(key[order], order), width * 2


def _dense(sorted_keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], sorted_keys[1:] != sorted_keys[:-1])))
    return rank


class FMIndex:
    """An index of texts for windows of ``window`` symbols, without the suffixes' order.

    Symbols are 0 (parts texts) to sigma - 1. ``owners`` says whose each symbol is; of every
    window the least owner is kept. Held are the transform as packed bits, common prefixes
    of neighbouring suffixes up to ``window`` in a byte each, the borders from which wider
    intervals are found, and one number for each different window.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, window: int, owners: np.ndarray):
        self.window, self.size = window, len(symbols)
        order, ranks = suffix_order(symbols, window)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma))))
        self.bwt = WaveletMatrix(symbols[order - 1], sigma)
        self.common = self._common(order, ranks)
        self.left, self.right = self._borders()
        #: where the suffixes of one window begin, one more at the end, and the least owner of each
        self.heads = np.append(np.flatnonzero(self.common[:-1] < window), self.size).astype(np.int32)
        self.least = np.minimum.reduceat(owners[order], self.heads[:-1]) if self.size else owners

    def _common(self, order: np.ndarray, ranks: dict[int, np.ndarray]) -> np.ndarray:
        """Symbols, ``window`` at most, that a suffix has in common with the one before; none at both ends."""
        n = self.size
        a, b, out = order[:-1], order[1:], np.zeros(max(n - 1, 0), np.int64)
        for width in sorted(ranks, reverse=True):
            inside = (a + out + width <= n) & (b + out + width <= n)
            out += width * (inside & (ranks[width][np.minimum(a + out, n - 1)] == ranks[width][np.minimum(b + out, n - 1)]))
        return np.concatenate(([0], np.minimum(out, self.window), [0])).astype(np.uint8)

    def _borders(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place the nearest on either side that has less in common."""
        n, at = len(self.common), np.arange(len(self.common), dtype=np.int32)
        left, right = np.zeros(n, np.int32), np.full(n, self.size, np.int32)
        for value in np.unique(self.common)[1:]:
            less, own = self.common < value, self.common == value
            left[own] = np.maximum.accumulate(np.where(less, at, 0))[own]
            right[own] = np.minimum.accumulate(np.where(less, at, self.size)[::-1])[::-1][own]
        return left, right

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of the patterns."""
        both = self.bwt.rank(np.concatenate((symbols, symbols)), np.concatenate((lo, hi))) + np.concatenate((self.first[symbols],) * 2)
        return both[: len(lo)], both[len(lo) :]

    def shorten(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next wider interval of each, and the length of its pattern: the longest prefix that more suffixes have."""
        border = np.where(self.common[lo] >= self.common[hi], lo, hi)
        length = self.common[border].astype(np.int64)
        return np.where(length > 0, self.left[border], 0), np.where(length > 0, self.right[border], self.size), length

    def statistics(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the runs symbols[start:end]: at each position the symbols from there on that the index holds, ``window`` at most, and where these are ``window`` the window's number, else -1.

        The runs are streamed from right to left, side by side. A match is extended by one
        symbol to the left; where that fails it loses symbols on its right until it can be.
        """
        lengths, windows = np.zeros(len(symbols), np.int64), np.full(len(symbols), -1, np.int64)
        longest_first = np.argsort(starts - ends, kind="stable")
        starts, ends = starts[longest_first], ends[longest_first]
        sizes = ends - starts
        lo, hi, length = np.zeros(len(starts), np.int64), np.full(len(starts), self.size, np.int64), np.zeros(len(starts), np.int64)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            active = int(np.searchsorted(-sizes, -step, side="left"))
            at, open_ = ends[:active] - 1 - step, np.arange(active)
            while len(open_):
                a, b = self.extend(symbols[at[open_]], lo[open_], hi[open_])
                good = a < b
                done = open_[good]
                lo[done], hi[done] = a[good], b[good]
                length[done] += 1
                open_ = open_[~good]
                open_ = open_[length[open_] > 0]  # where nothing is left, the symbol doesn't occur
                lo[open_], hi[open_], length[open_] = self.shorten(lo[open_], hi[open_])
            full = np.flatnonzero(length[:active] >= self.window)
            number = np.searchsorted(self.heads, lo[full], side="right") - 1
            lo[full], hi[full], length[full] = self.heads[number], self.heads[number + 1], self.window
            lengths[at], windows[at[full]] = length[:active], number
        return lengths, windows
