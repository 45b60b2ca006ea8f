"""A compressed full-text index over sequences of numbers, searched many patterns at a time."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank over a sequence of symbols: one packed bit vector per bit of the symbols, the highest first."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.words, self.ones, self.zeros = bits, [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def place(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Where the next occurrence of each symbol from ``before`` on lies in the order of the last level."""
        at = before
        for i in range(self.bits):
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            ones = self.ones[i][word] + np.bitwise_count(self.words[i][word] & ((np.uint64(1) << shift) - np.uint64(1)))
            set_ = (symbol >> (self.bits - 1 - i)) & 1 == 1
            at = np.where(set_, self.zeros[i] + ones, at - ones)
        return at


class FMIndex:
    """Index of a text of symbols >= 1 with 0 between its parts, for patterns of up to ``length`` symbols.

    Suffixes are sorted by their first symbols only, as many as a pattern has and more; the counts
    that backward search takes depend on no more than that.
    """

    def __init__(self, text: np.ndarray, length: int) -> None:
        n = len(text)
        self.size, self.length = n, length
        rank, reach = text.astype(np.int64), 1
        while True:
            order = np.argsort(rank, kind="stable")
            if reach >= length:
                break
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - reach)] = rank[reach:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + ahead
            _, rank = np.unique(key, return_inverse=True)
            reach *= 2
        self.suffixes = order
        last = text[order - 1]  # the symbol before the first is the final 0
        bits = max(1, int(text.max(initial=0)).bit_length())
        self.matrix = WaveletMatrix(last.astype(np.int64), bits)
        symbols = np.arange(int(text.max(initial=0)) + 2)
        counts = np.bincount(text, minlength=len(symbols))
        start = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.shift = start - self.matrix.place(symbols, np.zeros(len(symbols), np.int64))
        padded = np.concatenate([text, np.zeros(length, text.dtype)])
        same = np.ones(n, bool)
        for k in range(length):
            column = padded[order + k]
            same[1:] &= column[1:] == column[:-1]
            if k == length - 2:
                self._shorter = self._runs(same)
        self.first, self.last, self.run = self._runs(same)

    @staticmethod
    def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of the run of suffixes with an equal beginning that each suffix is in, and its number."""
        starts = ~same
        starts[:1] = True
        at = np.flatnonzero(starts)
        run = np.cumsum(starts) - 1
        return at[run], np.append(at[1:], len(same))[run], run

    def everywhere(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(n, np.int64), np.full(n, self.size, np.int64)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the suffixes that begin with the symbol and then as before."""
        shift = self.shift[symbol]
        return self.matrix.place(symbol, low) + shift, self.matrix.place(symbol, high) + shift

    def shorten(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From matches of the whole length to matches without the last symbol."""
        first, last, _ = self._shorter
        return first[low], last[high - 1]


def repeats_before(segments: list[np.ndarray], keys: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each segment, which of its windows of ``length`` symbols occur at a smaller key elsewhere.

    The segments are indexed together and streamed through the index from their ends, all at once:
    matching statistics are kept at ``length``, and every window that reaches it asks for the
    smallest key among its matches. ``keys`` has one number per window.
    """
    text = np.concatenate([np.concatenate([s, [0]]) for s in segments])
    index = FMIndex(text, length)
    sizes = np.array([len(s) for s in segments])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    windows = sizes - length + 1
    key = np.full(len(text), np.iinfo(np.int64).max)
    for b, k in zip(begin, keys):
        key[b: b + len(k)] = k
    runs = np.flatnonzero(np.concatenate([[True], index.run[1:] != index.run[:-1]]))
    least = np.minimum.reduceat(key[index.suffixes], runs)
    found = np.zeros(len(text), bool)
    low, high = index.everywhere(len(segments))
    on = np.arange(len(segments))
    for step in range(int(sizes.max())):
        keep = sizes[on] > step
        on, low, high = on[keep], low[keep], high[keep]
        at = begin[on] + sizes[on] - 1 - step
        if step >= length:
            low, high = index.shorten(low, high)
        low, high = index.extend(text[at], low, high)
        if step >= length - 1:
            found[at] = least[index.run[low]] < key[at]
    return [found[b: b + n] for b, n in zip(begin, windows)]
