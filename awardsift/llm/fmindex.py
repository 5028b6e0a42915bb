"""A compressed FM-index over word sequences: wavelet matrix of the Burrows-Wheeler transform, searched many texts at a time."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.append(bits, np.zeros(-len(bits) % 64 + 64, bool)), bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words)[:-1], dtype=np.int64))).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Occurrences of a symbol before a place, in one step for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels, self.zeros = [], []
        left = symbols
        for level in reversed(range(self.depth)):
            bit = (left >> level) & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(int((~bit).sum()))
            left = np.concatenate((left[~bit], left[bit]))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.ones(at)
            at = np.where((symbol >> (self.depth - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at

    def ranks(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._walk(symbol, at) - self._walk(symbol, np.zeros_like(at))


class FMIndex:
    """Passages (sequences of symbols from 1) and, for every substring of up to ``depth`` symbols, the smallest owner.

    Passages end with 0, and every end is a symbol of its own in the order of suffixes, so no match runs over an end.
    """

    def __init__(self, passages: list[np.ndarray], owners: np.ndarray, depth: int):
        lengths = np.array([len(p) + 1 for p in passages])
        text = np.concatenate([np.append(p, 0) for p in passages]).astype(np.int64)
        self.depth, self.size = depth, int(text.max()) + 1
        order, common = _suffixes(text, lengths, depth)
        self.wavelet = WaveletMatrix(text[order - 1], self.size)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.size))))
        # runs of suffixes that share their first ``length`` symbols
        self.runs = [np.append(np.flatnonzero(common < length), len(text)) for length in range(depth + 1)]
        owner = np.repeat(owners, lengths)[order]
        self.least = np.minimum.reduceat(owner, self.runs[depth][:-1])

    def _back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = self.smaller[symbol]
        start = self.wavelet._walk(symbol, np.zeros_like(low))
        return base + self.wavelet._walk(symbol, low) - start, base + self.wavelet._walk(symbol, high) - start

    def _shrink(self, length: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Widen intervals in place to the suffixes that share their first ``length`` symbols."""
        for n in np.unique(length):
            mine = np.flatnonzero(length == n)
            run = np.searchsorted(self.runs[n], low[mine], "right") - 1
            low[mine], high[mine] = self.runs[n][run], self.runs[n][run + 1]

    def matching(self, texts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Matching statistics of texts, read from their ends: at each place the longest match, up to ``depth``, that
        starts there; and the smallest owner where it is ``depth`` long (else the largest integer).

        Symbols that the index does not have are 0. All texts go one symbol back at a time.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        flat = np.concatenate([*texts, np.empty(0, np.int64)]).astype(np.int64)
        match, owner = np.zeros(len(flat), np.int64), np.full(len(flat), np.iinfo(np.int64).max)
        order = np.argsort(-lengths, kind="stable")
        total = int(self.smaller[-1])
        low, high, length = np.zeros(len(texts), np.int64), np.full(len(texts), total), np.zeros(len(texts), np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = order[: int(np.searchsorted(-lengths[order], -step, "left"))]
            symbol = flat[ends[live] - 1 - step]
            a, b, n = low[live], high[live], length[live]
            full = np.flatnonzero(n == self.depth)
            if len(full):
                x, y = a[full], b[full]
                self._shrink(np.full(len(full), self.depth - 1), x, y)
                a[full], b[full], n[full] = x, y, self.depth - 1
            open_ = np.arange(len(live))
            known = (symbol > 0) & (symbol < self.size)
            a[~known], b[~known], n[~known] = 0, total, 0
            open_ = open_[known]
            while len(open_):
                x, y = self._back(symbol[open_], a[open_], b[open_])
                hit = x < y
                done = open_[hit]
                a[done], b[done], n[done] = x[hit], y[hit], n[done] + 1
                open_ = open_[~hit & (n[open_] > 0)]  # an absent symbol ends with no match at all
                x, y = a[open_], b[open_]
                self._shrink(n[open_] - 1, x, y)
                a[open_], b[open_], n[open_] = x, y, n[open_] - 1
            low[live], high[live], length[live] = a, b, n
            place = ends[live] - 1 - step
            match[place] = n
            full = n == self.depth
            owner[place[full]] = self.least[np.searchsorted(self.runs[self.depth], a[full], "right") - 1]
        cuts = ends[:-1]
        return np.split(match, cuts), np.split(owner, cuts)


def _suffixes(text: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by prefix doubling, and how many symbols (up to ``depth``) each suffix shares with the one before it."""
    size = len(text)
    rank = text + len(lengths)
    rank[np.cumsum(lengths) - 1] = np.arange(len(lengths))
    reach, longest = 1, int(lengths.max())
    while True:
        ahead = np.concatenate((rank[reach:], np.full(min(reach, size), -1)))[:size]
        key = rank * (int(rank.max()) + 2) + ahead + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(size, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
        reach *= 2
        if reach >= longest:
            break
    common = np.zeros(size, np.int64)
    common[0] = -1  # nothing before the first: it begins a run of any length
    open_ = np.arange(1, size)
    for k in range(depth):
        x, y = order[open_] + k, order[open_ - 1] + k
        inside = (x < size) & (y < size)
        open_, x, y = open_[inside], x[inside], y[inside]
        open_ = open_[(text[x] == text[y]) & (text[x] > 0)]
        common[open_] += 1
    return order, common
