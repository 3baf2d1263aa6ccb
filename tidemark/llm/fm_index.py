"""A compressed FM-index over sequences of symbols: a wavelet matrix of variable-length codes, searched for many patterns
at once. Frequent symbols have short codes, so n symbols of entropy H take less than n (H + 1) bits, and half as much again
for the counts that make ranks quick."""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with the number of ones before each word of 64."""

    def __init__(self, bit: np.ndarray):
        self.size = len(bit)
        self.words = np.packbits(np.r_[bit, np.zeros(64 - len(bit) % 64, dtype=bit.dtype)].astype(np.uint8), bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.uint32)

    def __len__(self) -> int:
        return self.size

    def ones(self, at: np.ndarray) -> np.ndarray:
        """The ones before each place."""
        word, low = at >> 6, (at & 63).astype(np.uint64)
        return (self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))).astype(np.int64)


def shannon_codes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A prefix code for symbols of these counts: the bits and the length of each (0 for what doesn't occur).

    In a wavelet matrix the codes of a level lie by their bits, the last one first; codes that end at a level are taken
    from its end, so those that go on keep their places."""
    total = int(counts.sum())
    length = np.zeros(len(counts), dtype=np.int64)
    some = np.flatnonzero(counts)
    length[some] = np.maximum(1, np.ceil(np.log2(total / counts[some]) - 1e-9).astype(np.int64))
    code, free = np.zeros(len(counts), dtype=np.int64), np.zeros(1, dtype=np.int64)
    per_length = np.bincount(length[some], minlength=1)
    for level in range(1, len(per_length)):
        free = np.concatenate([free << 1, free << 1 | 1])
        own = np.flatnonzero(length == level)
        code[own] = free[len(free) - len(own) :]
        free = free[: len(free) - len(own)]
        deeper = np.arange(level + 1, len(per_length))
        free = free[: int(np.ceil(float((per_length[deeper] * 0.5 ** (deeper - level)).sum())))]  # what the others need
    return code, length


class WaveletMatrix:
    """rank of any symbol: for each bit of the codes, from the first, the bits of the symbols that have one."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.code, self.length = shannon_codes(np.bincount(symbols, minlength=size))
        self.bits, self.zeros = [], []
        order = symbols.astype(np.int64)
        for level in range(int(self.length.max(initial=0))):
            order = order[self.length[order] > level]
            bit = self.code[order] >> (self.length[order] - 1 - level) & 1
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            order = np.concatenate([order[bit == 0], order[bit == 1]])
        #: Where each symbol's stretch starts in the last level of its code.
        self.start = self._descend(np.arange(size), np.zeros(size, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, who = at.astype(np.int64), np.arange(len(symbol))
        length, code = self.length[symbol], self.code[symbol]
        for level, bits in enumerate(self.bits):
            who = who[length[who] > level]
            place = out[who]
            ones = bits.ones(place)
            out[who] = np.where(code[who] >> (length[who] - 1 - level) & 1, self.zeros[level] + ones, place - ones)
        return out

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._descend(symbol, at) - self.start[symbol]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffixes in order; every 0 is a separator, unlike any other and less than all symbols. Prefix doubling."""
    n, ends = len(symbols), symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols + int(ends.sum()))
    step = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key)
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.r_[0, np.diff(key[order]) != 0])
        if new[order[-1]] == n - 1 or 2 * step >= n:
            return order
        rank, step = new, 2 * step


class FmIndex:
    """Sequences of symbols (from 1 on) and their weights: one of 2 or more counts as two occurrences of all it holds."""

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray):
        lengths = np.array([len(s) + 1 for s in sequences])
        text = np.concatenate([x for s in sequences for x in (s, [0])]).astype(np.int64)
        size = int(text.max()) + 1
        order = suffix_order(text)
        self.less = np.cumsum(np.r_[0, np.bincount(text, minlength=size)])  # suffixes that start with a lesser symbol
        self.bwt = WaveletMatrix(text[order - 1], size)
        self.weight = Bits(np.r_[np.repeat(weights > 1, lengths)[order], False])  # rows that count twice

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the rows of symbol followed by what the rows low to high start with."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.less[symbol] + both[: len(symbol)], self.less[symbol] + both[len(symbol) :]

    def count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        high = np.maximum(high, low)
        return high - low + self.weight.ones(high) - self.weight.ones(low)

    def repeated(self, patterns: list[np.ndarray], least: int) -> list[list[tuple[int, int]]]:
        """Of each pattern the intervals (start, end) of at least so many symbols that occur twice or more, by weight.

        Matching statistics from the right: the match that ends at a place is extended while it occurs twice. A long enough
        one is reported, and covers every shorter one inside it; the next place is then the last one it does not settle."""
        found: list[list[tuple[int, int]]] = [[] for _ in patterns]
        length = np.array([len(p) for p in patterns])
        first = np.cumsum(length) - length
        flat = np.concatenate(patterns) if patterns else np.zeros(0, dtype=np.int64)
        who = np.flatnonzero(length >= least)
        end = length[who] - 1
        at = end.copy()  # the match is at .. end
        low, high = (self.less[flat[first[who] + end] + i] for i in (0, 1))
        live = self.count(low, high) >= 2  # an empty match where not
        at[~live] += 1
        while len(who):
            can = (at > 0) & (at <= end)
            symbol = flat[first[who] + np.maximum(at - 1, 0)]
            low2, high2 = low.copy(), high.copy()
            if can.any():
                low2[can], high2[can] = self.extend(symbol[can], low[can], high[can])
            grown = can & (self.count(low2, high2) >= 2)
            low, high = np.where(grown, low2, low), np.where(grown, high2, high)
            at = at - grown
            stop = ~grown
            if stop.any():
                s = np.flatnonzero(stop)
                long = end[s] - at[s] + 1 >= least
                for i in s[long]:
                    found[who[i]].append((int(at[i]), int(end[i]) + 1))
                end[s] = np.where(long, at[s] + least - 2, end[s] - 1)
                at[s] = end[s]
                c = flat[first[who[s]] + np.maximum(end[s], 0)]
                low[s], high[s] = self.less[c], self.less[c + 1]
                at[s] += self.count(low[s], high[s]) < 2
                keep = end >= least - 1
                who, end, at, low, high = who[keep], end[keep], at[keep], low[keep], high[keep]
        return found
