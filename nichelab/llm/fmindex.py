"""A compressed index of a shard of word sequences: BWT in a wavelet matrix, searched backwards for many patterns at once.

Suffixes are sorted by their first ``depth`` words only, which is all that backward
search needs for patterns of up to ``depth`` words: before a pattern's interval stand
exactly the suffixes whose first words are smaller.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with a count per 64-bit word; ``rank`` counts the ones before each position."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        for level in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            bits = ((symbols >> level) & 1).astype(bool)
            ones = BitVector(bits)
            self.levels.append((level, ones, len(symbols) - int(bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        every = np.arange(n_symbols)
        self.origin = self._walk(every, np.zeros(n_symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ones, zeros in self.levels:
            r = ones.rank(at).astype(np.int64)
            at = np.where((symbol >> level) & 1, zeros + r, at - r)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``at``."""
        return self._walk(symbol, at) - self.origin[symbol]


def prefix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Dense rank of the ``depth`` symbols from each position on, by doubling (zeros follow the end)."""

    def pair(left: np.ndarray, shift: int) -> np.ndarray:
        right = np.zeros_like(left)
        right[: len(left) - shift] = left[shift:] + 1
        return np.unique(left * (left.max() + 2) + right, return_inverse=True)[1].astype(np.int64)

    rank, have = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while have < depth:
        step = min(have, depth - have)
        rank = pair(rank, step)
        have += step
    return rank


class ShardIndex:
    """Index over ``text`` (symbols from 1 up, 0 between sequences) with a value per position, of which searches return the least.

    Kept are the wavelet bits, a bit per suffix that marks where the next
    ``depth``-word prefix begins, and one least value for each such prefix.
    """

    def __init__(self, text: np.ndarray, n_symbols: int, values: np.ndarray, depth: int):
        rank = prefix_ranks(text, depth)
        order = np.argsort(rank, kind="stable")
        self.wavelet = WaveletMatrix(text[order - 1], n_symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))[:-1]])
        self.n = len(text)
        ranked = rank[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        self.starts = BitVector(new)
        self.least = np.minimum.reduceat(values[order], np.flatnonzero(new))

    def nbytes(self) -> int:
        """Size of what a search reads."""
        bits = [self.starts, *(ones for _, ones, _ in self.wavelet.levels)]
        return sum(b.words.nbytes + b.before.nbytes for b in bits) + self.least.nbytes + self.smaller.nbytes + self.wavelet.origin.nbytes

    def search(self, text: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics capped at ``depth`` of the patterns that begin at ``at``, and the least value where all of it matches.

        The statistic counts the pattern's words from its end that occur in a
        row in the index; the value is the largest integer where fewer than
        ``depth`` do.
        """
        n = len(at)
        low, high = np.zeros(n, np.int64), np.full(n, self.n, np.int64)
        matched, live = np.zeros(n, np.int64), np.arange(n)
        for j in reversed(range(depth)):
            symbol = text[at[live] + j]
            both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            first = self.smaller[symbol]
            low[live], high[live] = first + both[: len(live)], first + both[len(live) :]
            live = live[low[live] < high[live]]
            matched[live] += 1
        value = np.full(n, np.iinfo(np.int64).max)
        value[live] = self.least[self.starts.rank(low[live] + 1) - 1]
        return matched, value
