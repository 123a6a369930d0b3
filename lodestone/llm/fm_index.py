"""A compressed full-text index over word codes: BWT in a wavelet matrix, searched backward.

Suffixes are sorted by their first ``depth`` symbols, which is enough for exact intervals of
patterns up to that length. Each wavelet level is a bit vector with one popcount per 64 bits. Of
the suffix order itself only the rank of each suffix's place is kept, in 32 bits.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.zeros = n - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((_ONE << bit) - _ONE))


class FMIndex:
    def __init__(self, text: np.ndarray, depth: int, place: np.ndarray | None = None):
        """text: codes from 0; 0 parts the segments and is searched for by no pattern.

        place: rank of each position's place, for matching statistics against earlier places.
        """
        self.n = n = len(text)
        rank = text.astype(np.int64)
        step = 1
        while step < depth and n:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            _, rank = np.unique(rank * (n + int(rank.max()) + 2) + after, return_inverse=True)
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.place = None if place is None else place[order].astype(np.int32)
        bwt = text[order - 1].astype(np.int64)
        size = int(text.max()) + 1 if n else 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.levels = []
        for b in range(max(1, (size - 1).bit_length()) - 1, -1, -1):
            bit = (bwt >> b & 1).astype(np.uint8)
            self.levels.append((b, Bits(bit)))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.base = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, bits in self.levels:
            one = bits.ones(i)
            i = np.where(c >> b & 1, bits.zeros + one, i - one)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with c put in front."""
        k = len(c)
        at = self._down(np.concatenate([c, c]), np.concatenate([lo, hi])) - np.concatenate([self.base[c]] * 2) + np.concatenate([self.first[c]] * 2)
        return at[:k], at[k:]

    def search(self, patterns: np.ndarray, alone: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the rows of a pattern matrix; a search stops once at most ``alone`` places are left."""
        n, m = patterns.shape
        lo, hi = np.zeros(n, np.int64), np.full(n, self.n, np.int64)
        live = np.arange(n)
        for j in range(m - 1, -1, -1):
            if not len(live):
                break
            lo[live], hi[live] = self.extend(patterns[live, j], lo[live], hi[live])
            live = live[hi[live] - lo[live] > alone]
        return lo, hi

    def matching(self, text: np.ndarray, ends: np.ndarray, room: np.ndarray, own: np.ndarray, least: int) -> np.ndarray:
        """Matching statistics: length of the longest match that ends at each place of ends.

        A match is a run of words that the index holds at an earlier place too. text[e - l + 1] for
        l up to room are the words before an end e, own the rank of each position's place; lengths
        below ``least`` are given as 0. All ends are extended to the left together, a word a step.
        """
        n = len(ends)
        lo, hi, length = np.zeros(n, np.int64), np.full(n, self.n, np.int64), np.zeros(n, np.int64)
        live, l = np.flatnonzero(room >= least), 0
        while len(live):
            l += 1
            lo[live], hi[live] = self.extend(text[ends[live] - l + 1], lo[live], hi[live])
            live = live[hi[live] - lo[live] > 1]
            if l >= least and len(live):
                live = live[least_in(self.place, lo[live], hi[live]) < own[ends[live] - l + 1]]
                length[live] = l
                live = live[room[live] > l]
        return length


def least_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least value in each non-empty interval; intervals are equal or apart."""
    start, back = np.unique(lo, return_inverse=True)
    end = np.zeros(len(start), np.int64)
    end[back] = hi
    padded = np.concatenate([values, [np.iinfo(np.int64).max]])
    cuts = np.stack([start, end], 1).ravel()
    return np.minimum.reduceat(padded, cuts)[::2][back] if len(start) else np.zeros(0, np.int64)
