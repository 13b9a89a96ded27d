"""Suffix order, common prefixes and maximal runs of many word sequences at once, in array operations.

Sequences are laid one after the other, each followed by one end mark that is less than all of its words. Suffixes are
ranked by prefix doubling, in which only suffixes that still share their rank are sorted again; ranks are ordered by
sequence first, so copies of one another cost nothing. Memory is a few numbers per word and doubling step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rounds of pointer jumping before the positions that are left are searched in a table of minima.
JUMPS = 32


def ragged(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of so many members: the group and the number within it of each member."""
    group = np.repeat(np.arange(len(count)), count)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)


def minima(x: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level k holds the least of every 2 ** k consecutive values."""
    levels, width = [x], 1
    while len(x) > width:
        x = np.minimum(x[:-width], x[width:])
        levels.append(x)
        width *= 2
    return levels


def least_between(levels: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value at low..high (both included, low <= high), two lookups each."""
    k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), levels[0].dtype)
    for level in np.unique(k):
        at = np.flatnonzero(k == level)
        out[at] = np.minimum(levels[level][low[at]], levels[level][high[at] - (1 << int(level)) + 1])
    return out


def next_smaller(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each position of ``at`` the next one with a smaller value, which must exist; elsewhere the next position.

    A position whose neighbour is larger jumps over all that the neighbour has passed; what is left after some rounds (a
    long descent of larger values) is found in a table of minima."""
    to = np.arange(1, len(v) + 1)
    for _ in range(JUMPS):
        at = at[v[to[at]] > v[at]]
        if not len(at):
            return to
        to[at] = to[to[at]]
    levels = minima(v)
    pos = to[at]
    for k in range(len(levels) - 1, -1, -1):
        fits = pos + (1 << k) <= len(v)
        over = fits & (levels[k][np.where(fits, pos, 0)] > v[at])
        pos = np.where(over, pos + (1 << k), pos)
    to[at] = pos
    return to


@dataclass
class Suffixes:
    """The suffixes of some sequences. ``levels[k]``: ranks by the first 2 ** k words; the last level tells all apart."""

    levels: list[np.ndarray]
    lcp: np.ndarray  # of the suffix in each place of the order with the one before it

    @property
    def rank(self) -> np.ndarray:
        return self.levels[-1]

    def common(self, a: np.ndarray, b: np.ndarray, table: list[np.ndarray]) -> np.ndarray:
        """Words that the suffixes at a and b share; table: minima(lcp)."""
        x, y = self.rank[a], self.rank[b]
        return least_between(table, np.minimum(x, y) + 1, np.maximum(x, y))


def _shared(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common words of suffixes that differ within 2 ** len(levels), from the ranks of each doubling step."""
    n = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        n += np.where(levels[k][a + n] == levels[k][b + n], 1 << k, 0)
    return n


def suffixes(letters: np.ndarray, sequence: np.ndarray) -> Suffixes:
    """letters: small integers, 0 only at the end mark of each sequence; sequence: the number of the sequence, ascending."""
    m = len(letters)
    key = sequence * (int(letters.max(initial=0)) + 1) + letters
    place = np.argsort(key)  # of suffixes, in their order
    new = np.ones(m, bool)
    new[1:] = np.diff(key[place]) != 0
    slot = np.flatnonzero(new)
    rank = np.empty(m, np.int64)
    rank[place] = np.repeat(slot, np.diff(np.append(slot, m)))
    levels, lcp, width = [rank.astype(np.int32)], np.zeros(m, np.int32), 1
    alone = new & np.append(new[1:], True)
    left = place[~alone]  # suffixes that share their rank
    while len(left):
        # those of one rank share `width` words, none of them an end mark, so the places after these words exist
        key = rank[left] * m + rank[left + width]
        order = np.argsort(key)
        left, key = left[order], key[order]
        group = rank[left]
        first = np.ones(len(left), bool)
        first[1:] = np.diff(group) != 0
        new = first.copy()
        new[1:] |= np.diff(key) != 0
        begin = np.flatnonzero(first)
        slot = group + np.arange(len(left)) - np.repeat(begin, np.diff(np.append(begin, len(left))))
        parted = np.flatnonzero(new & ~first)
        lcp[slot[parted]] = width + _shared(levels, left[parted - 1] + width, left[parted] + width)
        heads = np.flatnonzero(new)
        rank[left] = np.repeat(slot[heads], np.diff(np.append(heads, len(left))))
        levels.append(rank.astype(np.int32))
        left = left[~(new & np.append(new[1:], True))]
        width *= 2
    return Suffixes(levels, lcp)


def runs(words: np.ndarray, first: np.ndarray, least_exponent: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, start, length, period) of all maximal runs with a length of at least ``least_exponent`` (2 or more) periods.

    words: one value for each word of all sequences; first: the first word of each sequence, and one more at the end.
    The longest Lyndon word at each place ends before the next place whose suffix is smaller; in the reversed order of
    words, before the next whose suffix is larger. By the runs theorem one of them, somewhere in its first period, is the
    Lyndon root of every run; the root is extended to the right by what the suffixes there share, and to the left, by less
    than a period, word by word."""
    count = np.diff(first)
    n, docs = int(first[-1]), len(count)
    empty = np.zeros(0, np.int64)
    if not n:
        return empty, empty, empty, empty
    letters = np.zeros(n + docs, np.int64)
    sequence = np.repeat(np.arange(docs), count + 1)
    at = np.arange(n) + np.repeat(np.arange(docs), count)  # places of words
    letters[at] = np.unique(words, return_inverse=True)[1] + 1
    known = suffixes(letters, sequence)
    rank = known.rank.astype(np.int64)
    ends = first[1:] + np.arange(docs)
    flipped = -rank
    flipped[ends] = -len(rank)
    found_at, found_period = [], []
    for order in (rank, flipped):
        period = next_smaller(order, at)[at] - at
        # the leftmost root of a run starts in its first period, so the run goes on for (least_exponent - 2) periods and a word at least
        level = np.frexp(((least_exponent - 2) * period + 1).astype(np.float64))[1] - 1
        for k in np.unique(level[level < len(known.levels)]):
            of = np.flatnonzero((level == k) & (letters[np.minimum(at + period, len(letters) - 1)] > 0))
            i, j = at[of], at[of] + period[of]
            same = known.levels[k][i] == known.levels[k][j]
            found_at.append(i[same])
            found_period.append(period[of][same])
    i, p = np.concatenate([empty, *found_at]), np.concatenate([empty, *found_period])
    if not len(i):
        return empty, empty, empty, empty
    end = i + p + known.common(i, i + p, minima(known.lcp))
    order = np.lexsort((i, p, end))
    i, p, end = i[order], p[order], end[order]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(p) != 0) | (np.diff(end) != 0)  # a run has one end and one period
    i, p, end = i[new], p[new], end[new]
    begin = first[:-1] + np.arange(docs)
    room = np.minimum(p - 1, i - begin[sequence[i]])
    root, back = ragged(room)
    differs = letters[i[root] - 1 - back] != letters[i[root] - 1 - back + p[root]]
    left = room.copy()
    np.minimum.at(left, root[differs], back[differs])
    start = i - left
    good = end - start >= least_exponent * p
    start, end, p = start[good], end[good], p[good]
    order = np.lexsort((p, start))
    start, end, p = start[order], end[order], p[order]
    of = sequence[start]
    return of, start - begin[of], end - start, p
