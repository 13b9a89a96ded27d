"""String similarity for name search: Jaro, Jaro-Winkler, token containment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX_SCALE, LONGEST_PREFIX = 0.1, 4


def jaro(a: str, b: str) -> float:
    """Share of characters that match within half the longer length, less half the transpositions."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


_jaro = jaro


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised by the common prefix at every score."""
    j = jaro(a, b)
    return j + _common_prefix(a, b) * PREFIX_SCALE * (1 - j)


#: Longest names that one machine word holds a bit for each letter of, and pairs that are worked on at once.
WORD_BITS, PAIRS = 64, 2048
#: Names that are scored to learn what the best must reach, for each place.
TRIES = 16


def _letters(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of names, one row each and padded with 0, and their lengths."""
    length = np.array([len(x) for x in names])
    flat = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(names), max(1, int(length.max(initial=0)))), np.uint32)
    out[np.arange(out.shape[1]) < length[:, None]] = flat
    return out, length


def _in_order(letters: np.ndarray, taken: np.ndarray, width: int) -> np.ndarray:
    """The taken letters of each row, moved to its beginning."""
    out = np.zeros((len(letters), width), np.uint32)
    row, column = np.nonzero(taken)
    out[row, (np.cumsum(taken, 1) - 1)[row, column]] = letters[row, column]
    return out


def jaro_batch(a: list[str], b: list[str]) -> np.ndarray:
    """:func:`jaro` of many pairs at once: the letters of b that are equal to one of a are the bits of a word, and the lowest free one
    within reach is taken."""
    if any(len(x) > WORD_BITS for x in b):
        return np.array([jaro(x, y) for x, y in zip(a, b, strict=True)])
    (x, n), (y, m) = _letters(a), _letters(b)
    bits = np.uint64(1) << np.arange(y.shape[1], dtype=np.uint64)
    real = np.where(np.arange(y.shape[1]) < m[:, None], bits, np.uint64(0))
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    every, one = ~np.uint64(0), np.uint64(1)
    upto = lambda k: np.where(k >= WORD_BITS, every, (one << np.clip(k, 0, WORD_BITS - 1).astype(np.uint64)) - one)  # the k lowest bits
    taken, left = np.zeros(len(a), np.uint64), np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        same = ((y == x[:, i : i + 1]) * real).sum(1, dtype=np.uint64)
        free = same & ~taken & upto(i + reach + 1) & ~upto(i - reach) & np.where(i < n, every, np.uint64(0))
        low = free & (~free + one)
        taken |= low
        left[:, i] = low > 0
    count = left.sum(1)
    right = (taken[:, None] & bits) > 0
    width = max(1, int(count.max(initial=0)))
    moved = (_in_order(x, left, width) != _in_order(y, right, width)).sum(1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(count > 0, (count / n + count / m + (count - moved) / count) / 3, 0.0)
    return np.where([p == q for p, q in zip(a, b, strict=True)], 1.0, out)


class NameBlock:
    """Names that many queries are compared with: where each letter stands in each name, as the bits of a word."""

    def __init__(self, names: list[str]):
        self.names, self.number = np.array(names, object), len(names)
        short = np.array([len(x) <= WORD_BITS for x in names], bool)
        self.long = np.flatnonzero(~short)
        y, self.length = _letters([x if s else "" for x, s in zip(names, short, strict=True)])
        self.letters, self.inverse = y, 1 / np.maximum(self.length, 1)
        bits = np.uint64(1) << np.arange(y.shape[1], dtype=np.uint64)
        self.bits = {c: ((y == c) * bits).sum(1, dtype=np.uint64) for c in np.unique(y) if c}
        self.head = np.zeros((LONGEST_PREFIX, len(names)), np.uint32)
        for i, x in enumerate(names):
            self.head[: len(x), i] = [ord(c) for c in x[:LONGEST_PREFIX]]
        self.size, self.within = -1, []
        self.holders: dict[str, list[int]] = {}
        for i, x in enumerate(names):
            for word in set(x.split(" ")):
                self.holders.setdefault(word, []).append(i)

    def _within(self, n: int) -> list[np.ndarray]:
        """For each letter of a query of n letters, the places of each name that are within reach."""
        if n != self.size:
            reach = np.maximum(0, np.maximum(n, self.length) // 2 - 1)
            one = np.uint64(1)
            upto = lambda k: np.where(k >= WORD_BITS, ~np.uint64(0), (one << np.clip(k, 0, WORD_BITS - 1).astype(np.uint64)) - one)
            self.size, self.within = n, [upto(i + reach + 1) & ~upto(i - reach) for i in range(n)]
        return self.within

    def _matched(self, query: str, at=slice(None), marks: np.ndarray | None = None) -> np.ndarray:
        """The letters of each name at some places that those of the query take one by one, as :func:`jaro` does; marks gets the letters
        of the query that take one."""
        within = self._within(len(query))
        free = np.full(len(self.length[at]), ~np.uint64(0))
        low, negative = np.empty_like(free), np.empty_like(free)
        for i, c in enumerate(map(ord, query)):
            if c in self.bits:
                np.bitwise_and(self.bits[c][at], within[i][at], out=low)
                low &= free
                np.negative(low, out=negative)
                low &= negative
                free ^= low
                if marks is not None:
                    marks[i] = low
        return ~free

    def _raised(self, query: str, jaro: np.ndarray, at=slice(None)) -> np.ndarray:
        """Jaro, raised by the common prefix and by the share of the query's words that a name holds."""
        alike, prefix = np.ones(len(jaro), bool), np.zeros(len(jaro))
        for i, c in enumerate(map(ord, query[:LONGEST_PREFIX])):
            alike &= self.head[i][at] == c
            prefix += alike
        out = jaro + prefix * PREFIX_SCALE * (1 - jaro)
        words = query.split(" ")
        if any(w in self.holders for w in words):
            held = np.zeros(self.number)
            for word in words:
                held[self.holders.get(word, [])] += 1
            out = np.maximum(out, 0.3 * out + 0.7 * (held[at] / len(words)))
        return out

    def bounds(self, query: str) -> np.ndarray:
        """The most that the blended score of each name can be: the letters that match are known, and none is transposed."""
        m = np.bitwise_count(self._matched(query)).astype(np.float64)
        out = self._raised(query, (m / len(query) + m * self.inverse + 1) / 3) + 1e-9
        out[self.long] = np.inf
        return out

    def scores(self, query: str, at: np.ndarray) -> np.ndarray:
        """The blended scores of the names at some places."""
        n, marks = len(query), np.zeros((len(query), len(at)), np.uint64)
        taken = self._matched(query, at, marks)
        m = np.bitwise_count(taken).astype(np.int64)
        width = max(1, int(m.max(initial=0)))
        letters = np.broadcast_to(np.frombuffer(query.encode("utf-32-le"), np.uint32), (len(at), n))
        places = (taken[:, None] >> np.arange(self.letters.shape[1], dtype=np.uint64)) & np.uint64(1)
        moved = (_in_order(letters, marks.T > 0, width) != _in_order(self.letters[at], places, width)).sum(1) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(m > 0, (m / n + m / self.length[at] + (m - moved) / m) / 3, 0.0)
        for i in np.flatnonzero(np.isin(at, self.long)) if len(self.long) else ():
            jaro[i] = _jaro(query, self.names[at[i]])
        return self._raised(query, jaro, at)

    def best(self, query: str, least: float, most: int) -> np.ndarray:
        """Places of the names that score at least ``least`` and are among the best ``most``, or as good as the last of them. Those of the
        highest bounds are scored first, which tells what the others must reach."""
        bound = self.bounds(query)
        if self.number > TRIES * most:
            first = np.argpartition(-bound, TRIES * most - 1)[: TRIES * most]
            least = max(least, float(-np.partition(-self.scores(query, first), most - 1)[most - 1]) - 1e-9)
        at = np.flatnonzero(bound >= least)
        score = self.scores(query, at)
        if len(at) > most:
            least = max(least, float(-np.partition(-score, most - 1)[most - 1]) - 1e-9)
        return at[score >= least - 1e-9]


def _common_prefix(a: str, b: str) -> int:
    p = 0
    while p < min(LONGEST_PREFIX, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return p


def _jaro_of(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Jaro of a batch of pairs, and which of them are known."""
    known = (a.notna() & b.notna()).to_numpy()
    x, y = a[known].tolist(), b[known].tolist()
    out = np.full(len(a), np.nan)
    parts = [jaro_batch(x[i : i + PAIRS], y[i : i + PAIRS]) for i in range(0, len(x), PAIRS)]
    out[known] = np.concatenate(parts) if parts else []
    return out, known


@F.pandas_udf(T.DoubleType())
def jaro_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    out, known = _jaro_of(a, b)
    return pd.Series(out).astype("Float64").where(known)


def common_prefix(a: Column, b: Column) -> Column:
    """Letters that two names begin with alike, LONGEST_PREFIX at most."""
    out = F.lit(0)
    for n in range(1, LONGEST_PREFIX + 1):
        out = F.when((F.length(a) >= n) & (F.length(b) >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n)), n).otherwise(out)
    return out


def raised(score: Column, a: Column, b: Column) -> Column:
    """Jaro-Winkler of a Jaro score: raised by the common prefix."""
    return score + common_prefix(a, b) * PREFIX_SCALE * (1 - score)


def jaro_winkler_column(a: Column, b: Column) -> Column:
    return raised(jaro_udf(a, b), a, b)


def numbered_letters(name: Column) -> Column:
    """The letters of a name, the k-th of each kind as its own element: what two names have in common of these, each letter of one can
    be matched with at most."""
    letters = F.filter(F.split(name, ""), lambda c: c != "")
    return F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda d: d == c)).cast("string")))


def jaro_bound(common: Column, a: Column, b: Column) -> Column:
    """The most that Jaro can be for lengths a and b with so many letters in common: all of them match, none is transposed."""
    m = F.least(common, a, b)
    return F.when(m > 0, (m / a + m / b + 1) / 3).otherwise(0.0)


def token_containment(query: Column, name: Column) -> Column:
    """Share of the query's words that the name's words hold."""
    q, n = F.split(query, " "), F.split(name, " ")
    return F.size(F.filter(q, lambda w: F.array_contains(n, w))) / F.size(q)


def blended(winkler: Column, containment: Column) -> Column:
    return F.greatest(winkler, 0.3 * winkler + 0.7 * containment)
