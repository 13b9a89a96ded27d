"""Posting lists in blocks of varying length, and an exact top-k search that skips blocks by their bounds.

A shard is a run of documents. Each term's postings are cut into blocks at the boundaries that a dynamic programme
chooses: a block costs its length times its greatest score, which is what it promises, and a constant for being a block;
the least sum is the least error of the bounds for its number of blocks. A search adds up the block maxima of its
lists between any two boundaries, and scores only stretches whose sum can still reach the k-th best score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from rostrum.llm.suffixes import ragged

#: Lists are cut into pieces of so many postings before the dynamic programme, and no block is longer than LONGEST.
PIECE, LONGEST = 1024, 64
#: What a block costs, in mean errors of one posting in a block of its whole list.
BLOCK_COST = 8
#: Pieces that are cut side by side; bounds the memory of the programme's tables.
SIDE_BY_SIDE = 2048


def _cut(scores: np.ndarray, first: np.ndarray, length: np.ndarray, cost: np.ndarray, longest: int) -> list[np.ndarray]:
    """Begins of blocks of pieces (first, length), by a dynamic programme over all pieces at once; descending lengths."""
    pieces, n = len(first), int(length[0])
    best = np.zeros((pieces, n + 1))
    choice = np.zeros((pieces, n + 1), np.int16)
    top = np.full((pieces, longest), -np.inf)  # the greatest score of the last l + 1 postings
    size = np.arange(1, longest + 1, dtype=np.float64)
    for i in range(1, n + 1):
        live = int(np.searchsorted(-length, -i, "right"))
        x = scores[first[:live] + i - 1].astype(np.float64)[:, None]
        t = top[:live]
        t[:, 1:] = np.maximum(t[:, :-1], x)
        t[:, :1] = x
        m = min(i, longest)
        total = best[:live, i - m : i][:, ::-1] + t[:, :m] * size[:m]
        pick = total.argmin(1)
        best[:live, i] = total[np.arange(live), pick] + cost[:live]
        choice[:live, i] = pick + 1
    begins, at, of = [], length.copy(), np.arange(pieces)
    while len(of):
        at = at - choice[of, at]
        begins.append(first[of] + at)
        of, at = of[at > 0], at[at > 0]
    return begins


def cut_blocks(scores: np.ndarray, begin: np.ndarray, longest: int = LONGEST, piece: int = PIECE) -> np.ndarray:
    """Where blocks begin. scores: of all lists' postings, list after list; begin: of each list, and one more at the end."""
    count = np.diff(begin)
    of, k = ragged(-(-count // piece))
    if not len(of):
        return np.zeros(0, np.int64)
    first = begin[:-1][of] + k * piece
    length = np.minimum(piece, begin[1:][of] - first)
    filled = np.flatnonzero(count)
    cost = np.zeros(len(count))
    cost[filled] = BLOCK_COST * (np.maximum.reduceat(scores, begin[:-1][filled]) - np.add.reduceat(scores.astype(np.float64), begin[:-1][filled]) / count[filled])
    order = np.argsort(-length, kind="stable")
    found = []
    for s in range(0, len(order), SIDE_BY_SIDE):
        part = order[s : s + SIDE_BY_SIDE]
        found += _cut(scores, first[part], length[part], np.maximum(cost[of[part]], 1), longest)
    return np.sort(np.concatenate(found))


@dataclass
class Shard:
    """Postings of a run of documents: documents (ascending) and scores of each list, and its blocks."""

    begin: np.ndarray  # of each list, and one more
    doc: np.ndarray
    score: np.ndarray
    block: np.ndarray  # begin of each block, and one more
    block_list: np.ndarray  # first block of each list, and one more
    block_max: np.ndarray
    list_max: np.ndarray

    @classmethod
    def of(cls, term: np.ndarray, doc: np.ndarray, score: np.ndarray, terms: int) -> Shard:
        """term, doc, score: of all postings, in any order; terms: how many lists there are."""
        order = np.lexsort((doc, term))
        order = order[score[order] > 0]  # what adds nothing needs no posting
        term, doc, score = term[order], doc[order], score[order]
        begin = np.searchsorted(term, np.arange(terms + 1))
        block = cut_blocks(score, begin)
        most = np.maximum.reduceat(score, block) if len(block) else score[:0]
        of_list = np.searchsorted(block, begin)
        list_max = np.zeros(terms, np.int64)
        filled = np.flatnonzero(np.diff(of_list))
        if len(filled):
            list_max[filled] = np.maximum.reduceat(most, of_list[filled])
        return cls(begin, doc, score, np.append(block, len(doc)), of_list, most, list_max)

    def bounds(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, bound): stretches of documents between the boundaries of the lists' blocks, and the sum of the block maxima there."""
        spans = []
        for t in lists:
            b = np.arange(self.block_list[t], self.block_list[t + 1])
            spans.append((self.doc[self.block[b]], self.doc[self.block[b + 1] - 1] + 1, self.block_max[b]))
        edges = np.unique(np.concatenate([x for low, high, _ in spans for x in (low, high)]))
        rise = np.zeros(len(edges), np.int64)
        for low, high, most in spans:  # blocks of one list do not overlap
            rise[np.searchsorted(edges, low)] += most
            rise[np.searchsorted(edges, high)] -= most
        return edges[:-1], edges[1:], np.cumsum(rise)[:-1]

    def assured(self, k: int) -> np.ndarray:
        """The k-th best score within each list, 0 for shorter ones: k documents have it, whatever else they get."""
        out = np.zeros(len(self.begin) - 1, np.int64)
        for t in np.flatnonzero(np.diff(self.begin) >= k):
            own = self.score[self.begin[t] : self.begin[t + 1]]
            out[t] = np.partition(own, len(own) - k)[len(own) - k]
        return out

    def pivots(self, driving: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The documents of the driving lists in the stretches low..high - 1, which do not overlap."""
        docs = []
        for t in driving:
            doc = self.doc[self.begin[t] : self.begin[t + 1]]
            start = np.searchsorted(doc, low)
            of, k = ragged(np.searchsorted(doc, high) - start)
            docs.append(doc[start[of] + k])
        return np.unique(np.concatenate(docs))

    def exact(self, lists: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The scores of some documents over all of the lists."""
        total = np.zeros(len(docs), np.int64)
        for t in lists:
            a, b = self.begin[t], self.begin[t + 1]
            at = np.searchsorted(self.doc[a:b], docs)
            there = at < b - a
            there[there] = self.doc[a + at[there]] == docs[there]
            total[there] += self.score[a + at[there]]
        return total

    def search(self, lists: np.ndarray, k: int, key: np.ndarray, assured: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best (document, score) above 0, equal scores by key, and how many documents were scored. assured: assured(k).

        Lists in ascending order of their maxima are without effect while the sum of these stays below the k-th score: the
        documents of the other lists are the pivots. Only stretches whose block maxima reach that score are looked at, the
        most promising first, a few at a time, and then more."""
        lists = lists[self.list_max[lists] > 0]
        best, scored = (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0
        if not len(lists):
            return *best, scored
        lists = lists[np.argsort(self.list_max[lists], kind="stable")]
        low, high, bound = self.bounds(lists)
        reach = np.cumsum(self.list_max[lists])
        order = np.argsort(-bound, kind="stable")
        done, step, floor = 0, 4, max(1, int(assured[lists].max()))
        while done < len(order):
            least = max(floor, int(best[1][-1])) if len(best[1]) == k else floor
            part = np.sort(order[done : done + step])
            part = part[bound[part] >= least]
            if not len(part):
                break
            done, step = done + step, 2 * step
            found = self.pivots(lists[np.searchsorted(reach, least) :], low[part], high[part])
            if not len(found):
                continue
            docs, total = np.append(best[0], found), np.append(best[1], self.exact(lists, found))
            scored += len(found)
            top = np.lexsort((key[docs], -total))[:k]
            best = docs[top], total[top]
        return *best, scored
