"""Posting blocks, bounds and ranked search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from rostrum.llm import posting_blocks, ranked_search
from rostrum.llm.lookup import HashIndex
from rostrum.llm.posting_blocks import Shard, cut_blocks


def test_hash_index():
    r = np.random.default_rng(0)
    known = np.unique(r.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2))
    known = known[r.permutation(len(known))]
    index = HashIndex(known)
    assert index.find(known).tolist() == list(range(len(known))) and (index.find(known + np.uint64(1)) == -1).all()
    crowded = np.arange(40, dtype=np.uint64)
    assert HashIndex(crowded).find(np.arange(60, dtype=np.uint64)).tolist() == [*range(40), *[-1] * 20]
    assert HashIndex(known[:0]).find(known).tolist() == [-1] * len(known)


def test_blocks_have_the_least_error_of_their_bounds():
    r = np.random.default_rng(1)
    for _ in range(150):
        lists = [r.integers(1, 50, r.integers(0, 14)) for _ in range(r.integers(1, 5))]
        begin, s = np.cumsum([0] + [len(x) for x in lists]), np.concatenate(lists)
        longest, piece = int(r.integers(1, 5)), int(r.integers(3, 9))
        got = cut_blocks(s, begin, longest, piece)
        for t, x in enumerate(lists):
            cost = max(1, posting_blocks.BLOCK_COST * (x.max() - x.mean())) if len(x) else 0
            ends = [*(got[(got >= begin[t]) & (got < begin[t + 1])] - begin[t]), len(x)]
            found = sum(cost + (b - a) * x[a:b].max() for a, b in zip(ends, ends[1:]))
            least = 0
            for p in range(0, len(x), piece):
                y, best = x[p : p + piece], [0]
                for i in range(1, len(y) + 1):
                    best.append(min(best[i - n] + cost + n * y[i - n : i].max() for n in range(1, min(i, longest) + 1)))
                least += best[-1]
            assert found == pytest.approx(least)


def test_search_finds_the_best_and_skips_the_rest():
    r = np.random.default_rng(2)
    for _ in range(150):
        docs, terms = int(r.integers(1, 60)), int(r.integers(1, 12))
        score = np.where(r.random((terms, docs)) < r.random((terms, 1)), r.integers(0, r.choice([3, 1000]), (terms, docs)), 0)
        t, d = np.nonzero(np.ones_like(score))
        p = r.permutation(len(t))
        shard, key = Shard.of(t[p], d[p], score[t, d][p], terms), r.permutation(docs)
        for _ in range(4):
            q, k = r.permutation(terms)[: r.integers(1, terms + 1)], int(r.integers(1, 6))
            found, total, _ = shard.search(q, k, key, shard.assured(k))
            full = score[q].sum(0)
            want = [x for x in sorted(range(docs), key=lambda x: (-full[x], key[x])) if full[x] > 0][:k]
            assert found.tolist() == want and total.tolist() == full[want].tolist()
    n, rare = 20_000, np.arange(100, 20_000, 1000)  # one rare and heavy list among frequent and light ones
    term = np.concatenate([np.repeat(np.arange(5), n), np.full(len(rare), 5)])
    doc = np.concatenate([np.tile(np.arange(n), 5), rare])
    shard = Shard.of(term, doc, np.where(term == 5, 50_000, r.integers(1, 500, len(term))), 6)
    assert shard.search(np.arange(6), 10, np.arange(n), shard.assured(10))[2] <= len(rare)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def slow(docs, items, k=10):
    docs = [(i, Counter(x.translate(FOLD) for x in TERM.findall(t or ""))) for i, t in docs]
    docs = [(i, c, c.total()) for i, c in docs if c]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(x.translate(FOLD) for x in TERM.findall(t or ""))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c, length in docs:
            m = 10 + 90 * length * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            scored += [(-s, i is None, i or 0, i)] * (s > 0)
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_ranked_matches_brute_force(spark, monkeypatch):
    r = np.random.default_rng(3)
    text = lambda n: " ".join(f"{r.choice(['Wort', 'ÉTÉ', 'x_', 'q'])}{int(r.zipf(1.3)) % 300}" for _ in range(n))
    docs = [(i, text(int(r.integers(0, 60)))) for i in range(600)]
    docs += [(7, docs[7][1]), (7, "other words"), (None, docs[9][1]), (601, None), (602, ""), (603, text(20_000)), *((700 + i, "wort1 wort2 same") for i in range(30))]
    items = [(f"i{k}", text(12)) for k in range(25)] + [("i1", "more Wort7"), (None, "same wort1"), ("none", None), ("void", "... ,"), ("far", "nothinghasthis")]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int").repartition(5)
    asked = spark.createDataFrame([(*x, 2) for x in items], "item_id string, text string, doc_id int")
    want = slow(docs, items)
    for rows, shard in ((200_000, 3_000_000), (40, 500)):
        monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", shard)
        assert sorted((tuple(x) for x in ranked_search.ranked(df, asked, block_rows=rows).collect()), key=str) == want
    assert ranked_search.ranked(df.limit(0), asked).count() == 0 and ranked_search.ranked(df, asked.limit(0)).count() == 0
    assert ranked_search.ranked(df, asked).columns == ["item_id", "rank", "doc_id", "score"]
