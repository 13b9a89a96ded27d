"""Suffix order and periodic runs against brute force, and edge cases of the operator."""

import hashlib
import random
import zlib

import numpy as np

from rostrum.llm import periodic_runs
from rostrum.llm.suffixes import least_between, minima, next_smaller, runs, suffixes


def slow_runs(w, exponent):
    n, out = len(w), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(w[t] == w[t + r] for t in range(i, i + length - r)) for r in range(1, q))
            if j > i and length >= exponent * q and not smaller:
                out.add((i, length, q))
            i = max(j, i + 1)
    return out


def test_runs_match_brute_force():
    r = random.Random(1)
    for _ in range(400):
        seqs = [[r.randint(0, r.choice([1, 2, 3])) for _ in range(r.choice([0, 1, 3, 10, 30]))] for _ in range(r.randint(1, 4))]
        seqs.append((seqs[0] or [1]) * 5 + [7])
        first = np.cumsum([0] + [len(s) for s in seqs])
        words = np.array([x for s in seqs for x in s], np.uint64)
        for exponent in (2, 3, 4):
            got = sorted(zip(*(x.tolist() for x in runs(words, first, exponent)), strict=True))
            assert got == sorted((k, *x) for k, s in enumerate(seqs) for x in slow_runs(s, exponent))


def test_suffixes_are_in_order_and_know_their_common_prefixes():
    r = random.Random(2)
    for _ in range(100):
        w = [r.randint(1, 3) for _ in range(r.randint(1, 40))] + [0]
        s = suffixes(np.array(w), np.zeros(len(w), np.int64))
        place = np.argsort(s.rank)
        assert place.tolist() == sorted(range(len(w)), key=lambda i: w[i:])
        table = minima(s.lcp)
        for a in range(len(w)):
            for b in range(a):
                n = next(k for k in range(len(w)) if w[a + k] != w[b + k])
                assert s.common(np.array([a]), np.array([b]), table)[0] == n


def test_next_smaller_and_least_between():
    r = random.Random(3)
    for v in [[5, *range(300, 6, -1), 0], *(r.sample(range(1, 99), 60) + [0] for _ in range(50))]:
        v = np.array(v)
        at = np.arange(len(v) - 1)
        assert next_smaller(v, at)[at].tolist() == [next(j for j in range(i + 1, len(v)) if v[j] < v[i]) for i in at]
        low = np.array([r.randrange(len(v)) for _ in range(30)])
        high = np.array([r.randrange(x, len(v)) for x in low])
        assert least_between(minima(v), low, high).tolist() == [v[a : b + 1].min() for a, b in zip(low, high, strict=True)]


def slow_result(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted((s, length, q) for s, length, q in slow_runs(w, 4) if length >= 6)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if found else None
    return doc_id, len(found), *best, milli, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_query_matches_brute_force(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("ab é c".split() + ["x\ty", "z "]) for _ in range(r.choice([0, 1, 5, 40, 90])))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "a b " * 50), (1003, "a b " * 50), (1004, "one two three\n" * 400)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(str(slow_result(*x)) for x in rows)


def test_edges(spark):
    df = spark.createDataFrame([(None, "q " * 20, 1), (1, "a  b", 2), (2, None, 3)], "doc_id bigint, text string, __r int")
    found = {x["doc_id"]: x["__r"] for x in periodic_runs.find_runs(df).collect()}
    assert found[None].n_words == 20 and found[None].text == "q" and [tuple(x) for x in found[None].runs] == [(0, 20, 1)]
    assert found[2].n_words == 0 and found[2].text == "" and found[2].runs == []
    back = periodic_runs.collapse(df.select("doc_id", "text"))
    assert back.columns == ["doc_id", "text"] and sorted(x.text or "-" for x in back.collect()) == ["-", "a  b", "q"]
    assert periodic_runs.find_runs(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    text = "x y z " * 100_000 + " ".join(map(str, range(100_000)))
    found = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()["__r"]
    assert [tuple(x) for x in found.runs] == [(0, 300_000, 3)] and len(found.text.split()) == 100_003


def test_planting_needs_an_id_and_words(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    df = spark.createDataFrame([(None, "a b"), (ids[0], None), (ids[0], " ")], "doc_id bigint, text string")
    assert [x[0] for x in df.select(periodic_runs.planted(df.doc_id, df.text)).collect()] == ["a b", None, " "]
