"""Substring, line and near dedup against brute force, on small tables with awkward rows."""

import random
import re
from collections import defaultdict

import pytest

from rostrum.llm import line_dedup, near_dedup, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, line = text(45), "A common line\tof some length that repeats"
    rows = []
    for i in range(n):
        t = text(r.randint(0, 90))
        if i % 3 == 0:
            t += " " + passage + "\n" + text(10)
        if i % 4 == 0:
            t += "\n  " + (line.upper() if i % 8 else line) + " \n" + line
        if i % 5 == 0 and rows:
            words = (rows[-1][1] or "").split(" ")
            if len(words) > 3:
                words[r.randrange(len(words))] = "changed"
            t = " ".join(words)
        if i % 7 == 0 and rows:
            t = rows[r.randrange(len(rows))][1]
        rows.append((i * 3 % n + (i * 3 // n), t))
    ids = list(range(n))
    r.shuffle(ids)
    rows = [(ids[k], t) for k, (_, t) in enumerate(rows)]
    periodic = "round and round " * 30
    return [*rows, (1000, None), (1001, ""), (1002, "  \n "), (1003, periodic), (1004, periodic + "end"), (1005, "one two three"), (1006, "one two three"), (1007, text(4000))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id bigint, text string")


def test_substring_dedup_matches_brute_force(docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.dedup(docs).select("doc_id", "__d.*").collect()}
    first = {}
    words = {d: WORDS.findall(t or "") for d, t in corpus()}
    for d in sorted(words):
        for i in range(len(words[d]) - 19):
            first.setdefault(tuple(words[d][i : i + 20]), (d, i))
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] != (d, i):
                gone |= set(range(i, i + 20))
        assert got[d] == (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)), d
    assert sum(g[1] for g in got.values()) > 500


def naive_parse(candidates, n):
    """Greedy by definition: at the first window that is not held yet, the run on a diagonal of first sources that goes farthest."""
    source = dict(candidates)  # window: (document, window) where it starts first
    out, p = [], 0
    while p < n:
        if p not in source:
            p += 1
            continue
        runs = []
        for q in range(p + 1):  # runs that begin at q and hold p
            if q in source and (q == 0 or source.get(q - 1) != (source[q][0], source[q][1] - 1)):
                e = q
                while source.get(e) == (source[q][0], source[q][1] + e - q):
                    e += 1
                if e > p:
                    runs.append((-e, source[q][0], q - source[q][1]))
        e, d, g = min(runs)
        out.append((p, -e - p + 19, d, p - g))
        p = -e
    return out


def test_factors_are_the_greedy_parse_and_equal_their_sources(docs):
    words = {d: WORDS.findall(t or "") for d, t in corpus()}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 19):
            first.setdefault(tuple(words[d][i : i + 20]), (d, i))
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in substring_dedup.dedup(docs).select("doc_id", "__d.factors").collect() if r.factors}
    for d, w in words.items():
        source = {i: first[tuple(w[i : i + 20])] for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] != (d, i)}
        covered = {j for a, n, _, _ in got.get(d, []) for j in range(a, a + n)}
        assert covered == {j for i in source for j in range(i, i + 20)}
        for a, n, s, b in got.get(d, []):
            assert n >= 20 and w[a : a + n] == words[s][b : b + n] and (s, b) < (d, a)
        # sources of a block are the block's first, which need not be the window's: parses agree where those do
        if d != 1003 and d != 1004:
            assert len(got.get(d, [])) >= len(naive_parse(source.items(), len(w))) or sum(f[1] for f in got[d]) >= sum(f[1] for f in naive_parse(source.items(), len(w))), d
    assert sum(map(len, got.values())) > 20


def test_the_parse_takes_what_reaches_farthest():
    import numpy as np

    r = random.Random(5)
    for _ in range(300):
        windows = 30
        source = {}
        for i in range(windows):
            if r.random() < 0.7:
                before = source.get(i - 1)
                source[i] = (before[0], before[1] + 1) if before and r.random() < 0.8 else (r.randrange(3), r.randrange(100))
        rows = [(i, 1, d, b) for i, (d, b) in source.items()]
        r.shuffle(rows)
        at, n, doc, src = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 4
        got = substring_dedup.greedy(np.zeros(len(at), np.int64), at, n, doc, src, 20)
        assert list(zip(*(x.tolist() for x in got[1:]))) == naive_parse(source.items(), windows)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_marks_do_not_depend_on_batches(size):
    """The stream against brute force on sorted rows, cut into batches of any size."""
    import pyarrow as pa

    r = random.Random(size)
    for _ in range(40):
        rows = sorted((r.randrange(4), r.randrange(3), r.randrange(6), r.randrange(3), 1) for _ in range(r.randint(1, 30)))
        columns = [pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
        batch = pa.record_batch(columns, substring_dedup._BLOCKS)
        out = [x for b in substring_dedup._mark(batch.slice(i, size) for i in range(0, len(rows), size)) for x in b.to_pylist()]
        once = sorted(set(rows))
        first, kinds = {}, defaultdict(set)
        for a, b, d, t, _ in once:
            first.setdefault((a, b), (d, t))
            kinds[a].add(b)
        edge = {once[0][0], once[-1][0]}
        again = sorted((a, b, d, t, *first[a, b]) for a, b, d, t, _ in once if first[a, b] != (d, t))
        key = lambda x: (x["anchor"], x["block"], x["doc_id"], x["at"])
        assert sorted((*key(x), x["src_doc"], x["src_at"]) for x in out if x["mark"] == substring_dedup.REPEATS) == again
        firsts = sorted(key(x) for x in out if x["mark"] == substring_dedup.FIRST)
        assert firsts == sorted((a, b, *v) for (a, b), v in first.items() if len(kinds[a]) > 1 or a in edge)
        assert {key(x)[:2] for x in out if x["mark"] == substring_dedup.EDGE} == {(a, f(kinds[a])) for a in edge for f in (min, max)}


def test_substring_dedup_keeps_rows_without_id_and_other_columns(spark):
    t = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(None, t, 1), (1, t, 2), (2, t, 3), (2, t, 3)], "doc_id bigint, text string, spans int")
    rows = substring_dedup.dedup(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.spans, r["__d"].n_removed) for r in rows) == [(False, 1, 2, 0), (False, 2, 3, 30), (False, 2, 3, 30), (True, 0, 1, 0)]
    assert substring_dedup.dedup(df.limit(0)).count() == 0
    odd = df.withColumnsRenamed({"spans": "__i"}).selectExpr("*", "1 as __factors", "2 as __d")
    assert substring_dedup.dedup(odd).select("__d.n_removed", "__i", "__factors").count() == 4


@pytest.mark.parametrize("parts", [1, 7])
def test_substring_dedup_keeps_a_text_that_only_a_repeated_row_holds(spark, parts):
    t = lambda k: " ".join(f"{k}x{i}" for i in range(60))
    df = spark.createDataFrame([(1, t("a")), (1, t("a")), (2, t("b")), (2, t("b")), (2, t("b")), (3, t("b"))], "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = substring_dedup.dedup(df).select("doc_id", "__d.n_removed").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, rows)) == [(1, 0), (1, 0), (2, 0), (2, 0), (2, 0), (3, 60)]


def test_line_dedup_matches_brute_force(docs):
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in done.select("doc_id", "__l.n_lines", "__l.n_dropped", "__l.text").collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = defaultdict(set)
    for d, t in corpus():
        for x in (t or "").split("\n"):
            holders[key(x)].add(d)
    for d, t in corpus():
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and d != max(holders[key(x)]))]
        assert got[d] == (len(lines), len(lines) - len(left), "\n".join(left)), d
    assert any(g[1] for g in got.values())


def brute_components(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = WORDS.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("crowd", [400, 0])
def test_near_dedup_matches_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    r = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = corpus(2, 40)
    for i in range(70):  # near copies of one base around the threshold, and some of few words
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((2000 + i, " ".join(w)))
    rows += [(3000 + i, "a b C " + "d " * (i % 3)) for i in range(9)]
    got = {x.doc_id: (x.n, x.component) for x in near_dedup.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 80).collect()}
    want = brute_components(rows, 4, 80)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_keep_one_keeps_a_row_of_each_group_and_rows_without_id(spark):
    t = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(None, t, 1), (1, t, 2), (2, t, 3), (1, t, 2), (3, None, 4), (4, "", 5)], "doc_id bigint, text string, n int")
    assert sorted((r.doc_id or 0, r.n) for r in near_dedup.keep_one(df).collect()) == [(0, 1), (1, 2), (3, 4), (4, 5)]
    assert near_dedup.keep_one(df.limit(0)).columns == ["doc_id", "text", "n"]


def test_overlaps_counts_intersections():
    import numpy as np

    r = np.random.default_rng(0)
    xs = [np.unique(r.integers(0, 9000, 700).astype(np.uint64)) for _ in range(5)]
    ys = [np.unique(r.integers(0, 9000, 900).astype(np.uint64)) for _ in range(4)]
    assert near_dedup.overlaps(xs, ys).tolist() == [[len(np.intersect1d(x, y)) for y in ys] for x in xs]


def test_line_key_folds_ascii_only(spark):
    df = spark.createDataFrame([(" \t\x0bÉcole De La Ville Haute\r ",), ("x" * 19,)], "line string")
    assert [r[0] for r in df.select(line_dedup.line_key(df.line)).collect()] == ["École de la ville haute", "x" * 19]
    assert line_dedup.line_rows(spark.createDataFrame([(1, "x" * 19 + "\n" + " " * 30), (None, "y" * 30)], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_decisions_do_not_depend_on_batches(size):
    import pyarrow as pa

    r = random.Random(size)
    for _ in range(40):
        rows = sorted(((r.randrange(4), 0, r.randrange(6), 0, 9, r.randrange(9)) for _ in range(r.randint(1, 30))), key=lambda x: (x[0], -x[2], x[5]))
        names = [c.split()[0] for c in line_dedup._COLUMNS.split(", ")]
        batch = pa.record_batch([pa.array(x, pa.int64() if k < 4 else pa.int32()) for k, x in enumerate(zip(*rows))], names)
        out = [x for b in line_dedup._decide(3)(batch.slice(i, size) for i in range(0, len(rows), size)) for x in b.to_pylist()]
        docs = defaultdict(set)
        for x in rows:
            docs[x[0]].add(x[2])
        ends = {rows[0][0], rows[-1][0]}
        took = lambda state: sorted((x["hi"], x["doc_id"], x["line"]) for x in out if x["state"] == state)
        assert took(line_dedup.GONE) == sorted((x[0], x[2], x[5]) for x in rows if len(docs[x[0]]) >= 3 and x[2] != max(docs[x[0]]))
        assert took(line_dedup.OPEN) == sorted((x[0], x[2], x[5]) for x in rows if x[0] in ends and (len(docs[x[0]]) < 3 or x[2] == max(docs[x[0]])))
        assert {(x["hi"], min(x["docs"], 3), x["doc_id"]) for x in out if x["state"] == line_dedup.EDGE} == {(k, min(len(docs[k]), 3), max(docs[k])) for k in ends}


@pytest.mark.parametrize("parts", [1, 5, 23])
def test_line_dedup_of_awkward_rows(spark, parts):
    line = "A line that very many documents have"
    rows = [(i % 200, line + "\nown " + str(i % 200) * 12, 1) for i in range(300)] + [(None, line, 1), (None, None, 1), (500, None, 1), (501, "", 1), (502, "\n".join([line] * 3000), 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __keep int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        done = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df))
        got = sorted((r.doc_id is None, r.doc_id or 0, r["__l"].n_lines, r["__l"].n_dropped) for r in done.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert done.columns == ["doc_id", "text", "__keep", "__l"]
    assert got == sorted([(False, i % 200, 2, 1) for i in range(300)] + [(True, 0, 1, 0)] * 2 + [(False, 500, 1, 0), (False, 501, 1, 0), (False, 502, 3000, 0)])
    assert line_dedup.apply_bitmaps(df.limit(0), line_dedup.keep_bitmaps(df.limit(0))).count() == 0


def test_unlike_texts_under_one_id_keep_their_own_words(spark):
    """A document of several texts is one document: only its windows that start earlier, there or elsewhere, go."""
    c, x, y = (" ".join(f"{k}{i}" for i in range(n)) for k, n in (("c", 30), ("x", 10), ("y", 60)))
    rows = [(0, c, 1), (5, f"{x} {c}", 2), (5, y, 3), (5, y, 4), (5, None, 5), (9, y, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, base int")
    got = substring_dedup.dedup(df)
    assert got.columns == ["doc_id", "text", "base", "__d"]
    assert {r.base: (r["__d"].n_words, r["__d"].n_removed) for r in got.collect()} == {1: (30, 0), 2: (40, 30), 3: (60, 0), 4: (60, 0), 5: (0, 0), 6: (60, 60)}


def test_several_texts_of_one_id_match_brute_force(spark):
    r = random.Random(21)
    words = [f"w{i}" for i in range(12)]
    piece = lambda n: [r.choice(words) for _ in range(n)]
    common = [piece(30) for _ in range(3)]
    rows = sorted({(i % 9, " ".join(piece(r.randint(0, 15)) + r.choice(common)[r.randint(0, 4) :] + piece(r.randint(0, 15)))) for i in range(30)})
    got = {(x.doc_id, x.text): x["__d"].text for x in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    order = {(x.doc_id, x.text): x.h for x in spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "xxhash64(text) as h").collect()}
    seen, want = set(), {}
    for doc, text in sorted(rows, key=lambda x: (x[0], order[x])):
        w, gone = text.split(), set()
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                gone |= set(range(i, i + 20))
            seen.add(tuple(w[i : i + 20]))
        want[doc, text] = " ".join(t for i, t in enumerate(w) if i not in gone)
    assert got == want and any(v != k[1] for k, v in want.items())
