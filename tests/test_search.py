"""Similarity in batches, its bounds, and the pruned search against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from rostrum.functions import similarity
from rostrum.operators import resolve


def words(r, n, letters="abcde "):
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_batches_equal_the_measure_of_one_pair():
    r = random.Random(1)
    a, b = words(r, 3000), words(r, 3000)
    a += ["", "x", "same", "é" * 5, "a" * 64, "ab" * 40, "martha"]
    b += ["x", "", "same", "é" * 4 + "f", "a" * 63 + "b", "ba" * 40, "marhta"]
    for part in (slice(None, -7), slice(-7, None), slice(0, 1)):
        assert np.allclose(similarity.jaro_batch(a[part], b[part]), [similarity.jaro(x, y) for x, y in zip(a[part], b[part], strict=True)], atol=1e-15)


def test_columns_and_bounds(spark):
    r = random.Random(2)
    rows = list(zip(words(r, 800), words(r, 800), strict=True)) + [(None, "a"), ("a", None), ("", ""), ("abcdefg", "abcdxyz")]
    df = spark.createDataFrame(rows, "a string, b string")
    common = F.size(F.array_intersect(similarity.numbered_letters(F.col("a")), similarity.numbered_letters(F.col("b"))))
    bound = similarity.raised(similarity.jaro_bound(common, F.length("a"), F.length("b")), F.col("a"), F.col("b"))
    for x in df.select("a", "b", similarity.jaro_udf("a", "b").alias("j"), similarity.jaro_winkler_column(F.col("a"), F.col("b")).alias("w"), bound.alias("bound")).collect():
        if x.a is None or x.b is None:
            assert x.j is None and x.w is None
            continue
        assert abs(x.j - similarity.jaro(x.a, x.b)) < 1e-12 and abs(x.w - similarity.jaro_winkler(x.a, x.b)) < 1e-12
        assert x.a == x.b == "" or x.bound >= x.w - 1e-12


def names(r, n):
    syllables = [a + b for a in "bcdfghklmnprstvz" for b in ("a", "e", "i", "o", "u", "an", "er", "in")]
    word = lambda: "".join(r.choices(syllables, k=r.randint(2, 3)))
    return [f"{word()} {word()}" for _ in range(n)]


def slow(queries, people, least=0.5, most=10):
    out = []
    for query_id, scope, q in queries:
        if len(q) < 3:
            continue
        scored = []
        for person_id, where, p in people:
            if where == scope and p:
                jw = similarity.jaro_winkler(q, p)
                held = sum(w in p.split(" ") for w in q.split(" ")) / len(q.split(" "))
                scored.append((-max(jw, 0.3 * jw + 0.7 * held), person_id))
        out += [(query_id, p, place) for place, (s, p) in enumerate(sorted(x for x in scored if -x[0] >= least)[:most], 1)]
    return sorted(out)


def test_search_equals_brute_force(spark):
    r = random.Random(3)
    people = [(i, i % 3, n) for i, n in enumerate(names(r, 900) + ["", "ann", "ann lee", "lee ann"] * 3)]
    queries = []
    for i in range(60):
        n = r.choice(people)[2] or "zz"
        queries.append((i, r.randrange(4), r.choice([n, n[:-2], n[1:], n.split()[0], n[::-1], "q" + n, "x y", "ab"])))
    q = spark.createDataFrame(queries, "query_id long, scope long, query string")
    p = spark.createDataFrame(people, "person_id long, scope long, name string")
    got = resolve.search(q, p).collect()
    assert sorted((x.query_id, x.person_id, x.place) for x in got) == slow([(i, s, " ".join(n.split())) for i, s, n in queries], people)
    tight = resolve.search(q, p, least=0.8, most=3).collect()
    assert sorted((x.query_id, x.person_id, x.place) for x in tight) == slow(queries, people, 0.8, 3)


def test_search_scores_a_small_part_of_all_pairs(spark):
    r = random.Random(4)
    people = [(i, 0, n) for i, n in enumerate(names(r, 20_000))]
    queries = [(i, 0, r.choice(people)[2][: r.choice([7, 30])]) for i in range(25)]
    q, p = spark.createDataFrame(queries, "query_id long, scope long, query string"), spark.createDataFrame(people, "person_id long, scope long, name string")
    survivors = resolve.search_candidates(q, p).count()
    assert survivors < 25 * 20_000 / 20, survivors
    assert sorted((x.query_id, x.person_id, x.place) for x in resolve.search(q, p).collect()) == slow([(i, s, n.strip()) for i, s, n in queries], people)
