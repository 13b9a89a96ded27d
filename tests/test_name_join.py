"""Joins of names that hold one another: exact against brute force, with few candidates."""

import random

import pytest
from pyspark.sql import functions as F

from rostrum.operators import resolve
from rostrum.operators.name_join import text_candidates, text_pairs, word_candidates, word_pairs


def sides(spark, parts, wholes):
    frame = lambda rows, c: spark.createDataFrame([(k, x) for k, rows in enumerate(rows) for x in rows], f"side int, {c} string")
    return frame(parts, "part"), frame(wholes, "whole")


def pool(r, n):
    word = lambda: "".join(r.choice("abc") for _ in range(r.choice([1, 1, 2, 3, 6])))
    return sorted({" ".join(word() for _ in range(r.randint(2, 5))) for _ in range(n)})


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_pairs_by_words_and_by_text(spark, levels):
    r = random.Random(levels)
    names = pool(r, 150)
    one, two = names[::2], sorted({*names[1::2], *names[:5]})
    p, w = sides(spark, (one, two), (two, one))
    words = sorted((x.side, x.part, x.whole) for x in word_pairs(p, w, levels).collect())
    assert words == sorted((k, a, b) for k, (x, y) in enumerate(((one, two), (two, one))) for a in x for b in y if set(a.split()) <= set(b.split()))
    text = sorted((x.side, x.part, x.whole) for x in text_pairs(p, w).collect())
    assert text == sorted((k, a, b) for k, (x, y) in enumerate(((one, two), (two, one))) for a in x for b in y if a in b)
    assert len(words) > 30 and len(text) > 10


def test_the_first_entry_that_matches_counts(spark):
    r = random.Random(9)
    names = pool(r, 200) + ["a", "b", "cc"]
    entries, asked = names[::2], names[1::2]
    r.shuffle(entries)
    entries += entries[:7]
    index = spark.createDataFrame([(100 + i, i, x.upper()) for i, x in enumerate(entries)], "person_id long, ordinal long, display_name string")
    got = {x.name: x.person_id for x in resolve.match_names(spark.createDataFrame([(x,) for x in [*asked, "", None, "É"]], "name string"), index).collect()}

    def match(a, b):
        x, y = a.split(), b.split()
        return len(x) > 1 and len(y) > 1 and (a in b or b in a or set(x) <= set(y) or set(y) <= set(x))

    def slow(a):
        hits = [i for i, b in enumerate(entries) if a == b] or [i for i, b in enumerate(entries) if match(a, b)]
        return 100 + hits[0] if hits else None

    assert got == {a: k for a in asked if (k := slow(a)) is not None} and len(got) > 30


def test_few_candidates_though_words_are_frequent(spark):
    """20,000 names of frequent first and middle names; a tenth of them are asked for with a name less, in another order, or cut."""
    r = random.Random(3)
    syllables = [a + b for a in "bcdfghklmnprstvz" for b in ("a", "e", "i", "o", "u", "an", "er", "in")]
    word = lambda: "".join(r.choices(syllables, k=3))
    first, last = [word() for _ in range(40)], [word() for _ in range(4000)]
    weights = [1 / (i + 1) for i in range(len(last))]
    people = sorted({" ".join([r.choice(first), r.choice(first), r.choices(last, weights)[0], r.choices(last, weights)[0]]) for _ in range(20_000)})
    asked = set()
    for name in r.sample(people, 2000):
        w = name.split()
        asked.add(r.choice([" ".join(w[:1] + w[2:]), " ".join([w[3], w[0], w[2]]), " ".join(w[1:])[2:], " ".join(w[1:])]))
    asked = sorted(asked - set(people))
    p, w = sides(spark, (asked, people), (people, asked))
    for candidates, pairs in ((word_candidates, word_pairs), (text_candidates, text_pairs)):
        met = candidates(p, w).select("side", "part", "whole")
        n, matches = met.count(), pairs(p, w).count()
        most = met.exceptAll(pairs(p, w)).groupBy("side", "part").count().agg(F.max("count")).first()[0] or 0  # beyond the matches
        assert matches >= 500 and n <= 10 * matches, (candidates.__name__, n, matches)
        assert most <= (len(people) + len(asked)) / 256, (candidates.__name__, most)
