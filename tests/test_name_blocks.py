"""Blocks of names against the measure of one pair, and a search whose names are all alike in length and first letters."""

import random

import numpy as np

from rostrum.functions import similarity
from rostrum.operators import resolve
from tests.test_search import slow


def test_a_block_scores_and_bounds_as_single_pairs():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcde ") for _ in range(r.choice([1, 3, 5, 9, 14, 70]))).strip() or "x"
    names = [word() for _ in range(400)]
    block = similarity.NameBlock(names)
    for _ in range(40):
        q = " ".join((word() + "abc").split())
        jw = np.array([similarity.jaro_winkler(q, n) for n in names])
        held = np.array([sum(t in n.split(" ") for t in q.split(" ")) / len(q.split(" ")) for n in names])
        want = np.maximum(jw, 0.3 * jw + 0.7 * held)
        assert np.allclose(block.scores(q, np.arange(400)), want, atol=1e-12) and (block.bounds(q) >= want).all()
        best = set(block.best(q, 0.5, 3))
        assert all(i in best for i in np.argsort(-want, kind="stable")[:3] if want[i] >= 0.5)


def test_alike_names_meet_in_blocks(spark, monkeypatch):
    """Names of one bucket all pass bounds by letters alone: of 6,000 pairs each block gives the best only."""
    monkeypatch.setattr(resolve, "BLOCK_NAMES", 60)
    monkeypatch.setattr(resolve, "BLOCK_QUERIES", 7)
    people = [(i, 0, f"customer{i % 250:09d}") for i in range(300)]
    queries = [(i, 0, f"customer 0000{i * 7}") for i in range(20)]
    q, p = spark.createDataFrame(queries, "query_id long, scope long, query string"), spark.createDataFrame(people, "person_id long, scope long, name string")
    assert resolve.search_candidates(q, p).count() < 20 * 300 / 2
    assert sorted((x.query_id, x.person_id, x.place) for x in resolve.search(q, p).collect()) == slow(queries, people)
