"""The language model: base scores against brute force, normalisation, learning, and edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rostrum.llm import log_bilinear
from rostrum.llm.log_bilinear import ENDINGS, END, FREQUENT, Counts, Tokens, endings
from rostrum.llm.log_bilinear_model import BEFORE, Model, contexts
from rostrum.llm.lookup import HashIndex
from rostrum.llm.words import SPACED_LOWER, words_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def tokens_of(text):
    return [x.translate(FOLD) for x in WORDS.findall(text or "")] + [None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def slow_base(rows):
    count = Counter(x for i, t in rows if not held(i) for x in tokens_of(t))
    n, v = count.total(), len(count)
    for i, t in rows:
        w = tokens_of(t)
        yield i, held(i), len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)


def corpus(n, seed=0):
    """Two languages of words that never meet in one text."""
    r = random.Random(seed)
    words = [[f"{a}{b}{e}" for a in "bdfgklm" for b in "aeiou" for e in ends] for ends in (("ing", "ed", "the", "of"), ("eux", "ée", "la", "de"))]
    return [(i, " ".join(r.choices(w, weights=range(1, len(w) + 1), k=r.randint(5, 120)))) for i in range(n) for w in [words[r.random() < 0.3]]]


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(x) for x in log_bilinear.op11_language_model(spark, str(tmp_path)).collect()]


@pytest.mark.parametrize("known", [262_144, 40])
def test_base_scores_match_brute_force_and_the_model_beats_them(spark, tmp_path, monkeypatch, known):
    monkeypatch.setattr(log_bilinear, "KNOWN", known)
    rows = corpus(1200) + [(None, "bating Once\x0bmore"), (5000, None), (5001, " \n"), (5002, "UNSEEN unseen Éa"), (7, "Bating 3"), (7, "Bating 3"), (5003, "baing " * 30_000)]
    got = write(spark, tmp_path, rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[2], x[3])
    for g, want in zip(sorted(got, key=key), sorted(slow_base(rows), key=key), strict=True):
        assert g[:5] == want[:5] and g[5] == pytest.approx(want[5], rel=1e-9)
        assert g[6] < 0
    test = [x for x in got if x[1] and x[2] < 1000]
    assert len(test) > 60 and sum(x[6] for x in test) > 0.95 * sum(x[5] for x in test)  # both are below 0


def test_outcomes_and_words_are_normalised(spark):
    texts = [t for _, t in corpus(300)]
    words = log_bilinear.count_words(spark.createDataFrame([(t,) for t in texts], "text string"))
    counts = Counts.of(words, len(texts))
    r = np.random.default_rng(1)
    model = Model.start(counts.frequency)
    index = HashIndex(counts.hashes)
    t = Tokens.of(pa.array(texts), index)
    before = contexts(t.outcome, t.first, END)
    for _ in range(2):
        model.learn_all(before, t.outcome, counts.frequency, r)
    some = before[:, r.integers(0, before.shape[1], 20)]
    each = np.stack([model.log_probability(some, np.full(20, k)) for k in range(END + 1)])
    assert np.allclose(np.exp(each).sum(0), 1, atol=1e-3)
    rows = words.collect()
    top = {x["hash"] for x in rows if index.find(np.array([x["hash"]], np.int64).view(np.uint64))[0] < FREQUENT}
    for e in range(ENDINGS):
        own = [x["c"] for x in rows if x["ending"] == e and x["hash"] not in top]
        assert math.isclose(sum(c + 0.1 for c in own) + 0.1, 10 ** counts.within[FREQUENT + e], rel_tol=1e-9)


def test_large_logits_are_scored():
    model = Model.start(np.full(8, 1 / 8, np.float32))
    model.bias[3] = 200
    before = np.zeros((BEFORE, 2), np.int32)
    assert np.allclose(model.log_probability(before, np.array([3, 0])), [0, -200 + np.log(1 / 8)], atol=1e-2)


def test_contexts_stay_in_their_text():
    assert contexts(np.array([1, 2, 9, 9, 3, 9]), np.array([0, 3, 4, 6]), 9).tolist() == [[9, 1, 2, 9, 9, 3], [9, 9, 1, 9, 9, 9], [9] * 6]


def test_endings_do_not_depend_on_what_stands_around():
    w = words_of(pa.array(["a Tion ion", "on", "x,tion"]), SPACED_LOWER)
    e = endings(w)
    assert e[1] == e[2] == e[4] and len(set(e[[0, 1, 3]])) == 3


def test_edges(spark, tmp_path):
    assert write(spark, tmp_path / "a", []) == []
    only = next(i for i in range(100) if held(i))
    assert write(spark, tmp_path / "b", [(only, "a b")]) == [(only, True, 3, 0, 0, 0.0, pytest.approx(-3 * math.log10(FREQUENT + ENDINGS + 1), abs=1))]
    df = spark.createDataFrame([(1, "a b a", 1, 2, 3), (2, None, 4, 5, 6)], "doc_id bigint, text string, __row int, __m int, n_tokens int")
    found = log_bilinear.score_texts(df, df.doc_id.isNotNull())
    assert found.columns == ["doc_id", "__row", "n_tokens", "__m"]
    assert {x.doc_id: (x["__row"], x.n_tokens, x["__m"].n_tokens, x["__m"].n_known) for x in found.collect()} == {1: (1, 3, 4, 4), 2: (4, 6, 1, 1)}


def test_products_of_tables_give_what_logits_give():
    r = np.random.default_rng(4)
    model = Model.start(np.full(40, 1 / 40, np.float32))
    model.outcome += r.standard_normal(model.outcome.shape).astype(np.float32)
    before, target = r.integers(0, 40, (BEFORE, 3000)), r.integers(0, 40, 3000)
    assert np.allclose(model.log_probability(before, target), model._log_probability(before, target), atol=1e-5)
    assert model.log_probability(before[:, :0], target[:0]).shape == (0,)
