"""Quality rules, mixing, sharding, decontamination, personal data, languages, main text: brute force and edge cases."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rostrum.llm import decontaminate, language_id, mixing, pii, quality_rules, sharding
from rostrum.llm.html_wrappers import Group, Node, Pair, Wrapper, _across, _align_middle, extract, merge_nodes, packed, unpacked, wrapper_of
from rostrum.llm.html_tokens import tree

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_measures(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def test_measures_match_brute_force():
    r = random.Random(4)
    texts = [None, "", " \n ", "a a a a a", "x\nx\n x\n\n", "é" * 5000]
    texts += ["".join(r.choice("ab é#|\n\t ") for _ in range(r.randint(0, 200))) for _ in range(200)]
    for t in texts:
        assert quality_rules.measure(t) == slow_measures(t), t


def test_quality_rules_drop_outliers_and_keep_the_rest(spark):
    r = random.Random(5)
    clean = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(r.randint(60, 200)))
    rows = [(i, clean(), r.choice(["en", "fr", None]), r.choice(["a", "b", None]), 1) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "###" for w in clean().split()), "en", "a", 1) for i in range(10)]
    short = [(2000, "few words", "en", "a", 1), (2001, None, None, None, 1), (2002, "loop de loop " * 40, "en", "b", 1)]
    df = spark.createDataFrame(rows + junk + short, "doc_id bigint, text string, lang string, source string, rows int")
    kept = {x.doc_id for x in quality_rules.keep_good(df).collect()}
    assert kept == {x[0] for x in rows}
    assert quality_rules.keep_good(df).columns == df.columns
    twice = df.unionByName(df).selectExpr("*", "1 as __key", "2 as __t")
    assert sorted(x.doc_id for x in quality_rules.keep_good(twice).collect()) == sorted(2 * list(kept)) and quality_rules.keep_good(twice).columns == twice.columns
    assert quality_rules.keep_good(df.limit(0)).count() == 0


def test_quality_rules_never_judge_a_rare_language_by_another(spark):
    r = random.Random(15)
    clean = lambda low, high: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(low, high))) for _ in range(80))
    rows = [(i, clean(2, 6), "en", "a") for i in range(1600)]
    rare = [(1000 * k + i, clean(16, 24), f"rare{k}", "a") for k in (1, 5, 60, 99, 100) for i in range(k)]
    junk = [(900_000 + k, " ".join(w + "#" * 30 for w in clean(16, 24).split()), f"rare{k}", "a") for k in (5, 60, 99, 100)]
    df = spark.createDataFrame(rows + rare + junk, "doc_id bigint, text string, lang string, source string")
    assert {x.doc_id for x in quality_rules.keep_good(df).collect()} == {x[0] for x in rows + rare}


def test_knapsack_is_the_best_sum():
    r = random.Random(6)
    for _ in range(60):
        size = sorted(r.sample(range(1, 30), 4))
        count = [r.randint(0, 3) for _ in size]
        budget = r.randint(0, 60)
        sums = {0}
        for s, c in zip(size, count):
            sums = {x + k * s for x in sums for k in range(c + 1)}
        take = mixing.knapsack(np.array(size), np.array(count), budget)
        assert all(0 <= t <= c for t, c in zip(take, count))
        assert sum(t * s for t, s in zip(take, size)) == max(x for x in sums if x <= budget)


def test_targets_share_the_excess_until_none_is_above():
    t = mixing.targets({"b": 100, "a": 10, None: 50, "c": 400})
    assert list(t) == ["a", "b", "c", None]
    assert t["a"] == 20 and abs(sum(t.values()) - 1.5 * 560) < 1e-6
    assert all(v <= 2 * s + 1e-9 for v, s in zip(t.values(), (10, 100, 400, 50)))
    assert mixing.targets({}) == {}


def test_mix_comes_to_its_targets_and_reruns_agree(spark):
    r = random.Random(7)
    rows = [(i, " ".join("w" * r.choice([1, 5, 5, 5, 40])) if i % 9 else None, r.choice(["s1", "s2", "s3", None])) for i in range(400)]
    rows += [(5000 + i, "same length here", "s1") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    done = mixing.mix(df).select("doc_id", "source", "__m.*").collect()
    assert len(done) == len(rows) and all(0 <= x.copies <= 2 and (x.copies == 0 or x.size) for x in done)
    for s in {x.source for x in done}:
        own = [x for x in done if x.source == s]
        assert abs(sum(x.size * x.copies for x in own) - own[0].target) <= 1
        assert own[0].source_size == sum(x.size for x in own)
    again = mixing.mix(df.repartition(3)).select("doc_id", "__m.copies").collect()
    assert sorted((x.doc_id, x.copies) for x in again) == sorted((x.doc_id, x.copies) for x in done)
    assert mixing.mixed(df).count() == sum(x.copies for x in done)
    assert mixing.mixed(df.limit(0)).count() == 0
    odd = df.unionByName(df).selectExpr("*", "1 as s", "2 as row", "3 as __m", "4 as n")
    twice = mixing.mix(odd)
    assert twice.columns == ["doc_id", "text", "source", "s", "row", "n", "__m"]
    took = twice.groupBy("source").agg(F.sum(F.col("__m.size") * F.col("__m.copies")).alias("words"), F.max("__m.target").alias("target")).collect()
    assert all(abs(x.words - x.target) <= 1 for x in took)


def test_shards_are_near_equal_and_slots_gapless(spark):
    r = random.Random(8)
    rows = [(i, "é" * r.randint(0, 60), r.choice(["en", "fr", None]), "hot" if i % 3 else f"s{i % 20}", 7) for i in range(3000)] + [(9000, None, None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, shard int")
    done = sharding.shard(df, shards=7).select("doc_id", F.col("__s.shard").alias("to"), "__s.slot", sharding.size_of().alias("size"), "shard").collect()
    assert len(done) == 3001 and {x["shard"] for x in done} == {7}
    sizes = Counter()
    for x in done:
        sizes[x.to] += x.size
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) < 6 * 121
    for k in range(7):
        assert sorted(x.slot for x in done if x.to == k) == list(range(sum(x.to == k for x in done)))
    assert sharding.shard(df.limit(0), shards=4).count() == 0
    assert {x["__s"].shard for x in sharding.shard(df, target_bytes=100_000).collect()} == {0, 1}


@pytest.mark.parametrize("ids", [None, 5])
def test_equal_rows_are_parted(spark, ids):
    rows = [(ids, "the same", None, None)] * 640 + [(ids, f"other {i}", "en", "a") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "1 as __k", "2 as __row", "3 as __s")
    out = sharding.shard(df, shards=4)
    done = out.select(F.col("__s.shard").alias("to"), "__s.slot", sharding.size_of().alias("size")).collect()
    assert out.columns == ["doc_id", "text", "lang", "source", "__k", "__row", "__s"]
    sizes = Counter()
    for x in done:
        sizes[x.to] += x.size
    assert set(sizes) == set(range(4)) and max(sizes.values()) - min(sizes.values()) <= 2 * 10
    for k in range(4):
        assert sorted(x.slot for x in done if x.to == k) == list(range(sum(x.to == k for x in done)))


def test_few_jobs_whatever_the_rows(spark):
    r = random.Random(18)
    rows = [(i, "x" * r.randint(0, 400), r.choice(["en", "fr"]), f"s{r.randint(0, 30)}") for i in range(2000)] + [(5000, "y" * 100_000, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    calls, old = [], sharding._narrow
    sharding._narrow = lambda *a: calls.append(1) or old(*a)
    try:
        sharding.shard(df, shards=16).count()
    finally:
        sharding._narrow = old
    assert len(calls) + 4 + 1 < 40  # passes of bins, ranges of four levels, and the whole


def brute_hits(text, items, window=13):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    w, hit, met = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(window, len(x))
        for k in range(len(x) - n + 1 if x else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[k : k + n]:
                    hit |= set(range(i, i + n))
                    met.add(str(item))
    return len(w), sorted(hit), sorted(met)


def test_decontamination_matches_brute_force_in_one_block_and_in_many(spark):
    r = random.Random(9)
    text = lambda k: " ".join(r.choice(["the", "Of", "and", "naïve", "x1", "y,z", "q"]) for _ in range(k))
    items = [(i, text(r.choice([1, 3, 8, 13, 20, 30]))) for i in range(12)] + [(50, None), (51, " ,;"), (3, text(15))]
    docs = [(i, text(r.randint(0, 50)) + " " + (r.choice(items)[1] or "").upper() + " " + text(5)) for i in range(60)] + [(100, None), (101, ""), (None, "the of")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {i: brute_hits(t, items) for i, t in docs}
    for size in (1000, 30):
        got = {x.doc_id: (x["__c"].n_words, sorted(x["__c"].hit_words), sorted(x["__c"]["items"])) for x in decontaminate.with_hits(d, b, block_windows=size).collect()}
        assert got == want
    odd = d.unionByName(d).selectExpr("*", "1 as __c", "2 as __more", "3 as h")
    twice = decontaminate.with_hits(odd, b.unionByName(b), block_windows=50)
    assert twice.columns == ["doc_id", "text", "__more", "h", "__c"]
    assert sorted((x.doc_id or 0, len(x["__c"].hit_words), len(x["__c"]["items"])) for x in twice.collect()) == sorted(2 * [(i or 0, len(v[1]), len(v[2])) for i, v in want.items()])
    much = text(200_000) + " " + items[8][1]
    long = spark.createDataFrame([(1, much)], "doc_id bigint, text string")
    assert decontaminate.with_hits(long, b).first()["__c"].n_words == brute_hits(much, [])[0]
    assert decontaminate.keep_clean(d.limit(0), b).count() == 0
    assert decontaminate.keep_clean(d, b.limit(0)).count() == len(docs)


def test_base_patterns():
    t = "a.b@c.de, x@y +1 (663) 555-6869 ip 1.2.3.4 999.1.1.1 card 4539 1488 0343 6467, 4539148803436468; u@v@w.org"
    found = [(t[a:b], k) for a, b, k in pii.base_spans(t)]
    assert found == [("a.b@c.de", "email"), ("v@w.org", "email"), ("1.2.3.4", "ip"), ("4539 1488 0343 6467", "card"), ("+1 (663) 555-6869", "phone")]
    # brute force: the contract's expressions as they stand, and their checks
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    ones = lambda m: re.sub(r"[^0-9]", "", m)
    good = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 13 <= len(ones(m)) <= 19 and pii.luhn(ones(m)), "phone": lambda m: 9 <= len(ones(m)) <= 15}
    r = random.Random(2)
    for alphabet, n in (("ab.@@- 1%", 25), ("0123..5", 30), ("12 -+().", 40), ("0000000001 -", 30), ("4539148803436467 -.+", 40)):
        for _ in range(1500):
            s = "".join(r.choice(alphabet) for _ in range(n))
            assert pii.base_spans(s) == [(*m.span(), k) for k, p in patterns.items() for m in re.finditer(p, s) if good[k](m[0])], s


def test_base_patterns_take_time_in_proportion():
    for piece in ("1", "1.", "1 ", "+1", "a@", "a.", "+1)", "1.2.3."):
        began = time.process_time()
        pii.base_spans(piece * (1_000_000 // len(piece)))
        assert time.process_time() - began < 10, piece


def test_tagger_adds_spans_that_no_pattern_knows():
    """Spans of generated running text that the tagger never saw: how many it finds whole, and how many of its own are right."""
    r = random.Random(4242)
    tagger = pii.trained()
    made = [pii.labelled_text(r, 600, 0.05) for _ in range(150)]
    texts = [m[0] for m in made]
    base = [pii.base_spans(t) for t in texts]
    more = pii.added_spans(tagger, texts, base)
    truth = [{s for s in m[2] if all(s[1] <= a or s[0] >= b for a, b, _ in known)} for m, known in zip(made, base)]
    added = sum(map(len, more))
    right = sum(len(set(x) & t) for x, t in zip(more, truth))
    possible = sum(len(t) for t in truth)
    print("added", added, "right", right, "of", possible)
    assert possible > 150 and right / possible > 0.7 and right / added > 0.9
    clean = [" ".join(pii._word(r) for _ in range(200)) for _ in range(100)]
    assert sum(map(len, pii.added_spans(tagger, clean, [[]] * 100))) <= 1
    known = "please write to john dot smith at example dot com or call five five five one two three four today"
    assert {known[a:b] for a, b, _ in pii.added_spans(tagger, [known], [[]])[0]} == {"john dot smith at example dot com", "five five five one two three four"}


def test_base_spans_stay(spark):
    df = spark.createDataFrame([(1, "write to ann.lee@mail.example.com or (663) 555-6869 today " * 5, 7), (2, None, 7), (3, "", 7), (4, "nothing here", 7), (1, "a@b.cd", 7)], "doc_id bigint, text string, __p int")
    rows = pii.find(df).collect()
    out = {x.doc_id: x["__p"] for x in rows[:4]}
    assert out[1].n_email == 5 and set(out[1].base.split(",")) <= set(out[1].spans.split(",")) and len(rows) == 5
    assert all(out[k].spans == "" for k in (2, 3, 4))
    assert pii.masked("call 1.2.3.4!", "ip:5:12") == "call [ip]!"
    assert pii.find(df.limit(0)).count() == 0


def test_every_character_is_tagged_by_the_window_it_lies_deepest_in():
    class Places:
        """Tags each character by how deep it lies in its window; remembers all that it read."""

        def __init__(self):
            self.read = 0

        def decode(self, x):
            n = (x != pii.BEYOND).sum(axis=1)
            self.read += int(n.sum())
            j = np.arange(x.shape[1])
            depth = np.minimum(j[None, :], n[:, None] - 1 - j[None, :])
            return np.where(depth >= 0, np.minimum(depth, 100) + 1, 0).astype(np.int8)

    for n in (1, 5, pii.STRIDE - 1, pii.STRIDE, pii.STRIDE + 1, pii.WINDOW - 1, pii.WINDOW, pii.WINDOW + 1, 1300, 4000):
        tagger = Places()
        (tags,) = pii.tags_of(tagger, ["x" * n])
        assert len(tags) == n and (tags > 0).all() and tagger.read >= n
        margin = (pii.WINDOW - pii.STRIDE) // 2
        inner = tags[margin : n - margin]
        assert (inner > margin).all()  # at least that far from the edges of the window it was taken from


def test_decoding_without_a_search_is_exact():
    tagger = pii.trained()
    windows, _ = pii.labelled_windows(300, seed=5)
    from rostrum.llm.pii_model import encode

    x = encode(windows)
    e = tagger.emissions(x)[0]
    first = tagger.p["first"].copy()
    first[2::2] -= 4.0
    assert (tagger.decode(x) == tagger._viterbi(e, tagger.p["trans"] + tagger.allowed, first)).all()


def test_gradients_of_the_tagger_are_right():
    from rostrum.llm.pii_model import TAGS, Tagger, encode

    t = Tagger(1, np.float64)
    x = encode(["ab +1 2x", "x@y.de a"])
    y = np.random.default_rng(0).integers(0, 2, x.shape)
    loss, g = t.gradients(x, y)
    for name in ("out", "trans", "first", "bias", "inf", "inb", "ref", "reb", "bf", "bb"):
        k = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = t.p[name][k]
        t.p[name][k] = old + 1e-5
        up = t.gradients(x, y)[0]
        t.p[name][k] = old - 1e-5
        down = t.gradients(x, y)[0]
        t.p[name][k] = old
        assert abs((up - down) / 2e-5 - g[name][k]) < 1e-4, name
    assert TAGS == 9


def test_language_id_on_held_out_texts(spark):
    r = random.Random(3)
    say = {"en": "the and of with that from this which".split(), "de": "der und die nicht mit einer auch über".split(), "fr": "le et des avec une pour dans être".split()}
    row = lambda i, lang: (i, " ".join(r.choice(say[lang]) for _ in range(r.randint(3, 60))), lang)
    docs = [row(i, r.choice(list(say))) for i in range(600)]
    df = spark.createDataFrame(docs + [(900, None, "en"), (901, "12 34 €", "en"), (902, "", None)], "doc_id bigint, text string, lang string")
    model = language_id.fit(df)
    out = {x.doc_id: x for x in language_id.identify(df, model).withColumn("held", language_id.held_out()).collect()}
    held = [d for d in docs if out[d[0]].held]
    assert len(held) > 80 and np.mean([out[i]["__g"].lang_pred == lang for i, _, lang in held]) > 0.97
    assert all(out[k]["__g"].lang_pred == "und" and out[k]["__g"].score == 0 for k in (900, 901, 902))
    assert all(0 <= x["__g"].score <= 1 for x in out.values())
    twice = df.unionByName(df).selectExpr("*", "1 as __g", "2 as share")
    again = language_id.fit(twice)
    assert again.languages == model.languages and np.allclose(again.table, model.table)  # repeated rows are learned from once
    assert language_id.identify(twice, model).columns == ["doc_id", "text", "lang", "share", "__g"]
    long = spark.createDataFrame([(1, "und die nicht " * 50_000)], "doc_id bigint, text string")
    assert language_id.identify(long, model).first()["__g"].lang_pred == "de" and language_id.identify(df.limit(0), model).count() == 0
    none = language_id.fit(df.limit(0))
    assert {x["__g"].lang_pred for x in language_id.identify(df, none).collect()} == {"und"}
    texts = ["ab", "Über x", "", "a-b"]
    ids = np.concatenate(list(language_id.subwords(pa.array(["ab"]))[1]))
    assert (ids < language_id.BUCKETS).sum() == 3 + 2 + 1 and len(language_id.pieces_of(texts)) == 4


PAGE = """<html><head><title>t</title><script>var x = "<p>no</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href=/>home</a></li><li><a href=/b>b</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id=content>{}</div><div class="sidebar ad-1">buy</div><form><p>mail</p><input name=q></form><div id="comments"><p>first!</p></div><footer>&copy; us</footer>"""


def whole_of(pages):
    whole = wrapper_of(tree(pages[0]))
    for p in pages[1:]:
        whole = merge_nodes(whole, wrapper_of(tree(p)))
    return unpacked(packed(whole))


def texts_of(pages):
    w = Wrapper(whole_of(pages))
    return [w.text(p) for p in pages]


def test_main_text_with_and_without_article():
    body = "<article><h1>Tea &amp; cake</h1><p><b>One<br>two\n three<p>Four&nbsp;five<ul><li>six</li></ul></article>"
    assert texts_of([PAGE.format(body)]) == ["Tea & cake\n\nOne two three\n\nFour five\n\nsix"]
    plain = [PAGE.format("".join(f"<p>long text number {i} of page {k} " + "word " * 30 + "</p>" for i in range(k + 2))) for k in range(3)]
    assert texts_of(plain)[2].count("\n\n") == 3
    assert texts_of([""]) == [""] and Wrapper(wrapper_of(tree(""))).text(None) == ""


def shape(n):
    return [("".join(x.key for x in g.nodes) + "?" * g.optional + "+" * g.repeated) for g in n.groups]


def test_wrappers_fold_repeats_and_options():
    a, b = wrapper_of(tree("<dl><dt>x<dd>y<dt>x<dd>y<dt>x<dd>y</dl><p>a<p>b")), wrapper_of(tree("<h1>t</h1><p>c"))
    assert shape(a) == ["dl", "p+"] and shape(a.groups[0].nodes[0]) == ["dtdd+"]
    assert sorted(shape(merge_nodes(a, b))) == ["dl?", "h1?", "p+"]


def test_the_expression_of_two_pages_is_a_shortest_one_that_both_match():
    """Against a brute-force aligner: before repeats are folded, options are as few as a longest common subsequence allows, and
    the sequence without its options is a subsequence of both pages."""
    from functools import lru_cache

    r = random.Random(21)
    for _ in range(150):
        x, y = (["h1", "p", "ul", "pre"][r.randrange(4)] for _ in range(r.randint(0, 7))), (["h1", "p", "ul", "pre"][r.randrange(4)] for _ in range(r.randint(0, 7)))
        x, y = tuple(x), tuple(y)

        @lru_cache(None)
        def common(i, j, x=x, y=y):
            if i == len(x) or j == len(y):
                return 0
            return 1 + common(i + 1, j + 1) if x[i] == y[j] else max(common(i + 1, j), common(i, j + 1))

        groups = [[Group([Pair(k, [Node(k)])]) for k in s] for s in (x, y)]
        middle = _align_middle(*groups, _across)
        assert len(middle) == len(x) + len(y) - common(0, 0)
        must = [g.keys[0] for g in middle if not g.optional]
        assert len(must) == common(0, 0)
        for s in (x, y):
            rest = iter(s)
            assert all(k in rest for k in must)
        merged = merge_nodes(wrapper_of(tree("".join(f"<{k}>t</{k}>" for k in x))), wrapper_of(tree("".join(f"<{k}>t</{k}>" for k in y))))
        pattern = re.compile("".join("(?:" + "".join(f"(?:{k},){'?' * g.loose}" for k in g.keys) + ")" + {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[(int(g.optional), int(g.repeated))] for g in merged.groups))
        for s in (x, y):
            assert pattern.fullmatch("".join(f"{k}," for k in s)), (x, y, shape(merged))


def test_slots_decide_what_is_text_and_constants_are_the_templates():
    say = lambda k, n=40: " ".join(f"word{k}x{i}" for i in range(n))
    pages = [f"<body><div><div><b>{say(k)}</b></div><div>All rights of the house are reserved</div><p>{say(k + 50)}</p></div></body>" for k in range(4)]
    assert texts_of(pages) == [f"{say(k)}\n\n{say(k + 50)}" for k in range(4)]
    w = whole_of(pages)
    erased = [w]
    for n in erased:  # no slot, no option, no repeat
        erased += [c for g in n.groups for c in g.nodes]
        n.pages, n.same, n.mass = 0, frozenset(), 0
    assert Wrapper(w).text(pages[0]) != texts_of(pages)[0]
    legal = [f"<article><h1>{say(k, 5)}</h1><p>{say(k)}</p><p>The same legal line on every page.</p><p>{say(k + 9)}</p></article>" for k in range(3)]
    assert all("legal" not in t and t.count("\n\n") == 2 for t in texts_of(legal))
    copies = [f"<nav>{k}</nav><article><h1>Same</h1><p>{say(1)}</p></article>" for k in range(5)]
    assert texts_of(copies) == [f"Same\n\n{say(1)}"] * 5
    two = legal[:2]
    assert all("legal" in t for t in texts_of(two))


def test_parts_of_the_article_with_long_names_stay_and_markup_never_comes_out():
    page = '<article><p>first</p><div class="related-work"><p>second</p></div><p class="notice-of-x">third</p><section id="search-results">fourth</section><div class="ad">buy</div><section class="comments"><p>me too</p></section></article>'
    assert texts_of([page]) == ["first\n\nsecond\n\nthird\n\nfourth"]
    assert texts_of(["<article><p>a<img src=" + "x" * 5000 + "> b</p><p title=it's>c</p></article>"]) == ["a b\n\nc"]
    deep = "<div>" * 10_000 + "<p>at the bottom</p>"
    assert texts_of([deep, deep + "</div>" * 10_000]) == ["at the bottom"] * 2
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    assert texts_of([long])[0].count("word word") == 50_000


def test_extract_on_hosts_with_null_and_empty_pages(spark):
    rows = [(i, f"http://h{i % 2}.example.org/{i}", PAGE.format(f"<article><p>text {i}</p></article>"), "x") for i in range(8)]
    df = spark.createDataFrame([*rows, (90, None, None, "x"), (91, "odd", "", "x")], "page_id bigint, url string, html string, host string")
    out = {x.page_id: x["__text"] for x in extract(df).collect()}
    assert out == {**{i: f"text {i}" for i in range(8)}, 90: "", 91: ""}
    twice = extract(df.withColumnRenamed("host", "wrapper").unionByName(df.withColumnRenamed("host", "wrapper")))
    assert sorted((x.page_id, x["__text"]) for x in twice.collect()) == sorted(2 * list(out.items())) and twice.columns == ["page_id", "url", "html", "wrapper", "__text"]
    assert extract(df.limit(0)).count() == 0


def test_a_hot_host_is_spread_when_wrappers_are_too_large_to_send(spark, monkeypatch):
    from rostrum.llm import html_wrappers

    rows = [(i, f"http://h{i % 3 * (i % 2)}.example.org/{i}", PAGE.format(f"<article><p>text {i}</p></article>")) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(7)
    monkeypatch.setattr(html_wrappers, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(html_wrappers, "FOLD", 2)
    monkeypatch.setattr("rostrum.llm.shared.HEAVY", 8)
    assert {x.page_id: x["__text"] for x in extract(df).collect()} == {i: f"text {i}" for i in range(60)}


def test_pages_of_a_host_with_two_templates_keep_their_text():
    prose = lambda k: " ".join(f"word{k}x{i}" for i in range(60))

    cards = "".join(f"<article><p>card {i}</p></article>" for i in range(3))
    listing, post = PAGE.format(cards), PAGE.format(f"<div class=post><p>{prose(1)}</p></div>")
    related = PAGE.format(f"<div class=post><p>{prose(2)}</p></div><div class=more>{cards}</div>")
    got = texts_of([listing, post, related])
    assert got[:2] == ["card 0\n\ncard 1\n\ncard 2", prose(1)] and got[2].startswith(prose(2))
    blog = [f"<body><div class=blog><p>{prose(k)}</p></div></body>" for k in range(7)]
    docs = [f"<body><section class=docs><p>{prose(k)}</p></section></body>" for k in range(7, 10)]
    assert texts_of(blog + docs) == [prose(k) for k in range(10)]
