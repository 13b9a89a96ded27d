"""MinHash near-dedup with odd sketches.

Every document's set of word shingles is folded into MinHash samples; the
samples give band keys (four samples each) and an odd sketch: a bitmap in which
each sample flips one bit. The population count of the XOR of two sketches
estimates a high similarity precisely, so it weeds out most candidates of the
bands, in native expressions; what is left is confirmed on the full sets.

Documents with equal sets are one class, linked through its least doc_id. Each
bucket of a band has a few leaders; a member is first compared with the leaders
of its buckets that its sketch is nearest to, and leaders with each other.
Buckets whose members are then not in one component compare the members outside
the bucket's largest component with all the others, each pair in the first band
it shares; in crowded buckets they meet block by block inside tasks, where the
overlaps of full sets come from matrix products and only links leave. Either way a
pair is a link by one rule: size, sketch, and then the similarity of the full sets.
A group of near copies so costs about two pairs per member, not all pairs, and no
pair with a chance to connect two components is left out. What stays costly is a
very large family of texts that are all a little less similar than the threshold:
its members share bands but no links, so they do meet each other, in blocks.

A bucket, a leader, a class of equal sets or a component may hold a third of all
rows: joins by those keys deal its rows to salts (see :func:`shared.join_spread`).

A pair at the threshold shares no band with a chance of about 5e-8, and is
weeded out by its sketch with one of about 1e-7.

Defined results: null and wordless texts have an empty set, link with nothing
and stay; shorter texts are one shingle; ties go to the least doc_id; rows that
repeat a doc_id are one document, whose text is the one with the least hash where
they differ; rows without doc_id link with nothing and stay; very long texts are
read whole; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.components import components
from rostrum.llm.shared import fresh, join_spread, kept
from rostrum.llm.words import SPACED_LOWER, gram_hashes, gram_starts, mix, seeds, slices, words_of

SHINGLE, PERCENT = 5, 80
SAMPLES, PER_BAND = 128, 4
SKETCH_LONGS = 8
#: Similarity below which a sketch's estimate turns a candidate away. At 0.8 the estimate's deviation is about 0.05.
SURE = 0.55

#: Leaders of a bucket, and how many of the nearest of them a member is compared with at first.
LEADERS, CHOICES = 4, 2
#: Pairs of a bucket above which they are met in blocks, and rows of a block.
CROWD, BLOCK = 400, 1024

_A = (seeds(SAMPLES, 1) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (seeds(SAMPLES, 2) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text in ascending order; the first of each text (one more at the end)."""
    w = words_of(texts, SPACED_LOWER)
    count = w.counts()
    good = gram_starts(w.first, n)
    grams = [gram_hashes(w.hash, n)[good]]
    owner = [np.repeat(np.arange(len(count)), np.maximum(count - n + 1, 0))]
    for k in range(1, n):  # texts with fewer words are one shingle
        short = np.flatnonzero(count == k)
        if len(short):
            grams.append(gram_hashes(w.hash, k, salt=1)[w.first[short]])
            owner.append(short)
    g, o = np.concatenate(grams), np.concatenate(owner)
    order = np.lexsort((g, o))
    g, o = g[order], o[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    g, o = g[new], o[new]
    return g, np.searchsorted(o, np.arange(len(count) + 1))


def minhashes(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts with a set, SAMPLES): least value of each hash function over the set."""
    x = (g >> np.uint64(32)).astype(np.uint32)
    starts = first[:-1][np.diff(first) > 0]
    out = np.zeros((len(starts), SAMPLES), np.uint32)
    for j in range(SAMPLES):
        y = x * _A[j] + _B[j]
        y ^= y >> np.uint32(15)
        out[:, j] = np.minimum.reduceat(y * np.uint32(0x2C1B3C6D), starts)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    bands = m.reshape(len(m), SAMPLES // PER_BAND, PER_BAND).astype(np.uint64)
    h = np.broadcast_to(seeds(SAMPLES // PER_BAND, 3), bands.shape[:2]).copy()
    for k in range(PER_BAND):
        h = mix(h + bands[:, :, k] * np.uint64(0x9E3779B97F4A7C15))
    return h


def odd_sketches(m: np.ndarray) -> np.ndarray:
    """(texts, SKETCH_LONGS): each sample flips the bit that it hashes to."""
    size = 64 * SKETCH_LONGS
    place = (mix(m.astype(np.uint64) + seeds(SAMPLES, 4)) % np.uint64(size)).astype(np.int64)
    bits = np.zeros((len(m), size), np.uint8)
    np.add.at(bits, (np.arange(len(m))[:, None], place), 1)
    return np.packbits(bits & 1, axis=1).view(">u8").astype(np.uint64)


def most_bits(similarity: float) -> int:
    """Bits in which the sketches of two sets of that similarity differ, as expected."""
    n = 64 * SKETCH_LONGS
    return int(n / 2 * (1 - np.exp(-2 * (2 * SAMPLES * (1 - similarity)) / n)))


_SKETCH = ["doc_id", "t", "n", "f1", "f2", "bands", *[f"s{k}" for k in range(SKETCH_LONGS)]]
_SKETCH_TYPES = "doc_id bigint, t bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>, " + ", ".join(f"s{k} bigint" for k in range(SKETCH_LONGS))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """One row per document: hash of its text, size and fingerprint of its set, band keys, odd sketch."""

    def rows(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                g, first = shingle_sets(part.column("text"), shingle)
                n = np.diff(first)
                some = n > 0
                f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                bands = pa.array([[]] * len(n), pa.list_(pa.int64()))
                sketch = np.zeros((len(n), SKETCH_LONGS), np.uint64)
                if some.any():
                    starts = first[:-1][some]
                    f1[some], f2[some] = np.add.reduceat(mix(g), starts), np.add.reduceat(mix(g ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    m = minhashes(g, first)
                    keys = band_keys(m)
                    sketch[some] = odd_sketches(m)
                    offsets = np.concatenate([[0], np.cumsum(some * keys.shape[1])]).astype(np.int32)
                    bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
                yield pa.record_batch([part.column("doc_id"), part.column("t"), pa.array(n.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), bands, *[pa.array(sketch[:, k].copy().view(np.int64)) for k in range(SKETCH_LONGS)]], _SKETCH)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text").mapInArrow(rows, _SKETCH_TYPES)


def full_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, grams): the sorted shingle hashes as bytes."""

    def rows(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                g, first = shingle_sets(part.column("text"), shingle)
                ends = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                sets = [g[a:b].tobytes() for a, b in ends]
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array(sets, pa.binary())], ["doc_id", "n", "grams"])

    return texts.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, n bigint, grams binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. pairs: a kept table; rows: how many documents there are."""

    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y"))
    right = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x"))
    one = join_spread(pairs, left, "b", rows, F.xxhash64("a"), "inner")
    counts = pairs.groupBy("a").agg(F.count("*").alias("__n"))
    return join_spread(one, right, "a", rows, F.xxhash64("b"), "inner", counts).select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def _bits(x: str, y: str) -> Column:
    """Bits in which two sketches differ, whose columns are named with the prefixes x and y."""
    return sum((F.bit_count(F.col(f"{x}s{k}").bitwiseXOR(F.col(f"{y}s{k}"))) for k in range(SKETCH_LONGS)), F.lit(0))


def _likely(x: str, y: str, percent: int) -> Column:
    """By size and sketch, the two can reach the similarity."""
    a, b = F.col(f"{x}n"), F.col(f"{y}n")
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (_bits(x, y) <= most_bits(SURE))


def _star_pairs(slim: DataFrame, leaders: DataFrame, sketch: DataFrame, percent: int, rows: int) -> DataFrame:
    """(a, b): each member with the leaders of its buckets that its sketch is nearest to, and leaders of a bucket with each other."""
    led = kept(slim.select("doc_id", F.explode(F.array_distinct("leaders")).alias("leader")).filter("doc_id <> leader").distinct())
    of = lambda name, key: sketch.select(F.col("doc_id").alias(key), *[F.col(c).alias(f"{name}{c}") for c in ("n", *(f"s{k}" for k in range(SKETCH_LONGS)))])
    near = join_spread(led, of("t_", "leader"), "leader", rows, F.xxhash64("doc_id"), "inner").join(of("o_", "doc_id"), "doc_id").filter(_likely("o_", "t_", percent))
    by_bits = F.struct(_bits("o_", "t_").alias("bits"), "leader")
    # a member has at most LEADERS leaders in each of its bands: a short list
    best = near.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(by_bits)), 1, CHOICES).alias("best"))
    chosen = best.select("doc_id", F.explode("best").alias("x")).select("doc_id", "x.leader")
    one, two = F.explode("leaders").alias("doc_id"), F.explode("leaders").alias("leader")
    tops = leaders.select("leaders", one).select("doc_id", two).filter("doc_id <> leader").distinct()
    both = chosen.unionByName(tops)
    return both.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """(len(xs), len(ys)): sizes of all intersections, as products of 0/1 matrices over the values that both sides hold."""
    sizes = [len(s) for s in (*xs, *ys)]
    values = np.concatenate([*xs, *ys]) if sizes else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left, right = np.unique(values[owner < len(xs)]), np.unique(values[owner >= len(xs)])
    known = np.intersect1d(left, right, assume_unique=True)
    place = np.searchsorted(known, values)
    inside = place < len(known)
    inside[inside] = known[place[inside]] == values[inside]
    owner, place = owner[inside], place[inside]
    out = np.zeros((len(xs), len(ys)), np.float32)
    for k in range(0, len(known), 4096):
        part = (place >= k) & (place < k + 4096)
        m = np.zeros((len(sizes), min(4096, len(known) - k)), np.float32)
        m[owner[part], place[part] - k] = 1
        out += m[: len(xs)] @ m[len(xs) :].T
    return out


def _block_pairs(x: pd.DataFrame, y: pd.DataFrame, key: int, percent: int) -> pd.DataFrame:
    """Pairs of two blocks of a bucket that are links: by component, size, sketch and first band, then by their full sets."""
    nx, ny = x["n"].to_numpy()[:, None], y["n"].to_numpy()[None, :]
    dx, dy = x["doc_id"].to_numpy()[:, None], y["doc_id"].to_numpy()[None, :]
    cy, my = y["component"].to_numpy()[None, :], y["main"].to_numpy()[None, :]
    ok = (x["component"].to_numpy()[:, None] != cy) & ((cy == my) | (dx > dy)) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
    bits = np.zeros(ok.shape, np.int64)
    for k in range(SKETCH_LONGS):
        bits += np.bitwise_count(x[f"s{k}"].to_numpy().view(np.uint64)[:, None] ^ y[f"s{k}"].to_numpy().view(np.uint64)[None, :])
    ok &= bits <= most_bits(SURE)
    bx, by = np.stack(x["bands"].to_numpy()), np.stack(y["bands"].to_numpy())
    band = np.argmax(bx == key, axis=1)[:, None]
    for k in range(bx.shape[1]):  # no earlier band in common
        ok &= ~((k < band) & (bx[:, k][:, None] == by[:, k][None, :]))
    if ok.any():
        full = lambda df: [np.frombuffer(b, np.uint64) for b in df["grams"]]
        both = overlaps(full(x), full(y)).astype(np.int64)
        ok &= 100 * both >= percent * (nx + ny - both)
    i, j = np.nonzero(ok)
    a, b = x["doc_id"].to_numpy()[i], y["doc_id"].to_numpy()[j]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _crowded_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of buckets with very many pairs: outsiders and members meet in blocks of about BLOCK rows each, a pair of blocks
    at a time, and only links leave the task."""
    cut = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    r = rows.join(sets.select("doc_id", "grams"), "doc_id").withColumn("nx", cut("outsiders")).withColumn("ny", cut("members"))
    spread = lambda own, other, n: F.explode(F.transform(F.sequence(F.lit(0), F.col(other) - 1), lambda i: F.struct(*((F.pmod(F.xxhash64("doc_id"), F.col(own)).cast("int").alias("p"), i.alias("q")) if n == "x" else (i.alias("p"), F.pmod(F.xxhash64("doc_id"), F.col(own)).cast("int").alias("q"))))))
    x = r.filter("component <> main").withColumn("cell", spread("nx", "ny", "x")).withColumn("side", F.lit(0))
    y = r.withColumn("cell", spread("ny", "nx", "y")).withColumn("side", F.lit(1))
    columns = ["key", "cell.p", "cell.q", "side", "doc_id", "component", "main", "n", "bands", "grams", *[f"s{k}" for k in range(SKETCH_LONGS)]]
    dealt = x.select(columns).unionByName(y.select(columns)).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "side")

    def meet(batches):
        rest = None
        for df in batches:
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            if not len(df):
                continue
            cell = df[["key", "p", "q"]]
            starts = np.flatnonzero((cell != cell.shift()).any(axis=1).to_numpy())
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield pairs(df.iloc[s:e])
            rest = df.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None:
            yield pairs(rest)

    def pairs(df: pd.DataFrame) -> pd.DataFrame:
        return _block_pairs(df[df["side"] == 0], df[df["side"] == 1], int(df["key"].iloc[0]), percent)

    return dealt.mapInPandas(meet, "a bigint, b bigint")


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, component): one row per row of docs."""
    rows = kept(sketches(docs, shingle))
    total = rows.count()
    # one row per document: of rows that share an id, the one whose text has the least hash
    columns = [c for c in rows.columns if c != "doc_id"]
    named = rows.filter("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min_by(F.struct(*columns), "t").alias("x")).select("doc_id", "x.*")
    named = named.withColumn("set", F.struct("f1", "f2", "n"))
    classes = named.groupBy("set").agg(F.min("doc_id").alias("rep"))
    reps = kept(named.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").drop("set"))
    member = reps.select("doc_id", F.explode("bands").alias("key"))
    # leaders of a bucket: its least documents by several hashes, so that buckets that share members share leaders
    least = lambda i: F.min(F.struct(F.xxhash64("doc_id", F.lit(i)).alias("h"), "doc_id"))["doc_id"]
    buckets = member.groupBy("key").agg(F.array(*[least(i) for i in range(LEADERS)]).alias("leaders"), F.count("*").alias("__n")).filter("__n > 1")
    slim = kept(join_spread(member, buckets.select("key", "leaders"), "key", total, F.xxhash64("doc_id"), "inner", buckets.select("key", "__n")))  # rows of buckets with company only
    leaders = slim.groupBy("key").agg(F.first("leaders").alias("leaders"))
    sketch = reps.drop("bands", "f1", "f2", "t")
    wanted = slim.select("doc_id").distinct().join(reps.select("doc_id", "t"), "doc_id")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text").join(wanted, ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id"])
    sets = kept(full_sets(texts, shingle))
    links = confirmed(kept(_star_pairs(slim, leaders, sketch, percent, total)), sets, percent, total)
    one = components(links)
    # what the leaders left apart: buckets with several components
    at = slim.alias("m").join(one.alias("c"), F.col("m.doc_id") == F.col("c.node"), "left").select("key", "doc_id", F.coalesce("c.component", "doc_id").alias("component"))
    sizes = at.groupBy("key", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("kinds"), F.sum("size").alias("members"), F.max("size").alias("largest")).filter("kinds > 1")
    main = kept(main.select("key", "main", "members", (F.col("members") - F.col("largest")).alias("outsiders")))
    mixed = join_spread(at, main, "key", total, F.xxhash64("doc_id"), "inner", main.select("key", F.col("members").alias("__n")))
    split = kept(mixed.join(reps.drop("f1", "f2", "t"), "doc_id"))
    crowded = F.col("outsiders") * F.col("members") > CROWD
    few = split.filter(~crowded)
    x, y = few.filter("component <> main").alias("x"), few.alias("y")
    # a pair inside the outsiders is met from both sides, and a pair shares several bands; one meeting, in the first band, is enough
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.doc_id") > F.col("y.doc_id"))
    first = F.get(F.filter(F.zip_with("x.bands", "y.bands", lambda p, q: F.when(p == q, p)), lambda k: k.isNotNull()), F.lit(0)) == F.col("x.key")
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & once & _likely("x.", "y.", percent) & first)
    pairs = kept(across.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct())
    later = confirmed(pairs, sets, percent, total).unionByName(_crowded_pairs(split.filter(crowded), sets, percent).distinct())
    name = lambda side: one.select(F.col("node").alias(side), F.col("component").alias(f"{side}c"))
    found = kept(later)
    named_a = join_spread(found, name("a"), "a", total, F.xxhash64("b"))
    between = join_spread(named_a, name("b"), "b", total, F.xxhash64("a"), counts=found.groupBy("b").agg(F.count("*").alias("__n"))).select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
    two = components(between.filter("a <> b"))
    of_rep = classes.join(one.select(F.col("node").alias("rep"), F.col("component").alias("oc")), "rep", "left").select("set", F.coalesce("oc", "rep").alias("c1"))
    of_set = join_spread(of_rep, two.select(F.col("node").alias("c1"), F.col("component").alias("tc")), "c1", total, F.xxhash64("set")).select("set", F.coalesce("tc", "c1").alias("component"))
    own = rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.struct("f1", "f2", "n")).alias("set"))
    joined = join_spread(own, of_set, "set", total, F.xxhash64("doc_id"))
    return joined.select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents whose group has one with a smaller doc_id, with the columns of docs; of rows that repeat a doc_id, one of each text."""
    gone, h = fresh(docs, "__gone"), fresh(docs, "__h")
    left = docs.join(groups(docs, **options).filter("doc_id <> component").select(F.col("doc_id").alias(gone)).distinct(), F.col("doc_id") == F.col(gone), "left_anti")
    named = left.filter("doc_id is not null").withColumn(h, F.xxhash64("text")).dropDuplicates(["doc_id", h]).drop(h)
    return named.unionByName(docs.filter("doc_id is null"))


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = groups(docs, shingle=4, percent=80)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
