"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into item-sized windows (``window`` consecutive
words, or the whole item if it has fewer), in the tasks that read the items;
equal windows are one row. For containment of a whole window one necessary
shingle is enough as its prefix: the shingles of a window are ordered by how often
the corpus holds them, and the rarest is joined with its offset. A document meets
a window only where it holds that shingle; offset and length bounds then fix the
one possible place, and the words there are compared one by one with the window's.

The corpus is counted once, whatever the benchmark's size: a bitmap of fixed size
turns away the shingles that no window has, what passes is summed by hash and
joined with the windows' shingles. Windows with their prefixes are sent to the
tasks in blocks of at most ``block_windows``, so what is broadcast has a fixed
bound; each further block takes one more pass over documents kept with what the
blocks before found. Documents are never shuffled.

Defined results: a null or wordless text has no words and is never hit; items
that are null or wordless have no window; repeated items count once by id, and
repeated rows get equal results; very long texts are scanned whole; an empty table
on either side gives no hits; other columns are left alone, but for one named
``__c``, which the result replaces.
Words are compared by 64-bit hashes, position by position over the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.llm.shared import fresh, kept
from rostrum.llm.words import ALNUM_LOWER, gram_hashes, gram_starts, words_of

WINDOW, SHINGLE = 13, 5
#: Windows that are sent to the tasks at once: some 150 bytes each.
BLOCK_WINDOWS = 200_000
#: Bits of the table that turns away shingles of no window, as a power of two.
TABLE_BITS = 25
CHUNK = 2 << 20

HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])


@dataclass
class Windows:
    """Distinct windows of a block."""

    words: np.ndarray  # (windows, window): word hashes, 0 beyond the length
    length: np.ndarray
    item_first: np.ndarray  # items of window k: items[item_first[k]:item_first[k + 1]]
    items: np.ndarray


def window_rows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(w1, w2, words, shingles, items): every distinct window by two hashes, its words' hashes in order, the hashes of its shingles
    (of ``shingle`` words, or of all words of a shorter window), and the ids of its items."""

    def rows(batches):
        for batch in batches:
            w = words_of(batch.column("text"), ALNUM_LOWER)
            count = w.counts()
            for n in range(1, window + 1):
                starts = np.flatnonzero(gram_starts(w.first, window)) if n == window else w.first[:-1][count == n]
                if not len(starts):
                    continue
                q = min(shingle, n)
                words = w.hash[starts[:, None] + np.arange(n)]
                grams = gram_hashes(w.hash, q)[starts[:, None] + np.arange(n - q + 1)]
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel().view(np.int64)))
                owner = np.searchsorted(w.first, starts, "right") - 1
                yield pa.record_batch(
                    [pa.array(gram_hashes(w.hash, n)[starts].view(np.int64)), pa.array(gram_hashes(w.hash, n, salt=1)[starts].view(np.int64)), lists(words), lists(grams), batch.column("item").take(pa.array(owner))],
                    ["w1", "w2", "words", "shingles", "item"],
                )

    cut = items.mapInArrow(rows, "w1 bigint, w2 bigint, words array<bigint>, shingles array<bigint>, item string")
    return cut.groupBy("w1", "w2").agg(F.first("words").alias("words"), F.first("shingles").alias("shingles"), F.collect_set("item").alias("items"))


class Lookup:
    """Sorted hashes behind a bit table that turns most absent ones away at once."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        bits = min(26, max(10, int(len(self.sorted) * 16).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.sorted >> self.shift] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of known hashes, and their ranks."""
        at = np.flatnonzero(self.table[h >> self.shift])
        rank = np.searchsorted(self.sorted, h[at])
        rank[rank == len(self.sorted)] = 0
        known = self.sorted[rank] == h[at] if len(self.sorted) else np.zeros(len(at), bool)
        return at[known], rank[known]


def _chunks(texts: pa.Array) -> Iterator[pa.Array]:
    sizes = np.array([0 if not t.is_valid else t.as_buffer().size for t in texts], np.int64)
    group = np.cumsum(sizes) // CHUNK
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b > a:
            yield texts.slice(a, b - a)


def corpus_counts(docs: DataFrame, windows: DataFrame, shingle: int) -> DataFrame:
    """(h, n): how often all documents hold each shingle of the windows (and some others, by chance of the bitmap). Counted in the
    tasks, batch by batch, and summed by hash. The driver sees the bitmap's words, at most 2 ** TABLE_BITS / 64 rows."""
    bit = F.shiftrightunsigned("h", 64 - TABLE_BITS)
    grams = windows.select(F.explode("shingles").alias("h")).select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - TABLE_BITS}) & 63 AS int))").alias("bit"))
    bitmap = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    for r in grams.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        bitmap[r.word] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)
    lengths = sorted(r[0] for r in windows.select(F.least(F.lit(shingle), F.size("words"))).distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches):
        known = np.unpackbits(shared.value.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            found = []
            for part in _chunks(batch.column(0)):
                w = words_of(part, ALNUM_LOWER)
                for q in lengths:
                    h = gram_hashes(w.hash, q)
                    found.append(h[known[h >> np.uint64(64 - TABLE_BITS)] & gram_starts(w.first, q)])
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            if len(h):
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return docs.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def with_prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """windows with ``at``: the offset of the shingle that the corpus holds least often."""
    grams = windows.select("w1", "w2", F.posexplode("shingles").alias("at", "h"))
    least = grams.join(counts, "h", "left").groupBy("w1", "w2").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at"))["at"].alias("at"))
    return windows.join(least, ["w1", "w2"])


@dataclass
class PrefixIndex:
    """The rarest shingle of every window, by shingle length."""

    windows: Windows
    lookups: dict[int, Lookup]
    postings: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by rank: first posting; window; offset of the shingle in it

    @staticmethod
    def build(rows: pa.Table, window: int, shingle: int) -> PrefixIndex:
        """rows: words, shingles, items and at of a block of windows."""
        rows = rows.combine_chunks()
        flat = lambda c: (np.concatenate([[0], np.cumsum(pc.list_value_length(rows.column(c)).to_numpy(zero_copy_only=False))]).astype(np.int64), pc.list_flatten(rows.column(c)))
        first, words = flat("words")
        length = np.diff(first)
        matrix = np.zeros((len(rows), window), np.uint64)
        owner = np.repeat(np.arange(len(rows)), length)
        matrix[owner, np.arange(len(owner)) - np.repeat(first[:-1], length)] = words.to_numpy(zero_copy_only=False).view(np.uint64)
        item_first, items = flat("items")
        w = Windows(matrix, length, item_first, np.array(items.to_pylist(), dtype=object))
        gram_first, grams = flat("shingles")
        offset = rows.column("at").to_numpy().astype(np.int64)
        h = grams.to_numpy(zero_copy_only=False).view(np.uint64)[gram_first[:-1] + offset]
        lookups, postings = {}, {}
        for q in np.unique(np.minimum(length, shingle)).tolist():
            mine = np.flatnonzero(np.minimum(length, shingle) == q)
            lookups[q] = Lookup(h[mine])
            rank = np.searchsorted(lookups[q].sorted, h[mine])
            order = np.argsort(rank, kind="stable")
            postings[q] = (np.searchsorted(rank[order], np.arange(len(lookups[q].sorted) + 1)), mine[order], offset[mine][order])
        return PrefixIndex(w, lookups, postings)

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words per text; (text, word) of every hit word; the first word of each text; (text, window) met."""
        w, win = words_of(texts, ALNUM_LOWER), self.windows
        total = int(w.first[-1])
        last = np.repeat(w.first[1:], w.counts())
        starts, which = [], []
        for q, x in self.lookups.items():
            at, rank = x.find(gram_hashes(w.hash, q))
            first, window, offset = self.postings[q]
            n = first[rank + 1] - first[rank]
            k = np.repeat(first[rank], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at, start, window = np.repeat(at, n), np.repeat(at, n) - offset[k], window[k]
            fits = start >= 0
            at, start, window = at[fits], start[fits], window[fits]
            fits = (start + win.length[window] <= last[start]) & (at < last[start])
            start, window = start[fits], window[fits]
            for j in range(win.words.shape[1]):  # word by word over the window
                if not len(start):
                    break
                same = (j >= win.length[window]) | (w.hash[np.minimum(start + j, total - 1)] == win.words[window, j])
                start, window = start[same], window[same]
            starts.append(start)
            which.append(window)
        start, window = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, which))
        edge = np.bincount(start, minlength=total + 1)[: total + 1] - np.bincount(start + win.length[window], minlength=total + 1)[: total + 1]
        hit = np.flatnonzero(np.cumsum(edge)[:total] > 0)
        text = np.searchsorted(w.first, start, "right") - 1
        met = np.unique(np.stack([text, window], axis=1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
        return w.first, hit, text, met

    def rows(self, texts: pa.Array) -> list[dict]:
        first, hit, _, met = self.scan(texts)
        n = np.diff(first)
        out = [{"n_words": int(k), "hit_words": [], "items": []} for k in n]
        owner = np.searchsorted(first, hit, "right") - 1
        for i in np.unique(owner):
            out[i]["hit_words"] = (hit[owner == i] - first[i]).tolist()
        win = self.windows
        for i in np.unique(met[:, 0]):
            out[i]["items"] = sorted({x for k in met[met[:, 0] == i, 1] for x in win.items[win.item_first[k] : win.item_first[k + 1]]})
        return out


def _scanner(spark: SparkSession, index: PrefixIndex):
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf(HITS)
    def scan(texts: pa.Array) -> pa.Array:
        rows = [r for part in _chunks(texts) for r in shared.value.rows(part)]
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("hit_words", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]))

    return scan


def with_hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with a column ``__c``: n_words, the positions of hit words, and the ids (as strings) of items met."""
    spark, docs = docs.sparkSession, docs.drop("__c")
    items = bench.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    windows = kept(window_rows(items, window, shingle))
    blocks = max(1, -(-windows.count() // block_windows))
    ready = kept(with_prefixes(windows, corpus_counts(docs, windows, shingle)).withColumn("block", F.pmod("w1", F.lit(blocks))))
    for b in range(blocks):
        index = PrefixIndex.build(ready.filter(F.col("block") == b).select("words", "shingles", "items", "at").toArrow(), window, shingle)
        found = _scanner(spark, index)("text")
        if b == 0:
            docs = docs.withColumn("__c", found)
            continue
        more = fresh(docs, "__more")
        docs = kept(docs).withColumn(more, found)
        both = lambda c: F.array_union(F.col(f"__c.{c}"), F.col(f"{more}.{c}")).alias(c)
        docs = docs.withColumn("__c", F.struct(F.col("__c.n_words").alias("n_words"), both("hit_words"), both("items"))).drop(more)
    return docs


def contaminated(c: str = "__c", share: int = 20) -> Column:
    hit = F.size(f"{c}.hit_words")
    return (hit > 0) & (share * hit >= F.col(f"{c}.n_words"))


def keep_clean(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs."""
    return with_hits(docs, bench, **options).filter(~contaminated()).select(*[F.col(f"`{c}`") for c in docs.columns if c != "__c"])


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        F.col("__c.n_words").alias("n_words"),
        F.size("__c.hit_words").cast("long").alias("n_hit"),
        F.size("__c.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__c.items"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
