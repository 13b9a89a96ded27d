"""Substring dedup by relative Lempel-Ziv parsing against all of the corpus.

Every text is cut into reference blocks: runs of ``length``-word windows that
share their anchor, the least hashed :data:`GRAM`-word shingle in the window.
Equal windows have equal anchors wherever they stand, so blocks that share text
share anchors, and the index of all blocks is one row per block.

The index is range-partitioned by (anchor, block, document), sorted, and streamed
once with the state of one block. A block that repeats an earlier one matches it
as a whole, and takes it as its source. Blocks that are first of their kind under
an anchor that others share as well can still match in part: at these factor
boundaries the windows themselves are matched, by the same index and stream.

Each document is then factored greedily from left to right. Matches that lie on
one diagonal (same source document, same distance) and touch are one candidate;
at the first window that no factor holds yet, the candidate that reaches farthest
becomes the next factor: (place, words, source document, place in the source).
Every factor is at least ``length`` words long, equals its source word by word,
and starts later than it; what factors cover becomes the duplicate spans. Spans
are judged on the input and are exact: a word goes if and only if a window over
it also starts earlier (96 bits of hash for blocks, 128 for windows).

An anchor that a third of all documents hold is spread over many partitions by
the range; only a partition's first and last anchor can continue elsewhere,
and at most four rows per partition are broadcast to settle those. Texts are
shuffled once, by document; what is shuffled besides is about one row per six words.

Defined results: null, empty and short texts have no window and stay whole;
rows without doc_id stay whole; doc_id names a document: rows that repeat it with
the same text are one and do not make each other duplicates, and unlike texts
under one doc_id are parts of one document, in the order of their hashes, over
whose edges no window goes (places in it count from the first part on);
very long texts are read whole; an empty table gives an empty result; other
columns are left alone, but for one named ``__d``, which the result replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rostrum.llm.shared import HEAVY, fresh, kept, partitions, released
from rostrum.llm.words import BYTE_RADIX, SPACED, Words, gram_hashes, gram_starts, mix, powers, slices, window_min, words_of

LENGTH, GRAM = 20, 6
#: Rows of the index in a partition, about.
ROWS_EACH = 2_000_000
_LOW = np.uint64(0xFFFF)


def blocks(w: Words, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text, anchor, block hash, first window and windows of every block."""
    starts = np.flatnonzero(gram_starts(w.first, length))
    if not len(starts):
        return (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    window, g = gram_hashes(w.hash, length), gram_hashes(w.hash, gram)
    # ties go to the left: the low bits are the position
    least = window_min((g & ~_LOW) | (np.arange(len(g), dtype=np.uint64) & _LOW), length - gram + 1)[starts]
    text = np.searchsorted(w.first, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    within = np.arange(len(starts)) - np.repeat(first, n)
    whole = mix(np.add.reduceat(window[starts] * powers(BYTE_RADIX, int(n.max()))[within], first) + n.astype(np.uint64))
    return text[first], (least[first] >> np.uint64(32)).astype(np.uint32).view(np.int32), whole.view(np.int64), (starts[first] - w.first[text[first]]).astype(np.int32), n.astype(np.int32)


_BLOCKS = ["anchor", "block", "doc_id", "at", "n"]
_BLOCK_TYPES = "anchor int, block bigint, doc_id bigint, at int, n int"


def block_rows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    def rows(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                text, anchor, block, at, n = blocks(words_of(part.column("text"), SPACED), length)
                if len(text):
                    at = at + part.column("base").fill_null(0).to_numpy()[text]
                    yield pa.record_batch([pa.array(anchor), pa.array(block), pa.array(part.column("doc_id").to_numpy()[text]), pa.array(at), pa.array(n)], _BLOCKS)

    return docs.select("doc_id", "text", "base").mapInArrow(rows, _BLOCK_TYPES)


#: What a partition says of a row: it repeats an earlier one of its block; it is the first of its block there; and, for
#: other partitions, a first row of the partition's first or last anchor.
REPEATS, FIRST, EDGE = 0, 1, 2


def _mark(batches):
    """Marks of a sorted partition, batch by batch. What is carried from batch to batch is the last row, the first rows of its
    block and anchor, and whether its anchor has several blocks. First rows of anchors with one block only are left out,
    but for the partition's first and last anchor, which may continue elsewhere."""
    last = block_row = anchor_row = held = None  # rows as one-row tables
    kinds, opening, schema = 0, True, None

    def marked(rows: pa.Table, source: pa.Table, mark: int, several) -> list[pa.RecordBatch]:
        out = rows.append_column("src_doc", source.column("doc_id")).append_column("src_at", source.column("at"))
        out = out.append_column("mark", pa.array(np.full(len(rows), mark, np.int8)))
        return out.append_column("several", pa.array(np.array(np.broadcast_to(several, len(rows))))).combine_chunks().to_batches(50_000)

    def edges() -> list[pa.RecordBatch]:
        rows = pa.concat_tables([anchor_row, block_row])
        return marked(rows, rows, EDGE, False)

    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        if last is not None:
            table = pa.concat_tables([last, table])  # row 0 is the last one of before
        key = [table.column(c).to_numpy() for c in ("anchor", "block", "doc_id", "at")]
        once = np.ones(len(table), bool)  # rows of a repeated doc_id are equal, and neighbours
        once[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        if not once.all():
            table, key = table.filter(pa.array(once)), [k[once] for k in key]
        skip = 0 if last is None else 1
        last = table.slice(len(table) - 1)
        if len(table) == skip:
            continue
        anchor, block = key[0], key[1]
        new_anchor = np.ones(len(anchor), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_block = new_anchor.copy()
        new_block[1:] |= block[1:] != block[:-1]
        if skip:
            new_anchor[0] = new_block[0] = False
        at = np.arange(len(anchor))
        # first row of each row's block: here, or carried
        start = np.maximum.accumulate(np.where(new_block, at, -1))
        again = np.flatnonzero(~new_block[skip:]) + skip
        if len(again):
            carried = start[again] < 0
            pool = pa.concat_tables([table, block_row]) if carried.any() else table
            yield from marked(table.take(pa.array(again)), pool.take(pa.array(np.where(carried, len(table), start[again]))), REPEATS, False)
        # first rows, by anchor: group 0 is the carried anchor, if there is one
        group = np.cumsum(new_anchor) - (0 if skip else 1)
        count = np.bincount(group[new_block], minlength=int(group[-1]) + 1)
        if skip:
            count[0] += kinds
        firsts = np.flatnonzero(new_block)
        use = count[group[firsts]] > 1
        if skip and held is not None and count[0] > 1:
            yield from marked(held, held, FIRST, True)
            held = None
        if opening:
            use = use | (group[firsts] == 0)
        ends_inside = int(group[-1]) > 0
        if opening and ends_inside:  # the partition's first anchor ends in this batch
            own = firsts[group[firsts] == 0]
            if skip == 0:
                anchor_row = table.slice(int(own[0]), 1)
            if len(own):
                block_row = table.slice(int(own[-1]), 1)
            yield from edges()
        if use.any():
            rows = table.take(pa.array(firsts[use]))
            yield from marked(rows, rows, FIRST, count[group[firsts[use]]] > 1)
        tail = firsts[group[firsts] == group[-1]]  # of the anchor that goes on
        if ends_inside or not skip:
            held = None
            anchor_row = table.slice(int(tail[0]), 1)
            if count[-1] == 1 and not (opening and not ends_inside):
                held = anchor_row
        if len(tail):
            block_row = table.slice(int(tail[-1]), 1)
        kinds = int(count[-1])
        opening = opening and not ends_inside
    if last is not None:
        if held is not None:
            yield from marked(held, held, FIRST, False)
        yield from edges()


_MARK_TYPES = _BLOCK_TYPES + ", src_doc bigint, src_at int, mark tinyint, several boolean"


def block_matches(rows: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Of an index of blocks, the rows that repeat an earlier one of their block, with their source (src_doc, src_at), and those
    that are first of their block under an anchor that has several."""
    ordered = rows.repartitionByRange(parts, "anchor", "block", "doc_id").sortWithinPartitions("anchor", "block", "doc_id", "at")
    marks = kept(ordered.mapInArrow(_mark, _MARK_TYPES))
    edge = marks.filter(F.col("mark") == EDGE)  # four rows of each partition at most, so both tables may be sent to every task
    first = F.broadcast(edge.groupBy("anchor", "block").agg(F.min(F.struct("doc_id", "at")).alias("first")))
    plural = F.broadcast(edge.groupBy("anchor").agg((F.count_distinct("block") > 1).alias("plural")))
    settled = marks.filter(F.col("mark") != EDGE).join(first, ["anchor", "block"], "left").join(plural, "anchor", "left")
    source = F.coalesce("first", F.struct(F.col("src_doc").alias("doc_id"), F.col("src_at").alias("at")))
    settled = settled.withColumn("source", source).withColumn("again", F.struct("doc_id", "at") > F.col("source"))
    again = settled.filter("again").select("doc_id", "at", "n", F.col("source.doc_id").alias("src_doc"), F.col("source.at").alias("src_at"))
    alone = settled.filter((F.col("mark") == FIRST) & ~F.col("again") & (F.col("several") | F.coalesce("plural", F.lit(False))))
    return again, alone.select("doc_id", "at", "n")


def _windows(texts_with_blocks: DataFrame, length: int) -> DataFrame:
    """(w1, w2, doc_id, at): the windows of the listed blocks of each text."""

    def rows(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part.column("text"), SPACED)
                w1, w2 = gram_hashes(w.hash, length), gram_hashes(w.hash, length, salt=1)
                lists = part.column("blocks")
                flat = lists.flatten()
                owner = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
                at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy()
                pos = np.repeat(at, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                owner = np.repeat(owner, n)
                where = w.first[owner] + pos - part.column("base").fill_null(0).to_numpy()[owner]
                good = (where >= w.first[owner]) & (where + length <= w.first[owner + 1])
                where, pos, owner = where[good], pos[good], owner[good]
                if len(where):
                    yield pa.record_batch([pa.array(w1[where].view(np.int64)), pa.array(w2[where].view(np.int64)), pa.array(part.column("doc_id").to_numpy()[owner]), pa.array(pos.astype(np.int32))], ["w1", "w2", "doc_id", "at"])

    return texts_with_blocks.select("doc_id", "text", "base", "blocks").mapInArrow(rows, "w1 bigint, w2 bigint, doc_id bigint, at int")


def window_matches(windows: DataFrame, most: int) -> DataFrame:
    """Windows that start earlier elsewhere too, with the first of their kind as source. A window with more than ``most`` copies
    is dealt to salts, and its first copied to each: the list of such windows is at most as long as all windows by ``most``."""
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("c")).filter("c > 1")
    salts = F.ceil(F.col("c") / most).cast("int")
    heavy = F.broadcast(first.filter(F.col("c") > most).select(F.col("w1").alias("h1"), F.col("w2").alias("h2"), salts.alias("salts")))
    left = windows.join(heavy, (F.col("w1") == F.col("h1")) & (F.col("w2") == F.col("h2")), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "at"), "salts").cast("int"), F.lit(0)))
    right = first.select("w1", "w2", "first", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    again = left.join(right, ["w1", "w2", "salt"]).filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at")))
    return again.select("doc_id", "at", F.lit(1).alias("n"), F.col("first.doc_id").alias("src_doc"), F.col("first.at").alias("src_at"))


def greedy(owner: np.ndarray, at: np.ndarray, n: np.ndarray, src_doc: np.ndarray, src_at: np.ndarray, length: int) -> list[np.ndarray]:
    """The parse of some documents: owner, place, words, source document and place in it of every factor, from left to right."""
    diagonal = at - src_at
    order = np.lexsort((at, diagonal, src_doc, owner))
    owner, at, end, src_doc, diagonal = owner[order], at[order].astype(np.int64), (at + n)[order].astype(np.int64), src_doc[order], diagonal[order]
    if not len(owner):
        return [owner, at, at, src_doc, at]
    # candidates: runs of touching matches on one diagonal (ends only grow within a run, since blocks of a text do not overlap)
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (src_doc[1:] != src_doc[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] > end[:-1])
    first = np.flatnonzero(new)
    owner, at, end, src_doc, diagonal = owner[first], at[first], np.maximum.reduceat(end, first), src_doc[first], diagonal[first]
    order = np.lexsort((diagonal, src_doc, -end, at, owner))
    out = []
    document, upto, best = None, 0, (0, 0, 0)  # upto: the first window no factor holds; best: the candidate over it that reaches farthest

    def take() -> None:
        nonlocal upto
        if best[0] > upto:
            out.append((document, upto, best[0] - upto + length - 1, best[1], upto - best[2]))
            upto = best[0]

    for o, a, e, d, g in zip(*(x[order].tolist() for x in (owner, at, end, src_doc, diagonal)), strict=True):
        if o != document:
            take()
            document, upto, best = o, a, (0, 0, 0)
        if a > upto:  # every candidate over the window at upto is known
            take()
            upto = max(upto, a)
        if e > best[0]:
            best = (e, d, g)
    take()
    return [np.array(x, np.int64) for x in zip(*out, strict=True)]


_FACTORS = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("source", T.LongType()), T.StructField("source_at", T.IntegerType())]))
_FACTOR = pa.struct([("at", pa.int32()), ("words", pa.int32()), ("source", pa.int64()), ("source_at", pa.int32())])


def factors(named: DataFrame, texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, factors): the parse of every document that repeats something. named: documents with ids, and ``base`` from :func:`with_bases`;
    texts: the same dealt out by doc_id, to be read twice."""
    index = kept(block_rows(named, length))
    rows = index.count()
    repeats, alone = block_matches(index, partitions(index, rows, ROWS_EACH))
    released(index)
    listed = alone.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("blocks"))
    again = window_matches(_windows(texts.join(listed, "doc_id"), length), max(1000, rows // HEAVY))
    found = repeats.unionByName(again)
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "src_doc", "src_at")).alias("found"))

    @F.arrow_udf(_FACTORS)
    def parse(found: pa.Array) -> pa.Array:
        flat = found.flatten()
        owner = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
        doc, *columns = greedy(owner, *(flat.field(c).to_numpy() for c in ("at", "n", "src_doc", "src_at")), length)
        offsets = np.searchsorted(doc, np.arange(len(found) + 1)).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, _FACTOR, strict=True)], fields=list(_FACTOR))
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    return per_doc.select("doc_id", parse("found").alias("factors"))


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("factors", _FACTORS)])


def with_bases(named: DataFrame, length: int) -> DataFrame:
    """named with ``base``: where a text begins in a document of several unlike texts, and null in all others. Only texts of repeated ids are looked at."""
    repeated = named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if repeated.isEmpty():
        return named.withColumn("base", F.lit(None).cast("int"))
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    parts = named.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("__id"), F.xxhash64(text).alias("__h"), words.alias("n")).distinct()
    w = Window.partitionBy("__id").orderBy("__h")
    before = F.coalesce(F.sum(F.col("n") + length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    bases = parts.withColumn("base", before).withColumn("parts", F.count("*").over(Window.partitionBy("__id"))).filter("parts > 1").select("__id", "__h", "base")
    return named.join(bases, (F.col("doc_id") == F.col("__id")) & (F.xxhash64(text) == F.col("__h")), "left").drop("__id", "__h")


@F.arrow_udf(_RESULT)
def _without(texts: pa.Array, parsed: pa.Array, bases: pa.Array) -> pa.Array:
    out, total, gone = [], [], []
    own = parsed.to_pylist() if bases.null_count < len(bases) else None  # the factors of each row, if some documents have several texts
    for k, (text, cut, base) in enumerate(zip(texts, parsed, bases.to_pylist(), strict=True)):
        words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
        total.append(len(words))
        if base is not None and cut.is_valid:
            own[k] = [f | {"at": f["at"] - base} for f in own[k] if 0 <= f["at"] - base < len(words)]
            cut = pa.scalar(own[k], pa.list_(_FACTOR))
        if cut.is_valid and len(cut):
            edge = np.zeros(len(words) + 1, np.int64)
            start = cut.values.field("at").to_numpy()
            np.add.at(edge, np.minimum(start, len(words)), 1)
            np.add.at(edge, np.minimum(start + cut.values.field("words").to_numpy(), len(words)), -1)
            covered = np.cumsum(edge)[:-1] > 0
            words = [x for x, c in zip(words, covered.tolist(), strict=True) if not c]
        gone.append(total[-1] - len(words))
        out.append(b" ".join(words).decode("utf-8", "surrogatepass"))
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), parsed.cast(pa.list_(_FACTOR)) if own is None else pa.array(own, pa.list_(_FACTOR))], ["text", "n_words", "n_removed", "factors"])


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with a column ``__d``: the text without duplicate spans (words joined by one space), its words before, how many went, and its factors."""
    docs = docs.drop("__d")
    key, found, base = fresh(docs, "__i"), fresh(docs, "__factors"), fresh(docs, "__base")
    names = {"base": fresh(docs.drop("base"), "__of")} if "base" in docs.columns else {}  # the caller's own column of that name
    named = with_bases(docs.withColumnsRenamed(names).filter("doc_id is not null"), length)
    texts = named.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    narrow = texts.select("doc_id", "text", "base")
    parsed = factors(named.select("doc_id", "text", "base"), narrow, length).select(F.col("doc_id").alias(key), F.col("factors").alias(found))
    cut = texts.join(parsed, F.col("doc_id") == F.col(key), "left").drop(key).withColumnRenamed("base", base).withColumnsRenamed({v: k for k, v in names.items()})
    unnamed = docs.filter("doc_id is null").withColumn(found, F.lit(None).cast(_FACTORS)).withColumn(base, F.lit(None).cast("int"))
    return cut.unionByName(unnamed).withColumn("__d", _without("text", found, base)).select(*docs.columns, "__d")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "__d.n_words", "__d.n_removed", F.sha2("__d.text", 256).alias("kept_sha256"))
