"""Line dedup over range-partitioned hashes, with keep bitmaps as its result.

Each long line becomes one row of a 128-bit hash and its place. Rows are
range-partitioned by (hash, document) and sorted in each partition by hash, then
document from the largest down, so that the keeper of a key comes first, then by
place; each partition is streamed once, batch by batch, and only the rows of the
first documents of one key are carried along. Because the range includes the
document, a line that a third of all documents hold is spread over many
partitions; only a partition's first and last key can continue elsewhere, so
at most two rows per partition are broadcast to settle those.
The operator returns one zlib-packed bitmap per document that loses lines, not
text; a document without a bitmap keeps every line.

Defined results: a null or empty text is one empty line; equal keys inside one
document count once towards the documents of a key, and all its lines stay or go
together; repeated rows of one document share its id and are one document; rows
without doc_id keep all lines and count for none; very long texts and lines are
read whole; an empty table gives an empty result; other columns are left alone,
but for one named ``__l``, which the result replaces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.llm.shared import fresh, kept, partitions, released
from rostrum.llm.words import SPACE_CHARS

#: A-Z to a-z; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Lines in a partition, about.
ROWS_EACH = 2_000_000


def line_key(line: Column) -> Column:
    """The text that tells lines apart."""
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), UPPER, LOWER)


def line_rows(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(hi, lo, doc_id, text_hash, n_lines, line): one row per line whose key is long enough."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    placed = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), lines.alias("lines"))
    each = placed.select("doc_id", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("line", "of"))
    keyed = each.filter(F.length("of") >= least_chars).withColumn("key", line_key(F.col("of"))).filter(F.length("key") >= least_chars)
    return keyed.select(F.xxhash64("key").alias("hi"), F.xxhash64(F.lit(1), "key").alias("lo"), "doc_id", "text_hash", "n_lines", "line")


#: What a partition says of a line: it goes; that hangs on other partitions; and, for those, an end of the partition.
GONE, OPEN, EDGE = 0, 1, 2
_COLUMNS = "hi bigint, lo bigint, doc_id bigint, text_hash bigint, n_lines int, line int"
_DECIDED = _COLUMNS + ", state tinyint, docs bigint"


def _decide(least_docs: int):
    """Streams a sorted partition. Of the key that goes on, the rows of its first ``least_docs`` - 1 documents are held until it is
    known whether there are enough documents; then only those of its first document."""

    def said(table: pa.Table, state: int, docs: int = 0) -> list[pa.RecordBatch]:
        out = table.append_column("state", pa.array(np.full(len(table), state, np.int8))).append_column("docs", pa.array(np.full(len(table), docs, np.int64)))
        return out.combine_chunks().to_batches(50_000)

    def at_edge(held: pa.Table, docs: int) -> list[pa.RecordBatch]:
        """A first or last key of the partition: its rows that are not decided, and what others must know of it."""
        return said(held, OPEN) + said(held.slice(0, 1), EDGE, docs)

    def stream(batches):
        held, reached, first = None, False, True
        docs_held = 0
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            hi, lo, doc = (table.column(c).to_numpy() for c in ("hi", "lo", "doc_id"))
            new_key = np.ones(len(hi), bool)
            new_key[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            new_doc = new_key.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            group = np.cumsum(new_key) - 1
            docs = np.bincount(group, weights=new_doc).astype(np.int64)
            if reached:
                docs[0] = max(docs[0], least_docs)
            count = np.cumsum(new_doc)
            rank = count - count[np.flatnonzero(new_key)][group] + 1  # of the row's document in its key
            gone = (docs[group] >= least_docs) & (rank > 1)
            if gone.any():
                yield from said(table.filter(pa.array(gone)), GONE)
            last = group == group[-1]
            if first and group[-1] > 0:
                yield from at_edge(table.filter(pa.array((group == 0) & ~gone)), int(docs[0]))
                first = False
            held, docs_held = table.filter(pa.array(last & ~gone)), int(docs[-1])
            reached = docs_held >= least_docs
        if held is not None:
            yield from at_edge(held, docs_held)

    return stream


def dropped_lines(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, text_hash, n_lines, line) that go: those of keys in enough documents, but for the largest document. rows: a kept table."""
    parts = partitions(rows, rows.count(), ROWS_EACH)
    ranged = rows.repartitionByRange(parts, "hi", "lo", "doc_id").sortWithinPartitions("hi", "lo", F.desc("doc_id"), "text_hash", "line")
    decided = kept(ranged.mapInArrow(_decide(least_docs), _DECIDED))
    # at most two rows of each partition, so the table may be sent to every task
    ends = F.broadcast(decided.filter(F.col("state") == EDGE).groupBy("hi", "lo").agg(F.sum("docs").alias("all"), F.max("doc_id").alias("top")))
    settled = decided.filter(F.col("state") == OPEN).join(ends, ["hi", "lo"]).filter((F.col("all") >= least_docs) & (F.col("doc_id") != F.col("top")))
    columns = ["doc_id", "text_hash", "n_lines", "line"]
    return decided.filter(F.col("state") == GONE).select(columns).unionByName(settled.select(columns))


@F.arrow_udf(T.BinaryType())
def _pack(n_lines: pa.Array, lines: pa.Array) -> pa.Array:
    out = []
    for n, gone in zip(n_lines.to_pylist(), lines.to_pylist(), strict=True):
        keep = np.ones(n, np.uint8)
        keep[gone] = 0
        out.append(zlib.compress(np.packbits(keep).tobytes()))
    return pa.array(out, pa.binary())


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, text_hash, n_lines, keep): for every document row that loses lines."""
    rows = kept(line_rows(docs.select("doc_id", "text"), least_chars))
    gone = dropped_lines(rows, least_docs)
    released(rows)
    per_doc = gone.groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_set("line").alias("lines"))
    return per_doc.select("doc_id", "text_hash", "n_lines", _pack("n_lines", "lines").alias("keep"))


_APPLIED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


@F.arrow_udf(_APPLIED)
def _apply(texts: pa.Array, keeps: pa.Array) -> pa.Array:
    kept, n, dropped = [], [], []
    for text, keep in zip(texts, keeps, strict=True):
        text = text.as_py() or ""
        lines = text.split("\n")
        n.append(len(lines))
        if keep.is_valid:
            bits = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), np.uint8), count=len(lines))
            left = [x for x, b in zip(lines, bits.tolist(), strict=True) if b]
            kept.append("\n".join(left))
            dropped.append(len(lines) - len(left))
        else:
            kept.append(text)
            dropped.append(0)
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with a column ``__l``: the text that is left, its lines before, and how many went."""
    docs = docs.drop("__l")
    d, t, h, keep = (fresh(docs, c) for c in ("__d", "__t", "__h", "__keep"))
    b = bitmaps.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("keep").alias(keep))
    joined = docs.withColumn(t, F.xxhash64("text")).join(b, (F.col("doc_id") == F.col(d)) & (F.col(t) == F.col(h)), "left")
    return joined.withColumn("__l", _apply("text", keep)).drop(d, h, t, keep)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = apply_bitmaps(docs, keep_bitmaps(docs))
    return done.select("doc_id", "__l.n_lines", "__l.n_dropped", F.sha2("__l.text", 256).alias("kept_sha256"))
