"""Ranked lexical search: the best documents for each of many queries, exactly, without scoring most of them.

The texts are read once: of each document the query terms and their counts are kept, a small part of its words. Sums over
that table give the weights. Runs of documents in it are shards; each is indexed by posting blocks of varying length
(:mod:`rostrum.llm.posting_blocks`) and searched there for every query, and the best of all shards are ranked. Queries
are worked on in blocks of a bounded number of terms; each further block is one more pass.

Defined results: a null text has no terms, and neither a document nor an item without terms gets a row; rows are documents, so
repeated rows are ranked each; items that share an item_id are one item with the terms of all; equal scores are ranked by
doc_id, nulls last; very long texts are read whole; an empty table of either kind gives an empty result; other columns
are left aside. Terms are told apart by 64-bit hashes against those of the queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.llm.line_dedup import LOWER, UPPER
from rostrum.llm.lookup import HashIndex
from rostrum.llm.posting_blocks import Shard
from rostrum.llm.shared import kept, released
from rostrum.llm.words import ALNUM_LOWER, slices, words_of

BEST = 10
#: Rows of (item, term) that are sent to the tasks at once.
BLOCK_ROWS = 200_000
#: A shard ends with the batch in which it has so many postings or documents.
SHARD_POSTINGS, SHARD_DOCS = 3_000_000, 65_536

_TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
_POSTINGS = "doc_id bigint, n bigint, terms array<int>, counts array<int>"


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))


def _counts(index: HashIndex, terms: int):
    """Of every document with a term: how many it has, and those of the queries with their counts."""

    def count(batches):
        for batch in (s for b in batches for s in slices(b, "text")):
            w = words_of(batch.column("text"), ALNUM_LOWER)
            n = w.counts()
            number = index.find(w.hash)
            known = np.flatnonzero(number >= 0)
            doc = np.repeat(np.arange(len(n)), n)[known]
            key, tf = np.unique(doc * terms + number[known], return_counts=True)
            offsets = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * terms).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % terms, tf)]
            table = pa.table([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])
            yield from table.filter(pa.array(n > 0)).combine_chunks().to_batches()

    return count


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: its number of terms, and which of ``terms`` it has how often."""
    hashes = words_of(pa.array(terms, pa.string()), ALNUM_LOWER).hash
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counts(HashIndex(hashes), max(1, len(terms))), _POSTINGS)


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def _search(weight: np.ndarray, queries: list[np.ndarray], documents: int, words: int, ids: pa.Array, k: int):
    """Streams rows of postings; every shard gives its k best documents of every query."""

    def searched(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        n = table.column("n").to_numpy()
        lists, counts = (pc.list_flatten(table.column(c)).to_numpy() for c in ("terms", "counts"))
        of = pc.list_parent_indices(table.column("terms")).to_numpy()
        m = 10 + 90 * n * documents // words
        tf = counts.astype(np.int64)
        score = weight[lists] * (1_000_000_000 * tf // (1000 * tf + 8 * m[of]))
        shard = Shard.of(lists, of, score, len(weight))
        key = table.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        assured = shard.assured(k)
        item, doc, total = [], [], []
        for q, terms in enumerate(queries):
            d, s, _ = shard.search(terms, k, key, assured)
            item.append(np.full(len(d), q))
            doc.append(d)
            total.append(s)
        found = table.column("doc_id").combine_chunks().take(pa.array(np.concatenate(doc)))
        return pa.record_batch([ids.take(pa.array(np.concatenate(item))), found, pa.array(np.concatenate(total), pa.int64())], ["item_id", "doc_id", "score"])

    def search(batches):
        held, rows, docs = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, docs = rows + len(batch.column("terms").flatten()), docs + len(batch)
            if rows >= SHARD_POSTINGS or docs >= SHARD_DOCS:
                yield searched(held)
                held, rows, docs = [], 0, 0
        if docs:
            yield searched(held)

    return search


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0. docs: doc_id, text; items: item_id, text."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    wanted = kept(items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct())
    blocks = -(-wanted.count() // block_rows)
    out, size = None, None
    for b in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        if not rows.num_rows:
            continue
        terms, ids = (rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("term", "item_id"))
        number, item = terms.indices.to_numpy(), ids.indices.to_numpy()
        order = np.argsort(item, kind="stable")
        queries = np.split(number[order], np.flatnonzero(np.diff(item[order])) + 1)
        found = kept(postings(docs, terms.dictionary.to_pylist()))
        size = size or found.agg(F.count("*"), F.sum("n")).first()
        if not size[0]:
            break
        df = np.zeros(len(terms.dictionary), np.int64)
        for t, n in found.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow().to_pandas().itertuples(index=False):
            df[t] = n
        best = found.mapInArrow(_search(weights(df, size[0]), queries, *size, ids.dictionary, k), schema)
        out = best if out is None else out.unionByName(best)
    released(wanted)
    if out is None:
        out = spark.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ranked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
