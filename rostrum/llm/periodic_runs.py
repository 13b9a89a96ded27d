"""Periodic runs of words: stretches that repeat a few words over and over, and texts with the repeats dropped.

Every whole text is one word sequence, judged alone, so nothing is shuffled. Runs come from the runs theorem
(:mod:`rostrum.llm.suffixes`): suffixes in order, longest Lyndon words under both orders of words by next smaller values of
the inverse suffix array, and their extension by common prefixes with a sparse table of minima. Words are told apart by
64-bit hashes within one text.

Defined results: a null or empty text has no words and no run; runs may overlap or lie in one another, and a word goes if
any run says so; a very long text is read whole, in memory of a few numbers per word and doubling step; repeated rows
are judged alike; an empty table gives an empty result; other columns are left alone, but for one named ``__r``, which
the result replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rostrum.llm.suffixes import ragged, runs
from rostrum.llm.words import chunks, words_of

LEAST_WORDS, LEAST_EXPONENT = 6, 4

_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN, False)), T.StructField("text", T.StringType())])


def _collapsed(column: pa.Array, first: np.ndarray, gone: np.ndarray) -> list[bytes]:
    """The words of each text that are left, joined by one space. ``bytes.split`` parts at the six ASCII white-space characters."""
    out, touched = [], np.add.reduceat(np.append(gone, False), first[:-1]) if len(first) > 1 else []
    for k, text in enumerate(column.cast(pa.large_binary())):
        found = (text.as_py() or b"").split()
        if found and touched[k]:
            found = [found[j] for j in np.flatnonzero(~gone[first[k] : first[k + 1]])]
        out.append(b" ".join(found))
    return out


def _find(least_words: int, least_exponent: int):
    def find(texts: pa.Array) -> pa.Array:
        parts = []
        for column in chunks(texts):
            w = words_of(column)
            of, start, length, period = runs(w.hash, w.first, least_exponent)
            good = length >= least_words
            of, start, length, period = of[good], start[good], length[good], period[good]
            gone = np.zeros(len(w.hash), bool)
            run, k = ragged(length - period)
            gone[(w.first[of] + start + period)[run] + k] = True
            each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            offsets = np.searchsorted(of, np.arange(len(column) + 1)).astype(np.int32)
            kept = pa.array(_collapsed(column, w.first, gone), pa.binary()).cast(pa.string())
            parts.append(pa.StructArray.from_arrays([pa.array(w.counts(), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), each), kept], ["n_words", "runs", "text"]))
        return pa.concat_arrays(parts) if parts else pa.array([], to_arrow_type(_FOUND))

    return find


def find_runs(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """docs with a column ``__r``: the number of words, all runs of at least so many words and periods by (start, period), and
    the text without the words that a run contains after its first period, joined by one space."""
    return docs.drop("__r").withColumn("__r", F.arrow_udf(_find(least_words, least_exponent), _FOUND)(text))


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs whose texts have lost the repeats of their runs; a text without runs stays as it is, white space and all."""
    found = find_runs(docs, text)
    return found.withColumn(text, F.when(F.size("__r.runs") > 0, F.col("__r.text")).otherwise(F.col(text))).select(docs.columns)


@F.arrow_udf(T.StringType())
def _looped(texts: pa.Array, sums: pa.Array) -> pa.Array:
    out = texts.cast(pa.large_string()).to_pylist()
    for k, h in enumerate(sums.to_pylist()):
        words = out[k].encode().split() if out[k] and h is not None and h % 10 == 0 else []
        if words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[k] = b" ".join(words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]).decode()
    return pa.array(out, pa.string())


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's input: a tenth of all texts, by a checksum of doc_id, repeat p of their words from word a on. Rows without doc_id stay."""
    return _looped(text, F.crc32(doc_id.cast("string").cast("binary")))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs)
    best = F.array_max(F.transform("__r.runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("quick"))))
    said = F.array_join(F.transform("__r.runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    told = F.when(F.size("__r.runs") > 0, F.concat(said, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("__r.runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("__r.text", 256).alias("collapsed_sha256"))
    length, period = F.col("b.length"), -F.col("b.quick")
    return rows.select("doc_id", "n_runs", (-F.col("b.back")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
