"""Exact joins of names that hold one another, by words or as text, through the rarest of what they must share.

Words: if all words of one name are in another, so are its rarest ones. Words are ordered by how many names have them, rarest first; a
name is looked up by its first ``LEVELS`` words in that order, and the longer name offers its own words one by one, level by level,
going on only where some name has such a beginning. Every level is a join with one row to a key, so frequent words make no block of
pairs; only the last one makes pairs, of names that share all words of the lookup.

Text: if one name is a part of another, so are all its pieces of q letters. A name is looked up by the rarest of its pieces, and not at
all if one of them is nowhere; length and position of the piece must allow for the rest of the name on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.names import name_tokens

LEVELS = 3
#: Letters of the pieces: a name is looked up by pieces of the first of these lengths that it has.
PIECES = (12, 6, 3)


def _by_rarity(names: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """(side, key, words): the words of each name, the rarest first."""
    words = names.select("side", key, F.explode(name_tokens(F.col(key))).alias("w")).join(counts, "w")
    return words.groupBy("side", key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("words"))


def _path(words: Column, n: int) -> Column:
    return F.array_join(F.slice(words, 1, n), " ")


def word_candidates(parts: DataFrame, wholes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(side, part, whole, p_words, w_words): names of one side that share the first ``levels`` words of the part, or all if it has fewer.
    parts: (side, part), wholes: (side, whole); distinct normal forms. A side is one question: which of its wholes hold which of its parts."""
    every = parts.select(F.col("part").alias("w")).unionByName(wholes.select(F.col("whole").alias("w")))
    counts = every.select(F.explode(name_tokens(F.col("w"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    p = _by_rarity(parts, "part", counts).withColumnRenamed("words", "p_words").withColumn("size", F.size("p_words"))
    w = _by_rarity(wholes, "whole", counts).withColumnRenamed("words", "w_words")
    offered = w.select("side", "whole", "w_words", F.posexplode("w_words").alias("i", "path"))
    out = None
    for level in range(1, levels + 1):
        known = p.filter(F.col("size") >= level).select("side", _path(F.col("p_words"), level).alias("path")).distinct()
        offered = offered.join(known, ["side", "path"], "left_semi")
        leaves = p.filter(F.col("size") == level) if level < levels else p.filter(F.col("size") >= level)
        met = offered.join(leaves.withColumn("path", _path(F.col("p_words"), level)), ["side", "path"]).select("side", "part", "whole", "p_words", "w_words")
        out = met if out is None else out.unionByName(met)
        if level < levels:
            rest = F.when(F.col("i") + 1 < F.size("w_words"), F.sequence(F.col("i") + 1, F.size("w_words") - 1))
            more = offered.withColumn("j", F.explode(rest))
            offered = more.select("side", "whole", "w_words", F.col("j").alias("i"), F.concat_ws(" ", "path", F.get("w_words", F.col("j"))).alias("path"))
    return out


def word_pairs(parts: DataFrame, wholes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(side, part, whole): all words of the part are words of the whole."""
    return word_candidates(parts, wholes, levels).filter(F.size(F.array_except("p_words", "w_words")) == 0).select("side", "part", "whole")


def _pieces(key: str, q: int) -> Column:
    """(piece, at) of every q letters of a name, each piece at all its places."""
    every = F.transform(F.sequence(F.lit(1), F.length(key) - q + 1), lambda i: F.struct(F.substring(F.col(key), i, F.lit(q)).alias("piece"), i.alias("at")))
    return F.when(F.length(key) >= q, every).otherwise(F.array().cast("array<struct<piece:string,at:int>>"))


def text_candidates(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(side, part, whole): the rarest piece of the part stands in the whole, with room for the rest of the part on both sides."""
    own = _pieces("part", PIECES[-1])
    for q in reversed(PIECES[:-1]):
        own = F.when(F.length("part") >= q, _pieces("part", q)).otherwise(own)
    asked = parts.select("side", "part", F.explode(own).alias("x"))
    offered = wholes.select("side", "whole", F.explode(F.concat(*[_pieces("whole", q) for q in PIECES])).alias("x"))
    asked = asked.select("side", "part", "x.piece", F.col("x.at").alias("p_at"))
    offered = offered.select("side", "whole", "x.piece", F.col("x.at").alias("w_at"))
    counts = offered.groupBy("side", "piece").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece", "p_at"))
    keyed = asked.join(counts, ["side", "piece"], "left").groupBy("side", "part").agg(rarest.alias("b")).filter("b.n > 0").select("side", "part", "b.piece", "b.p_at")
    room = (F.col("w_at") >= F.col("p_at")) & (F.length("whole") - F.col("w_at") >= F.length("part") - F.col("p_at"))
    return offered.join(keyed, ["side", "piece"]).filter(room).select("side", "part", "whole").distinct()


def text_pairs(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(side, part, whole): the part stands in the whole as text."""
    return text_candidates(parts, wholes).filter(F.contains(F.col("whole"), F.col("part")))
