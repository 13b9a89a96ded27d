"""Quality rules with adaptive thresholds per language and source.

Each text is measured once, and the measures are kept with its row; they go into
log-bucket quantile sketches (bucket counts, which merge by addition) per language
and source. Thresholds are outlier fences (quartile plus ``fence`` interquartile
ranges) read from those sketches, so they follow each source's own distribution and
do not cut a fixed share of it. A group's fences are merged with its language's by
their counts: n rows weigh n / (n + ``prior_rows``), without a step at any size. A
joined filter then applies them.

The sketches are a plain ``groupBy`` of bucket counts: partially summed before
the shuffle, so a source with a third of all rows is no hot key. Their size is
bounded by the number of sources times :data:`FEATURES` times the buckets. The
thresholds go to every task if they are few (:data:`BROADCAST_GROUPS`); else their
join deals a group with very many rows to salts.

Defined results: a null text is measured as an empty one; null language or
source are groups of their own; repeated rows are judged one by one; an empty
table gives an empty result; ties count as they are (a value on a fence stays);
very long texts are measured whole; other columns are left as they are, but for
ones named ``__q`` or ``__v``, which the result replaces.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rostrum.llm.shared import fresh, join_spread, kept
from rostrum.llm.words import SPACE_CHARS

SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Feature: (numerator, denominator, what is added to the denominator, so that a few lines prove nothing,
#: least spread that counts, whether low values are judged as well).
FEATURES = {
    "word_length": ("word_chars", "n_words", 0, 0.8, True),
    "symbols": ("n_symbols", "word_chars", 0, 0.02, False),
    "dup_lines": ("n_dup_lines", "n_lines", 4, 0.1, False),
    "repeats": ("n_repeat_words", "n_words", 0, 0.1, False),
}
#: Ratio of neighbouring bucket bounds (about 1 % relative error), and the least value that is told from 0.
GAMMA, LEAST = 1.02, 1e-4
#: Measures that depend on how a language is written; another language's sketch never judges them.
OF_LANGUAGE = {"word_length", "repeats"}
#: Rows that the next level is worth: a group's language, then all rows, or for OF_LANGUAGE the language's own fences, wider the fewer rows it has.
PRIOR_ROWS = 100
#: Thresholds up to which all of them are sent to every task.
BROADCAST_GROUPS = 100_000
FENCE = 3.0


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The measures of one text, in the order of :data:`MEASURES`."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACE_CHARS))
    seen, lines, dup = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACE_CHARS):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(grams)
    covered = end = 0
    if len(times) < len(grams):
        for i, g in enumerate(grams):
            if times[g] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, covered, lines


_MEASURED = pa.struct([(m, pa.int64()) for m in MEASURES])


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measure(texts: pa.Array) -> pa.Array:
    rows = [measure(t.as_py()) for t in texts]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(MEASURES))], fields=list(_MEASURED))


def _value(name: str) -> Column:
    top, bottom, prior, _, _ = FEATURES[name]
    return F.coalesce(F.try_divide(F.col(f"__q.{top}").cast("double"), (F.col(f"__q.{bottom}") + prior).cast("double")), F.lit(0.0))


def _bucket(x: Column) -> Column:
    return F.when(x < LEAST, F.lit(None).cast("int")).otherwise(F.ceil(F.log(x) / math.log(GAMMA)).cast("int"))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, feature, bucket, n): the mergeable sketches. bucket null: below :data:`LEAST`."""
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), _bucket(_value(f)).alias("bucket")) for f in FEATURES])
    return measured.filter("__q.n_words > 0").select("lang", "source", F.explode(parts).alias("p")).groupBy("lang", "source", "p.feature", "p.bucket").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a level of sketches: its groups with rows, first and third quartile of each feature."""
    merged = sketch.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "feature")
    at = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_first()))).withColumn("rows", F.sum("n").over(w)).withColumn("at", at)
    q = lambda x: F.min(F.when(F.col("upto") > F.lit(x) * (F.col("rows") - 1), F.col("at")))
    own = ranked.groupBy(*by, "feature").agg(F.max("rows").alias("rows"), q(0.25).alias("q1"), q(0.75).alias("q3"))
    agg = [F.max(F.when(F.col("feature") == f, F.struct("rows", "q1", "q3"))).alias(f) for f in FEATURES]
    return own.groupBy(*by).agg(F.max("rows").alias("rows"), *agg)


def thresholds(sketch: DataFrame, fence: float = FENCE, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """(lang, source, <feature>_low, <feature>_high) for every group that has a sketch."""
    own, lang, everything = (_quartiles(sketch, by) for by in (["lang", "source"], ["lang"], []))
    s, a, e = own.alias("s"), lang.alias("a"), everything.alias("e")
    joined = s.join(a, F.col("s.lang").eqNullSafe(F.col("a.lang")), "left").join(F.broadcast(e))  # e is one row
    out = [F.col("s.lang"), F.col("s.source")]
    share = lambda level: F.col(f"{level}.rows") / (F.col(f"{level}.rows") + F.lit(float(prior_rows)))
    blend = lambda level, x, y: share(level) * x + (1 - share(level)) * y
    for f, (_, _, _, least, both) in FEATURES.items():

        def fences(level: str, wider: Column | float = 1.0, f=f, least=least) -> tuple[Column, Column]:
            q = F.col(f"{level}.{f}")
            spread = fence * F.greatest(q["q3"] - q["q1"], F.lit(least)) * wider
            return q["q1"] - spread, q["q3"] + spread

        if f in OF_LANGUAGE:
            of_lang = fences("a", 1 / share("a"))
        else:
            of_lang = tuple(blend("a", x, y) for x, y in zip(fences("a"), fences("e"), strict=True))
        low, high = (blend("s", x, y) for x, y in zip(fences("s"), of_lang, strict=True))
        out += [(low if both else F.lit(0.0)).alias(f"{f}_low"), high.alias(f"{f}_high")]
    return joined.select(*out)


def measured(docs: DataFrame) -> DataFrame:
    """docs with a column ``__q``: the measures of the text."""
    return docs.drop("__q", "__v").withColumn("__q", _measure("text"))


def judged(rows: DataFrame, fence: float = FENCE, prior_rows: int = PRIOR_ROWS, least_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """rows: a kept table with ``__q``, lang and source. Adds ``__v``: struct of base_failed and kept."""
    key, t = fresh(rows, "__key"), fresh(rows, "__t")
    known = lambda c: (F.col(c).isNull().alias(f"no_{c}"), F.coalesce(c, F.lit("")).alias(c))
    group = F.struct(*known("lang"), *known("source"))
    limits = kept(thresholds(sketches(rows), fence, prior_rows).select(group.alias(key), F.struct(*[f"{f}_{x}" for f in FEATURES for x in ("low", "high")]).alias(t)))
    keyed = rows.withColumn(key, group)
    if limits.count() <= BROADCAST_GROUPS:
        joined = keyed.join(F.broadcast(limits), key, "left")
    else:
        joined = join_spread(keyed, limits, key, rows.count(), F.xxhash64("__q", F.monotonically_increasing_id()))
    failed = (F.col("__q.n_words") < least_words) | (100 * F.col("__q.n_repeat_words") > most_repeats * F.col("__q.n_words"))
    inside = F.lit(True)
    for f in FEATURES:
        inside = inside & _value(f).between(F.col(f"{t}.{f}_low"), F.col(f"{t}.{f}_high"))
    return joined.withColumn("__v", F.struct(failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept"))).drop(key, t)


def judge(docs: DataFrame, **options) -> DataFrame:
    """docs with two more columns: ``__q`` (struct of measures) and ``__v`` (struct of base_failed, kept)."""
    return judged(kept(measured(docs)), **options)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    return judge(docs, **options).filter("__v.kept").select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("__q", "__v")])


def op3_adaptive_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = kept(measured(docs).drop("text"))
    return judged(rows).select("doc_id", *[f"__q.{m}" for m in MEASURES[:5]], "__v.base_failed", "__v.kept")
