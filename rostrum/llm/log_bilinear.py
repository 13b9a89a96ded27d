"""Log probabilities of texts under a log-bilinear neural model that is trained on the corpus itself.

Every word of the training documents is counted. The most frequent words are classes of their own; all others share classes
by their last three bytes, and within its class a word has its share of the counts, with one more word for all that were
never seen. The class of the next token is predicted by :mod:`rostrum.llm.log_bilinear_model`. Training goes over every
training token once, in rounds over a share of the documents each: every partition trains a copy of the model, and the
copies are averaged row by row with the number of times that each has met the row, as a Spark aggregation. What reaches
the driver is the model and a table of the most frequent words, both of fixed size; other words are joined as a table.

Defined results: a null or empty text is one end token; rows without doc_id are learned from; repeated rows count, and are
scored, each; very long texts are read whole; ties in frequency go to the smaller hash; without training documents the
counts are empty and every score is that of unseen words; an empty table gives an empty result; other columns are left
alone, but for one named ``__m``, which the result replaces, and the texts, which nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.llm.log_bilinear_model import WIDTH, Model, contexts
from rostrum.llm.lookup import HashIndex
from rostrum.llm.shared import fresh, kept
from rostrum.llm.words import SPACED_LOWER, Words, mix, slices, words_of

#: Classes of one frequent word each, and classes of the other words by their endings. With the end token, the outcomes of the model.
FREQUENT, ENDINGS = 256, 255
OUTCOMES, END = FREQUENT + ENDINGS + 1, FREQUENT + ENDINGS
#: Words, by frequency, whose counts are sent to the tasks.
KNOWN = 262_144
STEPS = 4096
#: Bytes of text whose words are counted at once, before Spark does.
COUNTED_BYTES = 8 << 20
ROUNDS = 3
#: Added to every count.
ADDED = 0.1


def endings(w: Words) -> np.ndarray:
    """The class of each word by its last three bytes, or all of a shorter one."""
    last = np.zeros(len(w.start), np.uint64)
    for k in (1, 2, 3):
        byte = w.data[np.maximum(w.end - k, 0)].astype(np.uint64)
        byte += np.uint64(32) * ((byte >= 65) & (byte <= 90))
        last = last * np.uint64(257) + np.where(w.end - k >= w.start, byte + np.uint64(1), np.uint64(0))
    return (mix(last) % np.uint64(ENDINGS)).astype(np.int64)


def _distinct(w: Words, at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(group, word, number): each word of ``at`` once in its group ``of``, lower-cased, by group."""
    order = np.lexsort((w.hash[at], of)) if of.any() else np.argsort(w.hash[at])
    at, of = at[order], of[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(of) != 0) | (w.hash[at][1:] != w.hash[at][:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    at, of = at[begin], of[begin]
    length = w.end[at] - w.start[at]
    offsets = np.concatenate([[0], np.cumsum(length)])
    data = w.data[np.arange(offsets[-1]) + np.repeat(w.start[at] - offsets[:-1], length)]
    data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.astype(np.uint8))])
    return of, words.cast(pa.string()), count


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (s for b in batches for s in slices(b, "text", COUNTED_BYTES)):
        w = words_of(batch.column("text"), SPACED_LOWER)
        _, words, count = _distinct(w, np.arange(len(w.hash)), np.zeros(len(w.hash), np.int8))
        yield pa.record_batch([words, pa.array(count)], ["word", "n"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = words_of(batch.column("word"), SPACED_LOWER)
        yield pa.record_batch([batch.column("word"), batch.column("c"), pa.array(w.hash.view(np.int64)), pa.array(endings(w))], ["word", "c", "hash", "ending"])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, hash, ending): how often each word stands in docs, lower-cased in A-Z, as a kept table."""
    words = docs.select("text").mapInArrow(_counted, "word string, n bigint")
    return kept(words.groupBy("word").agg(F.sum("n").alias("c")).mapInArrow(_hashed, "word string, c bigint, hash bigint, ending bigint"))


def _step(c: Column) -> Column:
    """Some thousand steps of frequency: each number while it is small, then 64 for each doubling."""
    return F.when(c < STEPS, c).otherwise(STEPS + F.floor(64 * F.log2(c / STEPS))).cast("long")


@dataclass
class Counts:
    """What tasks know of the training tokens: counts of the most frequent words, and totals."""

    hashes: np.ndarray  # of words, by falling frequency
    count: np.ndarray
    ends: int  # training documents
    tokens: int
    types: int
    frequency: np.ndarray  # of outcomes
    within: np.ndarray  # log10 of the counts of each outcome that is shared among words, with what is added; 0 for others

    @classmethod
    def of(cls, counts: DataFrame, documents: int) -> Counts:
        # words of the highest frequencies, by whole steps of frequency, as many as are known; no order over all words is needed
        step, left, least = _step(F.col("c")), KNOWN, None
        for at, n in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
            left -= n
            if left < 0:
                break
            least = at
        top = counts.filter(step >= F.lit(least)).select("hash", "c", "ending").toArrow().to_pandas().sort_values(["c", "hash"], ascending=[False, True])
        hashes, count, ending = top["hash"].to_numpy().view(np.uint64), top["c"].to_numpy(), top["ending"].to_numpy()[:FREQUENT]
        total, types = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
        for e, n, c in counts.groupBy("ending").agg(F.count("*"), F.sum("c")).collect():
            total[e], types[e] = c, n
        tokens, all_types = int(total.sum()) + documents, int(types.sum()) + (documents > 0)
        np.subtract.at(total, ending, count[:FREQUENT])
        np.subtract.at(types, ending, 1)
        outcome = np.zeros(OUTCOMES)
        outcome[: len(ending)] = count[:FREQUENT]
        outcome[FREQUENT:END] = total
        outcome[END] = documents
        within = np.zeros(OUTCOMES)
        within[FREQUENT:END] = np.log10(total + ADDED * (types + 1))
        outcome += ADDED
        return cls(hashes, count, documents, tokens, all_types, (outcome / outcome.sum()).astype(np.float32), within)


@dataclass
class Tokens:
    """The tokens of some texts: the words of each and its end."""

    words: Words
    number: np.ndarray  # of the words, by frequency; -1 where it is not known
    place: np.ndarray  # of the words among the tokens
    outcome: np.ndarray  # of the tokens
    first: np.ndarray  # token of each text, and one more

    @classmethod
    def of(cls, texts: pa.Array, index: HashIndex) -> Tokens:
        w = words_of(texts, SPACED_LOWER)
        n, number = w.counts(), index.find(w.hash)
        first = w.first + np.arange(len(n) + 1)
        place = np.arange(len(number)) + np.repeat(np.arange(len(n)), n)
        outcome = np.full(int(first[-1]), END)
        outcome[place] = np.where((number >= 0) & (number < FREQUENT), number, FREQUENT + endings(w))
        return cls(w, number, place, outcome, first)


_FIELDS = [f.name for f in fields(Model)]
_ROW = "part string, row int, met double, " + ", ".join(f"v{i} double" for i in range(WIDTH + 2))


def _rows(model: Model, met: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A model as rows of one vector each, with how often each was met; rows that were not are left out."""
    parts = {
        "context": np.column_stack([model.context, model.context_steps, np.zeros(OUTCOMES)]),
        "outcome": np.column_stack([model.outcome, model.outcome_steps, np.zeros(OUTCOMES)]),
        "bias": np.column_stack([model.bias, model.bias_steps, np.zeros((OUTCOMES, WIDTH))]),
        "matrix": np.column_stack([model.matrix.reshape(-1, WIDTH), np.repeat(model.matrix_steps, WIDTH), np.zeros(model.matrix.shape[0] * WIDTH)]),
    }
    for part, values in parts.items():
        at = np.flatnonzero(met[part])
        columns = [pa.array([part] * len(at)), pa.array(at.astype(np.int32)), pa.array(met[part][at].astype(np.float64)), *(pa.array(v) for v in (values[at] * met[part][at, None]).T.astype(np.float64))]
        yield pa.record_batch(columns, [x.split()[0] for x in _ROW.split(", ")])


def _train(model: Model, counts: Counts, seed: int):
    """Trains a copy of the model on the texts of a partition."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, index = model.copy(), HashIndex(counts.hashes[:FREQUENT])  # other words have classes without it
        r = np.random.default_rng([seed, TaskContext.get().partitionId()])
        met = {"context": np.zeros(OUTCOMES), "outcome": np.zeros(OUTCOMES)}
        tokens = 0
        for batch in (s for b in batches for s in slices(b, "text")):
            t = Tokens.of(batch.column("text"), index)
            before = contexts(t.outcome, t.first, END)
            own.learn_all(before, t.outcome, counts.frequency, r)
            met["context"] += np.bincount(before.ravel(), minlength=OUTCOMES)
            met["outcome"] += np.bincount(t.outcome, minlength=OUTCOMES)
            tokens += len(t.outcome)
        if tokens:
            yield from _rows(own, met | {"bias": met["outcome"], "matrix": np.full(model.matrix.shape[0] * WIDTH, tokens)})

    return train


def _averaged(model: Model, trained: DataFrame) -> Model:
    """The copies that partitions trained as one: each row is the mean of those that met it. The sums are made before anything is shuffled."""
    sums = trained.groupBy("part", "row").agg(F.sum("met").alias("met"), *(F.sum(f"v{i}").alias(f"v{i}") for i in range(WIDTH + 2))).toArrow().to_pandas()
    out = model.copy()
    for part, rows in sums.groupby("part"):
        at = rows["row"].to_numpy()
        values = (rows.iloc[:, 3:].to_numpy() / rows[["met"]].to_numpy()).astype(np.float32)
        if part == "bias":
            out.bias[at], out.bias_steps[at] = values[:, 0], values[:, 1]
        elif part == "matrix":
            out.matrix.reshape(-1, WIDTH)[at], out.matrix_steps[at // WIDTH] = values[:, :WIDTH], values[:, WIDTH]
        else:
            getattr(out, part)[at], getattr(out, part + "_steps")[at] = values[:, :WIDTH], values[:, WIDTH]
    return out


def fit(docs: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
    """The model after one pass over docs, in rounds."""
    model = Model.start(counts.frequency)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    for k in range(rounds):
        share = texts.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k)
        model = _averaged(model, share.mapInArrow(_train(model, counts, k), _ROW))
    return model


_SAID = T.StructType([T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")] + [T.StructField(c, T.DoubleType()) for c in ("base", "score")])
_RARE = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]))


def _score(model: Model, counts: Counts, text: str):
    """Of every text, what the frequent words and the model say; and its other words, with their counts. Other columns go along."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = HashIndex(counts.hashes)
        log_count = np.append(np.log10(counts.count + ADDED), 0.0)  # the last: words that are not known here
        for batch in (s for b in batches for s in slices(b, text)):
            t = Tokens.of(batch.column(text), index)
            n = np.diff(t.first)
            docs = np.repeat(np.arange(len(n)), n)
            log = model.log_probability(contexts(t.outcome, t.first, END), t.outcome) / np.log(10)
            base = log_count[t.number]
            log[t.place] += np.where(t.outcome[t.place] >= FREQUENT, base, 0)
            log -= counts.within[t.outcome]
            of = docs[t.place]
            known = np.bincount(of, weights=t.number >= 0, minlength=len(n)).astype(np.int64) + (counts.ends > 0)
            base_sum = np.bincount(of, weights=base, minlength=len(n)) + np.log10(counts.ends + ADDED)
            said = pa.StructArray.from_arrays([pa.array(n), pa.array(known), pa.array(base_sum), pa.array(np.bincount(docs, weights=log, minlength=len(n)))], _SAID.names)
            rest = [c for c in batch.schema.names if c != text]
            yield pa.record_batch([*(batch.column(c) for c in rest), said, _rare(t, of, len(n))], [*rest, "said", "rare"])

    return score


def _rare(t: Tokens, of: np.ndarray, docs: int) -> pa.ListArray:
    """The words of each text that are not known, each once with its number."""
    at = np.flatnonzero(t.number < 0)
    group, words, count = _distinct(t.words, at, of[at])
    each = pa.StructArray.from_arrays([words, pa.array(count)], ["word", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(docs + 1)).astype(np.int32)), each)


def score_texts(docs: DataFrame, training: Column, text: str = "text") -> DataFrame:
    """docs without their texts, with a column ``__m`` (n_tokens, n_known, train_tokens, base_score, score), learned from the rows
    where ``training`` holds."""
    docs = docs.drop("__m")
    learned = docs.filter(training).select(F.col(text).alias("text"))
    words = count_words(learned)
    counts = Counts.of(words, learned.count())
    model = fit(learned, counts)
    row, said, rare = (fresh(docs, c) for c in ("__row", "__said", "__rare"))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())  # written once with what is said of each row, so it stays
    plain = [f for f in numbered.schema.fields if f.name != text]
    schema = T.StructType([*plain, T.StructField(said, _SAID), T.StructField(rare, _RARE)])
    scored = kept(numbered.mapInArrow(_score(model, counts, text), schema))
    each = scored.select(F.col(row).alias("row"), F.explode(rare).alias("x")).select("row", "x.word", "x.n")
    log = F.log10(F.coalesce("c", F.lit(0)) + ADDED)
    more = each.join(words.select("word", "c"), "word", "left").groupBy("row").agg(F.sum(F.col("n") * log).alias("log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"))
    more = more.select(F.col("row").alias(row), F.struct("log", "known").alias(rare))
    unit = float(np.log10(counts.tokens + ADDED * (counts.types + 1)))
    n, log = F.col(f"{said}.n_tokens"), F.coalesce(F.col(f"{rare}.log"), F.lit(0.0))
    found = F.struct(
        n.alias("n_tokens"), (F.col(f"{said}.n_known") + F.coalesce(F.col(f"{rare}.known"), F.lit(0))).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col(f"{said}.base") + log - n * unit).alias("base_score"), (F.col(f"{said}.score") + log).alias("score"),
    )
    return scored.drop(rare).join(more, row, "left").withColumn("__m", found).drop(row, said, rare)


def op11_language_model(spark, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out.alias("held_out"))
    return score_texts(docs, ~F.col("held_out")).select("doc_id", "held_out", "__m.*")
