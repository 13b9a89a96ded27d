"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word is a run of letters (ASCII ones in lower case, and all bytes beyond
ASCII) between boundary marks; its subwords are its byte 2-, 3- and 4-grams,
marks included. Each is hashed to a row of an embedding table; a text is the
average of its subwords, followed by a linear softmax. Both are trained
together by stochastic gradient descent in numpy on a bounded sample of
labelled texts (``per_language`` rows of each language, chosen by a hash of
doc_id). Scores are calibrated by a temperature on texts kept out of the
training, and the rejection threshold is the least score above which at most
``REJECT_ERROR`` of those are wrong.

Since the softmax is linear, embeddings and weights fold into one table of
logits per subword, and a batch of texts is scored by array operations over its
byte buffer.

Defined results: null or letterless texts give ``und`` with score 0; with no
labelled rows every text does; ties go to the first language by name; repeated
rows are learned from once and get equal results; very long texts are read whole;
an empty table gives an empty result; other columns are left alone, but for one
named ``__g``, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rostrum.llm.words import chunks, text_buffers

BUCKET_BITS, DIMENSIONS = 15, 16
BUCKETS = 1 << BUCKET_BITS
PER_LANGUAGE = 250
#: Rows that are looked at for each that is taken, as some repeat others.
SPARE = 20
EPOCHS, RATE = 3, 8.0
REJECT_ERROR = 0.01
CHUNK_BYTES = 1 << 20
MARK = 32
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else MARK for b in range(256)], np.uint32)
_ODD = np.array([0, 0, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def subwords(texts: pa.Array) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """Where each text starts in the marked byte stream (one more at the end), and by length of n-gram its table row at every place of the stream; BUCKETS where there is none."""
    data, offsets = text_buffers(texts)
    n = len(texts)
    stream = np.full(len(data) + n + 2, MARK, np.uint32)
    stream[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = _FOLD[data]
    word = stream != MARK

    def rows() -> Iterator[np.ndarray]:
        code = stream[:-1] * np.uint32(256) + stream[1:]
        yield np.where(word[:-1] | word[1:], (code * _ODD[2]) >> np.uint32(32 - BUCKET_BITS), np.uint32(BUCKETS))
        inner = word[1:-1]
        code = code[:-1] * np.uint32(256) + stream[2:]
        yield np.where(inner, (code * _ODD[3]) >> np.uint32(32 - BUCKET_BITS), np.uint32(BUCKETS))
        code = code[:-1] * np.uint32(256) + stream[3:]
        yield np.where(inner[:-1] & inner[1:], (code * _ODD[4]) >> np.uint32(32 - BUCKET_BITS), np.uint32(BUCKETS))

    return offsets + np.arange(n + 1), rows()


def pieces_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct table rows of each text and their shares."""
    out = []
    for text in texts:
        ids = np.concatenate(list(subwords(pa.array([text], pa.string()))[1]))
        rows, times = np.unique(ids[ids < BUCKETS], return_counts=True)
        out.append((rows, times / max(1, times.sum())))
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits of each subword row, by language; the last row is of no subword
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages), and how many subwords each text has."""
        sums, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        if len(texts):
            starts, grams = subwords(texts)
            for ids in grams:
                at = np.minimum(starts[:-1], len(ids) - 1)
                for k in range(len(self.languages)):
                    sums[:, k] += np.add.reduceat(self.table[:, k][ids], at)
                count += np.add.reduceat((ids < BUCKETS).astype(np.float64), at)
        return sums / np.maximum(count, 1)[:, None] + self.bias, count

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        x, count = self.logits(texts)
        p = softmax(x / self.temperature)
        best = p.argmax(axis=1)
        lang = [self.languages[k] for k in best.tolist()]
        score = p[np.arange(len(p)), best]
        data, offsets = text_buffers(texts)
        ascii_letters = np.concatenate([[0], np.cumsum((_FOLD[data] != MARK) & (data < 128))])
        for i in np.flatnonzero(np.diff(ascii_letters[offsets]) == 0):  # letters, if any, are beyond ASCII
            if not (texts[i].is_valid and any(c.isalpha() for c in texts[i].as_py())):
                lang[i], score[i] = "und", 0.0
        return lang, score


def train(texts: list[str], langs: list[str], seed: int = 5, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Fit on all words of the texts, in runs of 4 to 60; a fifth of the texts calibrates."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    code = {x: i for i, x in enumerate(languages)}
    parts, labels, held, truth = [], [], [], []
    for text, lang in zip(texts, langs, strict=True):
        if rng.random() < 0.2:
            held.append(text)
            truth.append(code[lang])
            continue
        tokens, at = text.split(), 0
        while at < len(tokens):
            n = int(rng.integers(4, 61))
            parts.append(" ".join(tokens[at : at + n]))
            labels.append(code[lang])
            at += n
    pieces = pieces_of(parts)
    k = len(languages)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weight, bias = rng.normal(0, 0.3, (k, DIMENSIONS)), np.zeros(k)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(pieces)):
            rows, share = pieces[i]
            v = share @ embed[rows]
            g = softmax(weight @ v + bias)
            g[labels[i]] -= 1.0
            back = weight.T @ g
            weight -= 0.05 * step * np.outer(g, v)
            bias -= 0.005 * step * g
            embed[rows] -= step * share[:, None] * back
    table = np.zeros((BUCKETS + 1, k), np.float32)
    table[:BUCKETS] = embed @ weight.T
    model = Model(languages, np.asfortranarray(table), bias)
    x, count = model.logits(pa.array(held, pa.string()))
    x, y = x[count > 0], np.array(truth, np.int64)[count > 0]
    if len(y):
        loss = lambda t: -np.log(softmax(x / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 41), key=loss))
        p = softmax(x / model.temperature)
        score, right = p.max(axis=1), p.argmax(axis=1) == y
        order = np.argsort(-score, kind="stable")
        good = np.cumsum(~right[order]) <= REJECT_ERROR * np.arange(1, len(order) + 1)
        model.threshold = float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def held_out() -> Column:
    """The rows that training never sees: crc32 of doc_id, as text, leaves 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 5) -> Model:
    """Train on at most ``per_language`` rows of each language, those with the least hashes."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    unsigned = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 1)  # of 63 bits
    drawn = labelled.select("text", "lang", unsigned.alias("draw"))
    # all but a few of the least hashes are passed over at the scan; equal rows have equal hashes and are taken once
    counts = F.broadcast(labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(SPARE * per_language) / F.count("*")).alias("share")))
    near = drawn.join(counts, "lang").filter(F.col("draw") < F.col("share") * float(1 << 63)).drop("share")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    hashes = near.select("lang", "draw").distinct().withColumn("place", place).filter(F.col("place") <= per_language).select("lang", "draw")
    chosen = near.join(F.broadcast(hashes), ["lang", "draw"], "left_semi").dropDuplicates(["lang", "draw"]).collect()
    chosen.sort(key=lambda r: (r.lang, r.draw))
    return train([r.text for r in chosen], [r.lang for r in chosen], seed)


_OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column ``__g``: lang_pred, score, and accepted (whether the score passes the rejection threshold)."""
    docs = docs.drop("__g")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_OUT)
    def guess(texts: pa.Array) -> pa.Array:
        m, langs, scores = shared.value, [], []
        for part in chunks(texts, CHUNK_BYTES):
            lang, score = m.predict(part)
            langs += lang
            scores.append(score)
        score = np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score), pa.array((score >= m.threshold) & (score > 0))], ["lang_pred", "score", "accepted"])

    return docs.withColumn("__g", guess("text"))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs)
    done = identify(docs.select("doc_id", "text"), model)
    return done.select("doc_id", held_out().alias("held_out"), "__g.lang_pred", "__g.score", "__g.accepted")
