"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length (in words) per source. Each source's
budget is first met by whole passes over the source and an even share of every
length; bounded-knapsack dynamic programming over the lengths that are left
then fits the remaining budget to the word. Documents are chosen by that count:
within a length, a seeded hash orders them.

The rows of one length are dealt to hash cells, by the number of all rows, and each cell is
told how many of its documents to take, so a length that holds a third of all
rows is no hot key. The programme itself sees one row per distinct length of a
source. The driver sees one row per source: a mixture's sources are a list that
people set weights for.

Defined results: a null or wordless text has size 0 and is never taken; a null
source is one source, the last; ties in length are broken by the seeded hash,
then doc_id; repeated rows count and are taken as rows; very long texts count by
their words and are taken whole or not at all; an empty table gives an empty
result; other columns are left alone, but for one named ``__m``, which the result
replaces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rostrum.llm.shared import checkpoint_folder

WEIGHTS, SHARE, MOST_PASSES = (5.0, 2.0, 1.0), 1.5, 2
#: Rows of a cell, about, if all had one length.
CELL_ROWS = 20_000
#: Words of the budget that are left to the dynamic programme, at most (and two of the longest documents, if they are longer):
#: even shares of every length take the rest, so this bounds the programme's table and not what is mixed.
DP_WORDS = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> dict[str | None, float]:
    """Words to take from each source. Weights repeat over the sources in code-point order, null last; what a source cannot take is shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out = dict.fromkeys(names, 0.0)
    left, free = share * sum(sizes.values()), names
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        free = [s for s in free if s not in set(full)]
    return out


def knapsack(size: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take so that their sum is the largest within the budget."""
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by = np.full(budget + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i in np.argsort(size, kind="stable"):
        left, step = int(min(count[i], budget // max(1, size[i]))), 1
        while left and not reached[budget]:  # parts of 1, 2, 4 ... documents
            part = min(step, left)
            w = int(size[i]) * part
            new = np.flatnonzero(reached[: budget + 1 - w] & ~reached[w:]) + w
            by[new] = len(items)
            reached[new] = True
            items.append((int(i), part))
            left, step = left - part, step * 2
        if reached[budget]:
            break
    take = np.zeros(len(size), np.int64)
    s = int(np.flatnonzero(reached)[-1])
    while s:
        i, part = items[by[s]]
        take[i] += part
        s -= int(size[i]) * part
    return take


def fit(size: np.ndarray, count: np.ndarray, target: float, most: int = MOST_PASSES) -> np.ndarray:
    """Copies to take of each length (at most ``most`` times its count), with words as near below the target as can be."""
    total = int((size * count).sum())
    budget = min(int(round(target)), most * total)
    if not total or budget <= 0:
        return np.zeros(len(size), np.int64)
    passes = budget // total
    rest = budget - passes * total
    share = count * (rest / total)
    take = np.minimum(np.floor(share).astype(np.int64), count)
    left, rest = np.where(size > 0, count - take, 0), rest - int((size * take).sum())
    width = max(1, min(DP_WORDS, 2 * int(size.max())))
    for i in np.argsort(-size, kind="stable"):  # what the shares' fractions left over, down to what the programme takes
        if rest <= width:
            break
        k = int(min(left[i], (rest - width) // max(1, size[i])))
        take[i] += k
        left[i] -= k
        rest -= k * int(size[i])
    return passes * count + take + knapsack(size, left, rest)


def mix(docs: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """docs with a column ``__m``: size, source_size, target, and copies (how often the mix takes the row)."""
    spark = docs.sparkSession
    checkpoint_folder(spark)
    docs = docs.drop("__m")
    cells_each = max(16, -(-docs.count() // CELL_ROWS))
    hashed = F.xxhash64("doc_id", F.lit(seed))
    # the row rides in one column, so that no name clashes
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("s"), word_count(F.col("text")).alias("n"), hashed.alias("h"), F.pmod(hashed, F.lit(cells_each)).alias("c"))
    cells = keyed.groupBy("s", "n", "c").agg(F.count("*").alias("docs")).checkpoint()
    sizes = {r.s: int(r.words) for r in cells.groupBy("s").agg(F.sum(F.col("n") * F.col("docs")).alias("words")).collect()}
    aim = targets(sizes, weights, share, most)

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        source = rows["s"].iloc[0]
        source = None if pd.isna(source) else source
        copies = fit(rows["n"].to_numpy(), rows["docs"].to_numpy(), aim[source], most)
        return pd.DataFrame({"s": [source] * len(rows), "n": rows["n"], "passes": copies // rows["docs"], "extra": copies % rows["docs"], "source_size": sizes[source], "target": aim[source]})

    lengths = cells.groupBy("s", "n").agg(F.sum("docs").alias("docs"))
    planned = lengths.groupBy("s").applyInPandas(plan, "s string, n bigint, passes bigint, extra bigint, source_size bigint, target double")
    c, p = cells.alias("c"), planned.alias("p")
    before = F.sum("c.docs").over(Window.partitionBy("c.s", "c.n").orderBy("c.c").rowsBetween(Window.unboundedPreceding, -1))
    allotted = c.join(p, F.col("c.s").eqNullSafe(F.col("p.s")) & (F.col("c.n") == F.col("p.n"))).select("c.s", "c.n", "c.c", F.struct("p.passes", "p.source_size", "p.target", (F.col("p.extra") - F.coalesce(before, F.lit(0))).alias("extra")).alias("p"))
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("s", "n", "c").orderBy("h", "id"))).alias("k")
    a = allotted.alias("a")
    joined = ranked.join(a, F.col("k.s").eqNullSafe(F.col("a.s")) & (F.col("k.n") == F.col("a.n")) & (F.col("k.c") == F.col("a.c")))
    copies = F.when(F.col("k.n") == 0, F.lit(0).cast("long")).otherwise(F.col("a.p.passes") + F.when(F.col("k.r") <= F.col("a.p.extra"), 1).otherwise(0))
    return joined.withColumn("__m", F.struct(F.col("k.n").alias("size"), F.col("a.p.source_size").alias("source_size"), F.col("a.p.target").alias("target"), copies.alias("copies"))).select("k.row.*", "__m")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of docs."""
    done = mix(docs, **options).filter("__m.copies > 0")
    names = [c for c in docs.columns if c != "__m"]
    return done.select(F.struct(*names).alias("row"), F.explode(F.sequence(F.lit(1), F.col("__m.copies").cast("int")))).select("row.*")


def op4_mix_to_weights(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "__m.size", "__m.source_size", "__m.target", (F.col("__m.size") * F.col("__m.copies")).alias("taken"))
