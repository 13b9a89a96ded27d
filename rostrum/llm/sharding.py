"""K-d tree sharding: recursive splits at distributed weighted medians.

Every node is split along the metadata dimension in which it is widest (its
range over the dimension's whole range), where the bytes left of the split are
its share of the leaves. The medians of all nodes of a level are found together:
bytes are summed into bins of each node's current interval, and the interval is
narrowed to the bin that holds the median, until the bin is one value or
weighs next to nothing. A value that many rows share (one source with a third
of them) is split further by a hash of the document, and equal rows by a hash of
their row number. The driver sees bins, never rows: about :data:`BINS` for all
nodes of a level together, and :data:`LEAST_BINS` for each at least.

Rows are numbered once, in a table in the shared folder, so that all passes agree
on them. Leaves are numbered from left to right. Slots are gapless in each leaf: a
leaf's rows are dealt to hash groups of about :data:`GROUP_ROWS`, the groups are
counted, and a row's slot is its group's offset plus its rank there, so no leaf
meets in one task.

Law: ``bytes`` (leaves have near equal sizes). A row's size is the UTF-8 bytes
of its text plus one. Equal texts are a group of the report only: the law weighs
rows, so copies may go to several shards.

Defined results: a null text has no bytes (size 1, checksum 0); null metadata
sorts first; equal texts are separate rows, and so are equal rows, with or without
doc_id: they can go to both sides of a split; very long texts count by their bytes
and are never cut; an empty table gives an empty result; other columns are left
alone, but for one named ``__s``, which the result replaces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rostrum.llm.shared import kept

BINS, LEAST_BINS = 1 << 16, 1024
#: Language, source, size, doc_id.
DIMENSIONS = 4
#: A bin with no more of its node's bytes than this ends the search.
FINE = 1e-6
GROUP_ROWS = 4096
#: Low bits of a row's tie that come from its number.
ROW_BITS = 22


def text_rank(c: str) -> Column:
    """The first 7 bytes of a string as a number that sorts as they do; null: -1."""
    head = F.substring(F.concat(F.col(c).cast("string").cast("binary"), F.lit(b"\0" * 7)), 1, 7)
    return F.coalesce(F.conv(F.hex(head), 16, 10).cast("long"), F.lit(-1).cast("long"))


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def numbered(docs: DataFrame, size: Column | None = None, checksum: Column | None = None) -> DataFrame:
    """The rows of docs, kept: ``__row`` (all columns, so that no name clashes) and ``__k``: size, dims (array of numbers) and tie
    (hashes of the document and, below, of the row's number)."""
    size = size_of() if size is None else size
    checksum = F.crc32(F.coalesce("text", F.lit("")).cast("binary")) if checksum is None else checksum
    long = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long"))
    dims = F.array(text_rank("lang"), text_rank("source"), size, long("doc_id"))
    of_row = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(3)), F.lit(1 << ROW_BITS))
    tie = F.shiftleft(F.shiftrightunsigned(F.xxhash64("doc_id", checksum), 2 + ROW_BITS), ROW_BITS) + of_row
    return kept(docs.select(F.struct("*").alias("__row"), F.struct(size.alias("size"), dims.alias("dims"), tie.alias("tie")).alias("__k")))


@dataclass
class Node:
    """An inner node or leaf: what it holds, and where it is split."""

    leaves: int
    first: int  # its first leaf
    size: int = 0
    dim: int = -1
    value: int = 0  # rows go left if (dims[dim], tie) <= (value, tie)
    tie: int = 0


#: Nodes up to which their numbers are literals of the plan; more are joined as a table, which is as long as the list of leaves.
LITERAL_NODES = 256


def _of_node(df: DataFrame, name: str, fields: list[str], values: dict[int, tuple], joined: bool = False) -> DataFrame:
    """df with a struct column of longs that belong to each row's node ``__n``; null for other nodes."""
    if len(values) <= LITERAL_NODES and not joined:
        pairs = [x for k, v in values.items() for x in (F.lit(k), F.struct(*[F.lit(int(y)).cast("long").alias(f) for f, y in zip(fields, v, strict=True)]))]
        return df.withColumn(name, F.create_map(*pairs)[F.col("__n")])
    columns = [pa.array(list(values), pa.int32()), *[pa.array([int(v[i]) for v in values.values()], pa.int64()) for i in range(len(fields))]]
    local = df.sparkSession.createDataFrame(pa.table(columns, ["__n", *fields])).select("__n", F.struct(*fields).alias(name))
    return df.join(local, "__n", "left")


def _descend(keyed: DataFrame, levels: list[dict[int, Node]]) -> DataFrame:
    """keyed with ``__n``: the number of the node each row is in; children of node k are 2k+1 and 2k+2, a leaf stays."""
    nodes = {k: n for level in levels for k, n in level.items()}

    def place(k: int) -> Column:
        n = nodes.get(k)
        if n is None:
            return F.lit(k)
        v = F.get("__k.dims", F.lit(n.dim))
        left = (v < n.value) | ((v == n.value) & (F.col("__k.tie") <= n.tie))
        return F.when(left, place(2 * k + 1)).otherwise(place(2 * k + 2))

    if len(nodes) <= LITERAL_NODES:
        return keyed.withColumn("__n", place(0))
    out = keyed.withColumn("__n", F.lit(0))
    for level in levels:
        out = _of_node(out, "__cut", ["dim", "value", "tie"], {k: (n.dim, n.value, n.tie) for k, n in level.items()}, joined=True)
        v = F.get("__k.dims", F.col("__cut.dim").cast("int"))
        left = (v < F.col("__cut.value")) | ((v == F.col("__cut.value")) & (F.col("__k.tie") <= F.col("__cut.tie")))
        out = out.withColumn("__n", F.when(F.col("__cut").isNull(), F.col("__n")).when(left, 2 * F.col("__n") + 1).otherwise(2 * F.col("__n") + 2)).drop("__cut")
    return out


def _narrow(at: DataFrame, spans: dict[int, tuple[int, int, int, float]], value: Column) -> dict[int, tuple[int, int, int, int, bool]]:
    """One pass of bins. spans: by node its dimension, interval (both ends in it), and bytes wanted left of the split within the interval.
    Gives the bin of the median: its interval, bytes before it, its bytes, and whether it is one value."""
    bins = max(LEAST_BINS, BINS // len(spans))
    width = {k: (hi - lo) // bins + 1 for k, (_, lo, hi, _) in spans.items()}
    inside = _of_node(at, "__span", ["dim", "lo", "hi", "width"], {k: (*v[:3], width[k]) for k, v in spans.items()}).filter("__span is not null")
    binned = inside.withColumn("__x", value).filter("__x between __span.lo and __span.hi").withColumn("__b", F.expr("(__x - __span.lo) div __span.width"))
    sums: dict[int, list[tuple[int, int]]] = {}
    for r in binned.groupBy("__n", "__b").agg(F.sum("__k.size").alias("w")).collect():
        sums.setdefault(r["__n"], []).append((r["__b"], r["w"]))
    out = {}
    for k, (_, lo, hi, want) in spans.items():
        before = 0
        for b, w in sorted(sums.get(k, [])):
            if before + w >= want:
                out[k] = (lo + b * width[k], min(hi, lo + (b + 1) * width[k] - 1), before, w, width[k] == 1)
                break
            before += w
        else:
            out[k] = (hi, hi, before, 0, True)
    return out


def build(meta: DataFrame, leaves: int, total: int) -> list[dict[int, Node]]:
    """The inner nodes of each level. meta: rows with ``__k``; total: their bytes."""
    level: dict[int, Node] = {0: Node(leaves, 0, int(total))}
    whole: list[int] = []
    levels: list[dict[int, Node]] = []
    while any(n.leaves > 1 for n in level.values()):
        nodes = {k: n for k, n in level.items() if n.leaves > 1}
        at = _descend(meta, levels)
        ranges = {r["__n"]: r for r in at.groupBy("__n").agg(*[f(F.get("__k.dims", F.lit(i))).alias(f"{name}{i}") for i in range(DIMENSIONS) for f, name in ((F.min, "lo"), (F.max, "hi"))]).collect()}
        if not whole and 0 in ranges:
            whole = [max(1, ranges[0][f"hi{i}"] - ranges[0][f"lo{i}"]) for i in range(DIMENSIONS)]
        spans, want = {}, {}
        for k, n in nodes.items():
            want[k] = n.size * ((n.leaves + 1) // 2) / n.leaves
            if k in ranges:
                n.dim = max(range(DIMENSIONS), key=lambda i, r=ranges[k]: (r[f"hi{i}"] - r[f"lo{i}"]) / whole[i])
                spans[k] = (n.dim, ranges[k][f"lo{n.dim}"], ranges[k][f"hi{n.dim}"], want[k])
            else:
                n.dim, n.value, n.tie = 0, -2, 0
        left = dict.fromkeys(nodes, 0)
        only: dict[int, int] = {}  # nodes whose value is found, and whose documents are told apart by their hashes now
        while spans:  # values and ties of all nodes in the same passes
            v = F.get("__k.dims", F.col("__span.dim").cast("int"))
            if only:
                tied = _of_node(at, "__only", ["v"], {k: (x,) for k, x in only.items()})
                found = _narrow(tied, spans, F.when(F.col("__only").isNull(), v).when(F.get("__k.dims", F.col("__span.dim").cast("int")) == F.col("__only.v"), F.col("__k.tie")))
            else:
                found = _narrow(at, spans, v)
            for k, (lo, hi, before, w, single) in found.items():
                n = nodes[k]
                dim, _, _, wanted = spans.pop(k)
                left[k] += before
                if k in only:
                    if single or w <= FINE * n.size:
                        inside = wanted - before > w / 2  # the nearer side
                        n.tie = hi if inside else lo - 1
                        left[k] += w * inside
                    else:
                        spans[k] = (dim, lo, hi, wanted - before)
                elif single or lo == hi:
                    n.value = only[k] = lo
                    spans[k] = (dim, 0, (1 << 62) - 1, wanted - before)
                elif w <= FINE * n.size:
                    n.value, n.tie = hi, (1 << 62)
                    left[k] += w
                else:
                    spans[k] = (dim, lo, hi, wanted - before)
        levels.append(nodes)
        level = {}
        for k, n in nodes.items():
            half = (n.leaves + 1) // 2
            level[2 * k + 1] = Node(half, n.first, int(left[k]))
            level[2 * k + 2] = Node(n.leaves - half, n.first + half, n.size - int(left[k]))
    return levels


def _leaf_numbers(levels: list[dict[int, Node]]) -> dict[int, int]:
    out = {} if levels else {0: 0}
    for nodes in levels:
        for k, n in nodes.items():
            half = (n.leaves + 1) // 2
            if half == 1:
                out[2 * k + 1] = n.first
            if n.leaves - half == 1:
                out[2 * k + 2] = n.first + half
    return out


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, size: Column | None = None, checksum: Column | None = None) -> DataFrame:
    """docs with ``__s``: shard (from 0) and slot (gapless in each shard). shards: how many; else as many as leave target_bytes in each.
    size and checksum: of a row, where docs has no text."""
    docs = docs.drop("__s")
    keyed = numbered(docs, size, checksum)
    meta = keyed.select("__k")  # the passes read sizes and keys only
    whole = meta.agg(F.sum("__k.size").alias("bytes"), F.count("*").alias("rows")).first()
    if shards is None:
        shards = max(1, math.ceil((whole.bytes or 0) / (target_bytes or 1 << 30)))
    levels = build(meta, shards, whole.bytes or 0)
    leaves = {k: (v,) for k, v in _leaf_numbers(levels).items()}
    in_leaf = lambda df: _of_node(_descend(df, levels), "__l", ["leaf"], leaves).withColumn("__leaf", F.col("__l.leaf").cast("int")).drop("__l")
    group = F.pmod(F.xxhash64("__k.tie"), F.lit(max(1, -(-whole.rows // (shards * GROUP_ROWS))))).cast("long")
    counted = in_leaf(meta).groupBy("__leaf", group.alias("__g")).agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("__leaf").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counted.select("__leaf", "__g", before.alias("__before"))
    dealt = in_leaf(keyed).withColumn("__g", group)
    rank = F.row_number().over(Window.partitionBy("__leaf", "__g").orderBy("__k.tie"))
    out = dealt.withColumn("__r", rank).join(offsets, ["__leaf", "__g"])
    return out.withColumn("__s", F.struct(F.col("__leaf").alias("shard"), (F.col("__before") + F.col("__r") - 1).alias("slot"))).select("__row.*", "__s")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder per shard, rows in slot order within each file."""
    done = shard(docs, **options)
    done.select(*docs.columns, "__s.shard", "__s.slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_kd_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    sized = docs.select("doc_id", "lang", "source", size_of().alias("size"), crc.alias("text_crc32"))  # texts are not moved
    done = shard(sized, shards=16, size=F.col("size"), checksum=F.col("text_crc32"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "__s.shard", "__s.slot", F.lit(None).cast("int").alias("grown_shard"))
