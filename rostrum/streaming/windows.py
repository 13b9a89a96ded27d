"""Anchored windows over streams whose requests arrive late and out of order: rate limits, single notifications, cooldowns.

A window starts at the first request after the one before has ended, so what a request is worth depends on all before it. Requests
therefore wait in the state of their key until the watermark has passed them, and are then settled in the order of their times, as
the batch plan does (:func:`rostrum.operators.jobs.anchored_windows`). A key has requests that wait, and the start and count of its
window; these are cleared once the window is over, so quiet keys keep nothing. Keys are dealt to a fixed number of cells, and the state
is that of a cell, with one timer: a batch costs a few calls for each cell, and all of a cell's keys are settled at once.

Defined: a request that is later than the watermark allows is not counted and has no row; requests without a time are left out;
of equal times, all are counted in any order; a key of null is a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Cells of keys: what a state is kept for.
CELLS = 256
#: Partitions of the state for each core, at most: every batch opens a store for each of them.
STATE_TASKS = 2
#: Keys that are neither text nor whole numbers go through the state as JSON that gives them back.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settled(times: np.ndarray, span: int, start: int | None, n: int) -> tuple[np.ndarray, np.ndarray, int | None, int]:
    """(starts, numbers, start, n): the windows of sorted times, and the window that goes on. start, n: the window before."""
    starts, numbers = np.empty_like(times), np.empty_like(times)
    i = 0
    while i < len(times):
        if start is None or start < times[i] - span:
            start, n = int(times[i]), 0
        j = i + int(np.searchsorted(times[i:], start + span, "right"))
        starts[i:j], numbers[i:j] = start, np.arange(n + 1, n + j - i + 1)
        n, i = n + j - i, j
    return starts, numbers, start, n


def settled_keys(code: np.ndarray, times: np.ndarray, span: int, begun: np.ndarray, start: np.ndarray, n: np.ndarray):
    """(starts, numbers, begun, start, n): :func:`settled` of many keys at once. code: the key of each time, from 0, sorted by key and
    time; begun, start, n: of each key, whether it has a window, and which; of its last window after."""
    count = len(begun)
    first = np.searchsorted(code, np.arange(count + 1))
    begin, end = first[:-1], first[1:]
    own = begun[code] & (times <= start[code] + span)  # goes on with the window before
    at = begin + np.bincount(code[own], minlength=count)
    # the first time after the window that each one would start: all times and all ends in one order, a time before an end it equals
    order = np.lexsort((np.repeat([0, 1], len(times)), np.concatenate([times, times + span]), np.concatenate([code, code])))
    passed = np.cumsum(order < len(times))
    after = np.empty(len(times), np.int64)
    ends = order >= len(times)
    after[order[ends] - len(times)] = passed[ends]
    opens = np.zeros(len(times), bool)
    at, end_of = at[at < end], end[at < end]
    while len(at):
        opens[at] = True
        at = after[at]
        at, end_of = at[at < end_of], end_of[at < end_of]
    place = np.arange(len(times))
    opened = np.maximum.accumulate(np.where(opens, place, -1))
    starts = np.where(own, start[code], times[np.maximum(opened, 0)])
    numbers = np.where(own, n[code] + place - begin[code] + 1, place - opened + 1)
    some, last = end > begin, end[end > begin] - 1
    start, n = start.copy(), n.copy()
    start[some], n[some] = starts[last], numbers[last]
    return starts, numbers, begun | some, start, n


_WAITING = pa.schema([("k", pa.string()), ("t", pa.int64())])
_WINDOWS = pa.schema([("k", pa.string()), ("start", pa.int64()), ("n", pa.int64())])


def _packed(table: pa.Table) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(rows, schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(bytes(data)).read_all() for (data,) in rows] or [schema.empty_table()])


class AnchoredWindows(StatefulProcessor):
    """State of a cell: the requests of its keys that wait, (start, n) of the windows of its keys, and when its timer is due; all in
    microseconds, but for the timer's milliseconds."""

    def __init__(self, seconds: int):
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.window = handle.getValueState("window", "rows binary")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([x[["k", "t"]] for x in rows])
        self.waiting.appendList([_packed(pa.Table.from_pandas(new, _WAITING, preserve_index=False))])
        due = -(-int(new["t"].min()) // 1000)  # the watermark is past the first of them then
        before = self.due.get()[0] if self.due.exists() else None
        if before is None or due < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.due.update((due,))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = _unpacked(self.waiting.get() if self.waiting.exists() else [], _WAITING)
        windows = _unpacked([self.window.get()] if self.window.exists() else [], _WINDOWS)
        now, later = waiting.filter(pc.less_equal(waiting["t"], passed)), waiting.filter(pc.greater(waiting["t"], passed))
        # a code for each key; null is one
        keys = pa.chunked_array([*windows["k"].chunks, *now["k"].chunks], pa.string()).combine_chunks().dictionary_encode("encode")
        codes, names = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64), keys.dictionary
        had = codes[: len(windows)]
        begun, start, n = np.zeros(len(names), bool), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        begun[had], start[had], n[had] = True, windows["start"].to_numpy(), windows["n"].to_numpy()
        code, times = codes[len(windows) :], now["t"].to_numpy()
        order = np.lexsort((times, code))
        code, times = code[order], times[order]
        starts, numbers, begun, start, n = settled_keys(code, times, self.span, begun, start, n)
        dues = []
        if len(now):
            self.waiting.clear()
            if len(later):
                self.waiting.appendList([_packed(later)])
            yield pd.DataFrame({"k": names.take(pa.array(code)).to_pandas(), "t": times, "start": starts, "n": numbers})
        if len(later):
            dues.append(-(-pc.min(later["t"]).as_py() // 1000))
        open_ = np.flatnonzero(begun & (start + self.span >= passed))  # whatever comes to the others starts a window
        if len(open_):
            self.window.update(_packed(pa.table([names.take(pa.array(open_)), start[open_], n[open_]], schema=_WINDOWS)))
            dues.append(-(-(int(start[open_].min()) + self.span + 1000) // 1000))
        else:
            self.window.clear()
        if dues:
            self.handle.registerTimer(min(dues))
            self.due.update((min(dues),))
        else:
            self.due.clear()

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def anchored_stream(requests: DataFrame, key: str, ts: str, seconds: int, lateness: str) -> DataFrame:
    """(key, ts, window_start, n) of every request of a stream that is late by ``lateness`` at most."""
    use_rocksdb(requests.sparkSession)
    kind, time_kind = requests.schema[key].dataType, requests.schema[ts].dataType
    at = F.col(ts).cast("timestamp")
    if isinstance(kind, (T.StringType, T.IntegralType)):
        text, value = F.col(key).cast("string"), F.col("k").cast(kind)
    else:
        text = F.when(F.col(key).isNotNull(), F.to_json(F.struct(F.col(key).alias("v")), _EXACT))
        value = F.from_json("k", T.StructType([T.StructField("v", kind)]), _EXACT)["v"]
    timed = requests.filter(F.col(ts).isNotNull()).select(F.pmod(F.xxhash64(text), F.lit(CELLS)).alias("cell"), text.alias("k"), at.alias("__at"), F.unix_micros(at).alias("t"))
    out = timed.withWatermark("__at", lateness).groupBy("cell").transformWithStateInPandas(AnchoredWindows(seconds), "k string, t bigint, start bigint, n bigint", "Append", "EventTime")
    back = lambda c: F.timestamp_micros(c).cast(time_kind)
    return out.select(value.alias(key), back("t").alias(ts), back("start").alias("window_start"), "n")


def rate_limits(requests: DataFrame, key: str, ts: str, seconds: int, limit: int, lateness: str) -> DataFrame:
    """Every request with whether it passes: the first ``limit`` of its window do."""
    return anchored_stream(requests, key, ts, seconds, lateness).withColumn("ok", F.col("n") <= limit)


def first_of_window(requests: DataFrame, key: str, ts: str, seconds: int, lateness: str) -> DataFrame:
    """The requests that open a window: the notifications that are written, the scans that may run."""
    return anchored_stream(requests, key, ts, seconds, lateness).filter("n = 1").select(key, ts)


def collected(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there, and returns all that it has put out so far under the same checkpoint."""
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    spark, name = stream.sparkSession, "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), STATE_TASKS * spark.sparkContext.defaultParallelism))
    try:
        stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return stream.sparkSession.read.schema(stream.schema).parquet(out).select(*stream.columns)
