"""Anchored windows over shuffled micro-batches against the batch plan, and what is left of their state."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.operators import jobs
from rostrum.streaming import windows

BASE = 1_700_000_000


def frame(spark, rows):
    return spark.createDataFrame([(u, float(s)) for u, s in rows], "u long, s double").select("u", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))


class Feed:
    """A folder that a stream reads, one file to a micro-batch."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.files = spark, tmp_path, 0
        (tmp_path / "in").mkdir()

    def add(self, *lots):
        for rows in lots:
            frame(self.spark, rows).coalesce(1).write.mode("append").parquet(f"{self.path}/in/{self.files:03d}")
            self.files += 1

    def run(self, make):
        stream = self.spark.readStream.schema("u long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in/*")
        return [tuple(r) for r in windows.collected(make(stream), f"{self.path}/out", f"{self.path}/state").collect()]

    def state_rows(self, name):
        return self.spark.read.format("statestore").option("stateVarName", name).load(f"{self.path}/state").count()


def test_settled_windows_go_on_from_the_one_before():
    t = np.array([0, 5, 10, 11, 30, 100], np.int64)
    starts, numbers, start, n = windows.settled(t, 10, None, 0)
    assert starts.tolist() == [0, 0, 0, 11, 30, 100] and numbers.tolist() == [1, 2, 3, 1, 1, 1] and (start, n) == (100, 1)
    starts, numbers, start, n = windows.settled(np.array([110, 111], np.int64), 10, start, n)
    assert starts.tolist() == [100, 111] and numbers.tolist() == [2, 1] and (start, n) == (111, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_micro_batches_equal_the_batch_plan(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = sorted(((r.choice([None, 1, 2, 3]), BASE + r.randrange(6000) + r.choice([0, 0.25, 0.0001])) for _ in range(250)), key=lambda x: x[1])
    late = [(x, x[1] + r.random() * 500) for x in rows]  # by up to 500 seconds
    arrived = [x for x, _ in sorted(late, key=lambda x: x[1])]
    lots = [arrived[i : i + 60] for i in range(0, len(arrived), 60)]
    for lot in lots:
        r.shuffle(lot)
    feed = Feed(spark, tmp_path)
    feed.add(*lots, [(99, BASE + 100_000.0)])
    got = [x for x in feed.run(lambda s: windows.rate_limits(s, "u", "ts", 300, 5, "500 seconds")) if x[0] != 99]
    want = jobs.rate_limit(frame(spark, rows), ["u"], "ts", 300, 5).select("u", "ts", "window_start", "n", "ok").collect()
    assert sorted(got, key=str) == sorted((tuple(x) for x in want), key=str)


def test_state_is_gone_after_the_window(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    limits = lambda s: windows.rate_limits(s, "u", "ts", 60, 1, "10 seconds")
    feed.add([(1, BASE + 0.0), (2, BASE + 1.0)], [(3, BASE + 40.0)])
    got = feed.run(limits)
    assert {x[0] for x in got} == {1, 2}  # 3 is not yet past the watermark
    assert (feed.state_rows("waiting"), feed.state_rows("window")) == (1, 2)
    feed.add([(9, BASE + 500.0)])
    got = feed.run(limits)
    assert {x[0] for x in got} == {1, 2, 3}
    assert (feed.state_rows("waiting"), feed.state_rows("window")) == (1, 0)  # only what pushed the watermark waits


def test_a_restart_goes_on_with_the_window_and_drops_what_is_too_late(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    first = lambda s: windows.first_of_window(s, "u", "ts", 300, "20 seconds")
    feed.add([(1, BASE + 0.0), (7, BASE + 100.0)])
    assert [x[0] for x in feed.run(first)] == [1]
    feed.add([(1, BASE + 299.0), (1, BASE + 10.0), (7, BASE + 350.0)], [(1, BASE + 301.0), (9, BASE + 5000.0)])
    got = sorted((u, int(t.timestamp()) - BASE) for u, t in feed.run(first) if u != 9)
    assert got == [(1, 0), (1, 301), (7, 100)]  # 299 is in the first window; 10 came after the watermark (80); 350 is in 7's


def test_keys_are_settled_at_once_as_one_by_one():
    r = np.random.default_rng(3)
    for _ in range(50):
        count, span = 6, int(r.integers(1, 30))
        code = np.sort(r.integers(0, count, r.integers(0, 60)))
        times = r.integers(0, 200, len(code))
        times = times[np.lexsort((times, code))]
        begun, start, n = r.random(count) < 0.5, r.integers(-40, 0, count), r.integers(1, 9, count)
        starts, numbers, after, start_after, n_after = windows.settled_keys(code, times, span, begun, start, n)
        for k in range(count):
            want = windows.settled(times[code == k], span, int(start[k]) if begun[k] else None, int(n[k]) if begun[k] else 0)
            assert starts[code == k].tolist() == want[0].tolist() and numbers[code == k].tolist() == want[1].tolist()
            assert after[k] == (want[2] is not None) and (not after[k] or (start_after[k], n_after[k]) == want[2:])
