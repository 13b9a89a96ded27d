"""Rate limits over a stream of requests, with the same windows as the batch plan."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from rostrum.operators.jobs import waves


def rate_limited(requests: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """(key, ts, n, ok): each request of a stream with its number in its key's window. A window starts at the first request after
    the one before has ended; the state of a key is two numbers. Requests of a key must come in order from batch to batch."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(ts)
        numbers = []
        for t in rows[ts].astype("int64").to_numpy() // 1_000:
            start, n = (int(t), 1) if start is None or start < t - seconds * 1_000_000 else (start, n + 1)
            numbers.append(n)
        state.update((start, n))
        yield rows[[key, ts]].assign(n=numbers, ok=[x <= limit for x in numbers])

    kind = requests.schema[key].dataType.simpleString()
    return requests.select(key, ts).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{ts}` timestamp, n bigint, ok boolean", "start bigint, n bigint", "append", GroupStateTimeout.NoTimeout)


def drain(jobs: DataFrame, checkpoint: str, handle, most: int = 6):
    """Runs what is pending in a stream of jobs once: each micro-batch is split into waves with one job per host, and ``handle``
    gets one frame per wave of at most ``most`` hosts."""
    def each(batch: DataFrame, number: int) -> None:
        planned = waves(batch).withColumn("slot", F.floor((F.row_number().over(Window.partitionBy("wave").orderBy("host")) - 1) / most))
        planned = planned.join(batch.drop("host"), "job_id")
        for r in planned.select("wave", "slot").distinct().orderBy("wave", "slot").toLocalIterator():
            handle(planned.filter((F.col("wave") == r.wave) & (F.col("slot") == r.slot)), number)

    return jobs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
