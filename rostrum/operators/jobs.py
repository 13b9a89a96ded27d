"""Work queue, retries, rate limits, retention, as plans over job and event tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rostrum.functions.numbers import half_up
from rostrum.functions.urls import host

# Limits of the queue.
STUCK = "INTERVAL 5 MINUTES"
MOST_ATTEMPTS = 3
WINDOW = "INTERVAL 60 MINUTES"
DEFAULT_SECONDS = 40.0
LONGEST_SECONDS = 600
PERMANENT = r"(?s)fetch landing\b.*HTTP 404\b"
TRANSIENT = r"(?i)deadlock"


def claimable(job: DataFrame, most: int, busy_hosts: DataFrame | None = None) -> DataFrame:
    """The jobs to start next: pending, the oldest of each host, at most so many; hosts at work are left out."""
    p = job.filter("status = 'pending'").withColumn("host", host(F.col("url")))
    if busy_hosts is not None:
        p = p.join(busy_hosts, "host", "left_anti")
    first = p.withColumn("i", F.row_number().over(Window.partitionBy("host").orderBy("scheduled_at", "job_id"))).filter("i = 1")
    return first.orderBy("scheduled_at", "job_id").limit(most).select("job_id", "host", (F.col("attempts") + 1).alias("attempts"))


def waves(job: DataFrame) -> DataFrame:
    """(job_id, host, wave): pending jobs in the order in which a drain with one job in flight per host would start them."""
    p = job.filter("status = 'pending'").withColumn("host", host(F.col("url")))
    return p.select("job_id", "host", F.row_number().over(Window.partitionBy("host").orderBy("scheduled_at", "job_id")).cast("bigint").alias("wave"))


def is_permanent(error: Column) -> Column:
    return error.rlike(PERMANENT)


def next_status(error: Column, attempts: Column, most: int = MOST_ATTEMPTS) -> Column:
    """What becomes of a job: over the ceiling it fails before it runs; after an attempt it is done without error; deadlocks are tried
    again; permanent errors are abandoned; the last attempt fails."""
    return F.when(attempts > most, "failed").when(error.isNull(), "done").when(error.rlike(TRANSIENT), "pending").when(is_permanent(error), "abandoned").when(attempts >= most, "failed").otherwise("pending")


def recover_stuck(job: DataFrame, now: Column, after: str = STUCK) -> DataFrame:
    """Running jobs without a start, or started too long ago, are pending again."""
    stuck = (F.col("status") == "running") & (F.col("started_at").isNull() | (F.col("started_at") < now - F.expr(after)))
    return job.withColumn("status", F.when(stuck, "pending").otherwise(F.col("status"))).withColumn("started_at", F.when(~stuck, F.col("started_at")))


def progress(job: DataFrame, now: Column, sample: int = 20) -> DataFrame:
    """Queue counts of each user over the last hour, the job that has run longest, the mean of the last durations, and an estimate of
    seconds left: pending jobs at the mean (a default without any), and running ones at what is left of it, 5 at least; null with
    nothing left."""
    recent = F.col("finished_at") >= now - F.expr(WINDOW)
    running = F.when(F.col("status") == "running", F.struct(F.col("started_at").isNull().alias("unknown"), "started_at", "job_id"))
    counts = job.groupBy("user_id").agg(
        F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "running").alias("running"), F.count_if((F.col("status") == "done") & recent).alias("done"),
        F.count_if(F.col("status").isin("failed", "abandoned") & recent).alias("failed"), F.min(running).alias("current"),
    )
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    last = job.filter("status = 'done' and started_at is not null and finished_at is not null").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("finished_at"), "job_id"))).filter(F.col("i") <= sample)
    took = seconds(F.col("finished_at")) - seconds(F.col("started_at"))
    mean = last.withColumn("took", took).filter((F.col("took") >= 0) & (F.col("took") < LONGEST_SECONDS)).groupBy("user_id").agg(F.avg("took").alias("mean"))
    each = F.coalesce("mean", F.lit(DEFAULT_SECONDS))
    elapsed = F.coalesce(seconds(now) - seconds(F.col("current.started_at")), F.lit(0.0))
    at_work = F.when(F.col("running") > 0, half_up(F.greatest(each - elapsed, F.lit(5.0)) * F.col("running"))).otherwise(0)
    eta = F.when(F.col("pending") + F.col("running") > 0, F.greatest(half_up(F.col("pending") * each) + at_work, F.lit(5)))
    total = F.col("done") + F.col("failed") + F.col("running") + F.col("pending")
    return counts.join(mean, "user_id", "left").select(
        "user_id", "pending", "running", "done", "failed", total.alias("total"), F.col("current.job_id").alias("current_job"), (half_up(F.col("mean") * 10) / 10).alias("mean_seconds"), eta.cast("bigint").alias("eta")
    )


def earliest_urls(records: DataFrame, key: str, seq: str, date: str) -> DataFrame:
    """One record of each url: the first seen, unless it has a date and a later one has an earlier date (dates are compared as text)."""
    dated = F.when(F.col(date) != "", F.struct(F.col(date).alias("d"), F.col(seq).alias("s")))
    first = records.groupBy(key).agg(F.min(seq).alias("first"), F.min_by(F.coalesce(date, F.lit("")), seq).alias("date"), F.min(dated).alias("best"))
    chosen = first.select(F.col(key).alias("__key"), F.when(F.col("date") == "", F.col("first")).otherwise(F.col("best.s")).alias("__seq"))
    return records.join(chosen, (F.col(key) == F.col("__key")) & (F.col(seq) == F.col("__seq")), "left_semi")


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def anchored_windows(events: DataFrame, key: list[str], ts: str, seconds: int) -> DataFrame:
    """Each event with the start of its fixed window and its number in it. A window starts at the first event after the one
    before has ended (strictly more than ``seconds`` after its start), so windows are anchored at events, not at the clock.
    A pause longer than a window always starts one, so a key's history is cut there first and each burst is folded by itself."""
    span = seconds * 1_000_000
    kind = events.schema[ts].dataType
    order = Window.partitionBy(*key).orderBy("t")
    timed = events.select(*key, _micros(ts).alias("t")).withColumn("new", (F.col("t") - F.lag("t").over(order) > span).cast("int"))
    bursts = timed.withColumn("burst", F.sum(F.coalesce("new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        """Rows of whole bursts, in order."""
        t = rows["t"].to_numpy()
        ends = np.append(np.flatnonzero(_changes(rows))[1:], len(t))
        start, n, i = np.empty_like(t), np.empty_like(t), 0
        for end in ends.tolist():
            while i < end:
                j = i + int(np.searchsorted(t[i:end], t[i] + span, "right"))
                start[i:j], n[i:j] = t[i], np.arange(1, j - i + 1)
                i = j
        return rows[key].assign(t=t, start=start, n=n)

    def _changes(rows: pd.DataFrame) -> np.ndarray:
        own, before = rows[[*key, "burst"]], rows[[*key, "burst"]].shift()
        changed = ((own != before) & ~(own.isna() & before.isna())).any(axis=1).to_numpy()  # null is a key like any other
        changed[0] = True
        return changed

    def stream(batches):
        rest = None
        for rows in batches:
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            if not len(rows):
                continue
            last = int(np.flatnonzero(_changes(rows))[-1])  # the last burst may go on in the next batch
            if last:
                yield fold(rows.iloc[:last])
            rest = rows.iloc[last:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield fold(rest)

    schema = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in key) + ", t bigint, start bigint, n bigint"
    done = bursts.repartition(*key, "burst").sortWithinPartitions(*key, "burst", "t").mapInPandas(stream, schema)
    back = lambda c: F.timestamp_micros(c).cast(kind)
    return done.select(*key, back("t").alias(ts), back("start").alias("window_start"), "n")


def rate_limit(events: DataFrame, key: list[str], ts: str, seconds: int, limit: int) -> DataFrame:
    """Anchored windows with whether each request passes."""
    return anchored_windows(events, key, ts, seconds).withColumn("ok", F.col("n") <= limit)


def deduped(events: DataFrame, key: list[str], ts: str, seconds: int) -> DataFrame:
    """The events that are written: none of the same key within the window before."""
    return anchored_windows(events, key, ts, seconds).filter("n = 1").select(*key, ts)


def cooled_down(scans: DataFrame, key: list[str], ts: str, seconds: int) -> DataFrame:
    """Scans that may run: the last one allowed is at least so long ago."""
    return anchored_windows(scans, key, ts, seconds).filter("n = 1").select(*key, ts)


def incremental_bound(messages: DataFrame, key: list[str], ts: str, days: int = 1) -> DataFrame:
    """From when to read on: the last message less a day."""
    return messages.groupBy(*key).agg((F.max(ts) - F.expr(f"INTERVAL {days} DAYS")).alias("after"))


def backoff(failures: Column, floor: float = 1.5, ceiling: float = 3.0) -> Column:
    """Seconds between requests to a host after so many refusals: doubled each time, up to a ceiling."""
    return F.least(F.lit(ceiling), F.lit(floor) * F.pow(F.lit(2.0), failures))


def newest_documents(documents: DataFrame, now: Column, days: int) -> DataFrame:
    """Archived pages that retention keeps: the newest of each url, and all younger than so many days."""
    top = F.max("fetched_at").over(Window.partitionBy("url"))
    return documents.withColumn("top", top).filter((F.col("fetched_at") == F.col("top")) | (F.col("fetched_at") >= now - F.expr(f"INTERVAL {days} DAYS"))).drop("top")


def latest_success(runs: DataFrame) -> DataFrame:
    """The newest successful parser run of each document."""
    w = Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.filter("success").withColumn("i", F.row_number().over(w)).filter("i = 1").drop("i")


def _reset(when: Column, columns: list[str]) -> list[Column]:
    """The columns of a job, those of its run set back where ``when`` holds."""
    fresh = {"status": F.lit("pending"), "attempts": F.lit(0).cast("bigint")}
    blank = {"last_error", "started_at", "finished_at"}
    return [F.when(when, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.when(~when, F.col(c)).alias(c) if c in blank else F.col(c) for c in columns]


def cleared(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs of the requested (user_id, url) start anew, whatever they had become."""
    asked = requests.select("user_id", "url").distinct().withColumn("__asked", F.lit(True))
    return jobs.join(asked, ["user_id", "url"], "left").withColumn("__asked", F.coalesce("__asked", F.lit(False))).select(*_reset(F.col("__asked"), jobs.columns))


def reingested(jobs: DataFrame, urls: DataFrame) -> DataFrame:
    """Jobs of all of a user's urls start anew, but for locked ones and those whose page is gone for good. urls: (user_id, url, locked), one row each."""
    dead = jobs.filter(F.col("last_error").rlike("HTTP 404")).select("user_id", "url").distinct().withColumn("__dead", F.lit(True))
    known = jobs.join(urls.select("user_id", "url", F.col("locked").alias("__locked")), ["user_id", "url"], "left").join(dead, ["user_id", "url"], "left")
    return known.select(*_reset(~F.coalesce("__locked", F.lit(True)) & F.col("__dead").isNull(), jobs.columns))


def without_locked(jobs: DataFrame, locked: DataFrame) -> DataFrame:
    """Jobs without the pending ones of locked (user_id, url)."""
    keys = locked.select("user_id", "url").distinct()
    return jobs.filter("status <> 'pending'").unionByName(jobs.filter("status = 'pending'").join(keys, ["user_id", "url"], "left_anti").select(*jobs.columns)).unionByName(jobs.filter("status is null"))
