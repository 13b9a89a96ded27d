"""The archive source: conditions that skip files, streams that read on, writers that leave nothing behind."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rostrum.sources import archive
from rostrum.sources.archive import DAY, ArchiveReader, ArchiveStream, Wanted, listed, micros
from rostrum.sources.store import Staging

START = dt.datetime(2024, 1, 1)


def records(spark, hours, tag="m"):
    rows = [(f"{tag}{h}", START + dt.timedelta(hours=h), f"u{h % 3}", f'{{"x": "{h} é"}}') for h in hours]
    return spark.createDataFrame(rows, archive.SCHEMA).repartition(3)


def put(df, path):
    archive.register(df.sparkSession)
    df.write.format(archive.FORMAT).mode("append").save(path)


def load(spark, path):
    return spark.read.format(archive.FORMAT).load(path)


def test_a_round_trip_with_nulls(spark, tmp_path):
    path = f"{tmp_path}/a"
    odd = spark.createDataFrame([("n", None, None, None), (None, START, "", "")], archive.SCHEMA)
    df = records(spark, range(100)).unionByName(odd)
    put(df, path)
    assert sorted(load(spark, path).collect(), key=str) == sorted(df.collect(), key=str)
    put(records(spark, range(100, 110)), path)
    assert load(spark, path).count() == 112
    assert not [x for x in os.listdir(tmp_path) if x.startswith("_staging")]
    put(df.limit(0), f"{tmp_path}/none")
    assert load(spark, f"{tmp_path}/none").count() == 0


def test_conditions_skip_files_and_records(spark, tmp_path):
    path = f"{tmp_path}/a"
    put(records(spark, range(240)), path)
    df = load(spark, path)
    for condition, want in (
        ("at >= timestamp'2024-01-03 05:00:00' and at < timestamp'2024-01-03 08:00:00'", {"m53", "m54", "m55"}),
        ("at = timestamp'2024-01-02 01:00:00'", {"m25"}),
        ("at > timestamp'2024-01-10 22:00:00'", {"m239"}),
        ("owner = 'u1' and at <= timestamp'2024-01-01 04:00:00'", {"m1", "m4"}),
        ("id in ('m7', 'm300', 'm8') and owner <> 'u1'", {"m8"}),
        ("owner = 'u1' and owner = 'u2'", set()),
    ):
        assert {r.id for r in df.filter(condition).collect()} == want, condition
    day = micros(START.replace(tzinfo=dt.UTC)) + 3 * DAY
    every, some = listed(path, -(1 << 62), 1 << 62), listed(path, day, day + DAY - 1)
    assert 0 < len(some) <= len(every) / 5 and all(f"day={day // DAY}/" in x[0] for x in some)


def test_what_is_pushed_and_what_is_left_to_spark():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringContains

    reader = ArchiveReader("x")
    left = [StringContains(("body",), "a"), IsNotNull(("at",)), EqualTo(("body",), "b")]
    t = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    assert list(reader.pushFilters([GreaterThan(("at",), t), In(("owner",), ("a", "b")), EqualTo(("owner",), "b"), *left])) == left
    assert reader.wanted == Wanted(low=micros(t) + 1, owners=frozenset("b"))


def test_partitions_have_bounded_bytes(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/a"
    put(records(spark, range(240)), path)
    assert len(ArchiveReader(path).partitions()) == 1
    monkeypatch.setattr(archive, "TASK_BYTES", 600)
    sizes = {p: n for p, n, _ in listed(path, -(1 << 62), 1 << 62)}
    parts = ArchiveReader(path).partitions()
    assert len(parts) > 5 and sorted(x for p in parts for x in p.paths) == sorted(sizes)
    assert all(len(p.paths) == 1 or sum(sizes[x] for x in p.paths) <= 600 for p in parts)


def test_a_second_run_gives_only_new_records(spark, tmp_path):
    path, seen = f"{tmp_path}/a", f"{tmp_path}/seen"
    run = lambda n: sorted(r.id for r in archive.drained(spark, path, f"{tmp_path}/run{n}", seen).collect())
    put(records(spark, range(0, 100, 2)), path)
    assert run(1) == sorted(f"m{h}" for h in range(0, 100, 2))
    assert run(2) == []
    put(records(spark, [61, 75, 97, 99, 120]), path)  # 98 was the last: 61 is over a day late
    assert run(3) == ["m120", "m75", "m97", "m99"]
    put(records(spark, [119]), path)
    put(records(spark, [121], "again"), path)
    assert run(4) == ["again121", "m119"]


def test_a_batch_reads_one_day_back_and_no_more(spark, tmp_path):
    path = f"{tmp_path}/a"
    put(records(spark, range(240)), path)
    stream = ArchiveStream(path)
    end = stream.latestOffset()
    start = {"at": end["at"] - DAY}
    files = [f for p in stream.partitions(start, end) for f in p.paths]
    days = {f.split("day=")[1].split("/")[0] for f in files}
    assert len(days) <= 3
    ids = {x for p in stream.partitions(start, end) for b in stream.read(p) for x in b.column("id").to_pylist()}
    assert ids == {f"m{h}" for h in range(192, 240)}
    assert stream.partitions(end, {"at": None})[0].paths == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/a"
    archive.register(spark)
    broken = records(spark, range(50)).withColumn("body", F.when(F.col("id") == "m20", F.raise_error(F.lit("no"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="no"):
        broken.write.format(archive.FORMAT).mode("append").save(path)
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="only added to"):
        records(spark, [1]).write.format(archive.FORMAT).mode("overwrite").save(path)


def test_staging_drops_what_did_not_succeed(tmp_path):
    s = Staging(f"{tmp_path}/out").begin()
    for name in ("a/1", "a/2", "3"):
        with s.new_file(name) as f:
            f.write(name.encode())
    s.drop_but({"a/2"})
    s.become(overwrite=False)
    assert [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()] == ["out/a/2"]
    again = Staging(f"{tmp_path}/out").begin()
    with again.new_file("x"):
        pass
    with pytest.raises(FileExistsError):
        again.become(overwrite=False)
    again.abort()
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_writer_holds_a_bounded_part_of_many_days(tmp_path, monkeypatch):
    import pyarrow as pa

    from rostrum.sources.archive import ArchiveWriter

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(archive, "TaskContext", Task)
    monkeypatch.setattr(archive, "HELD_BYTES", 50 * 700)
    writer, filed, waiting = ArchiveWriter(f"{tmp_path}/a"), [0], []
    plain = writer._file
    writer._file = lambda day, rows: filed.__setitem__(0, filed[0] + len(rows)) or plain(day, rows)

    def batches():
        for k in range(100):
            waiting.append(10 * k - filed[0])
            at = pa.array([(i * 37 % 40) * DAY for i in range(10 * k, 10 * k + 10)], pa.timestamp("us", "UTC"))
            text = pa.array([f"m{i}" for i in range(10 * k, 10 * k + 10)])
            yield pa.record_batch([text, at, text, text], ["id", "at", "owner", "body"])

    done = writer.write(batches())
    assert max(waiting) <= 60 and filed[0] == 1000 and len(set(done.files)) == len(done.files)
