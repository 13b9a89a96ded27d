"""Archives of fetched pages and mail messages as a Spark data source, in batches and as a stream.

    register(spark)
    records.write.format("record_archive").mode("append").save(path)          # id, at, owner, body
    spark.read.format("record_archive").load(path).filter("at >= ... and owner = ...")
    new_records(spark.readStream.format("record_archive").load(path))

An archive holds gzipped JSON lines in a folder for each day, in files whose names tell the first and last instant in them.
Conditions on the time skip files that cannot hold a hit, conditions on owner and id skip records before they reach Spark.
A stream reads on from its watermark, the last instant it has seen, less a day: messages may be filed late by that much. What
it reads again for that reason is told apart by id (:func:`new_records`), whose state expires with the watermark.
Records without an instant are filed under the epoch; batches without a condition on the time have them, streams do not.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from rostrum.sources.store import Staging, Written, located

FORMAT = "record_archive"
SCHEMA = "id string, at timestamp, owner string, body string"
DAY = 86_400_000_000
#: A task reads about so many bytes of files; a file is closed at so many records, and a batch has so many.
TASK_BYTES, FILE_RECORDS, BATCH_RECORDS = 32 << 20, 200_000, 2_000
#: A task that writes holds about so many bytes of all its days, then it files the largest day; each record counts so many besides its text.
HELD_BYTES, RECORD_BYTES = 32 << 20, 600
_NAME = re.compile(r"/(-?\d+)_(-?\d+)_[0-9a-f]+\.jsonl\.gz$")
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def micros(t: datetime) -> int:
    """Microseconds since the epoch; a time without a zone is in the zone of this process, as Spark hands it over."""
    return (t.astimezone(UTC) - _EPOCH) // timedelta(microseconds=1)


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


@dataclass
class Wanted:
    """Which records are read: at in low..high (microseconds, both included), and sets of owners and ids."""

    low: int = -(1 << 62)
    high: int = 1 << 62
    owners: frozenset | None = None
    ids: frozenset | None = None

    def add(self, f: Filter) -> bool:
        """Takes a condition into account; whether nothing is left of it for Spark."""
        column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        if column == "at" and isinstance(getattr(f, "value", None), datetime):
            t = micros(f.value)
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.low = max(self.low, t + isinstance(f, GreaterThan))
            if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.high = min(self.high, t - isinstance(f, LessThan))
            return isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo, LessThan, LessThanOrEqual))
        if column in ("owner", "id") and isinstance(f, (EqualTo, In)):
            name = f"{column}s"
            values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            setattr(self, name, values if getattr(self, name) is None else getattr(self, name) & values)
            return True
        return False

    def holds(self, record: dict) -> bool:
        at = record["at"]
        timely = self.low <= at <= self.high if at is not None else self.low == -(1 << 62) and self.high == 1 << 62
        return timely and (self.owners is None or record["owner"] in self.owners) and (self.ids is None or record["id"] in self.ids)


def listed(path: str, low: int, high: int) -> list[tuple[str, int, int]]:
    """(path, bytes, last instant) of the files that may hold records of low..high. Only the days in question are listed."""
    system, root = located(path)
    out = []
    for day in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if day.type != fs.FileType.Directory or not (m := re.search(r"/day=(-?\d+)$", day.path)) or not low // DAY <= int(m[1]) <= high // DAY:
            continue
        for info in system.get_file_info(fs.FileSelector(day.path)):
            if (m := _NAME.search(info.path)) and int(m[1]) <= high and int(m[2]) >= low:
                out.append((info.path, info.size, int(m[2])))
    return sorted(out)


def packed(files: list[tuple[str, int, int]]) -> list[Files]:
    """Files by the task, about TASK_BYTES each."""
    out, held, size = [], [], 0
    for path, n, _ in files:
        if held and size + n > TASK_BYTES:
            out.append(Files(held))
            held, size = [], 0
        held.append(path)
        size += n
    return [*out, Files(held)] if held or not out else out


def _records(path: str, files: list[str], wanted: Wanted) -> Iterator[pa.RecordBatch]:
    system, _ = located(path)
    schema = pa.schema([("id", pa.string()), ("at", pa.timestamp("us", "UTC")), ("owner", pa.string()), ("body", pa.string())])
    held = []
    for name in files:
        with system.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw) as lines:
            for line in lines:
                record = json.loads(line)
                if wanted.holds(record):
                    held.append(record)
                if len(held) >= BATCH_RECORDS:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.add(f):
                yield f

    def partitions(self) -> list[Files]:
        return packed(listed(self.path, self.wanted.low, self.wanted.high))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from _records(self.path, partition.paths, self.wanted)


@dataclass
class ReadFiles(Files):
    """Files of a stream's batch, and what of them it takes."""

    low: int
    high: int

    def __init__(self, paths: list[str], low: int, high: int):
        super().__init__(paths)
        self.low, self.high = low, high


class ArchiveStream(DataSourceStreamReader):
    """Offsets are the last instant seen. A batch holds what lies after the one before less a day, up to its own."""

    def __init__(self, path: str):
        self.path, self.late = path, DAY

    def initialOffset(self) -> dict:
        return {"at": None}

    def latestOffset(self) -> dict:
        return {"at": max((last for *_, last in listed(self.path, -(1 << 62), 1 << 62)), default=None)}

    def _bounds(self, start: dict, end: dict) -> Wanted:
        return Wanted(low=1 - (1 << 62) if start["at"] is None else start["at"] - self.late + 1, high=end["at"])

    def partitions(self, start: dict, end: dict) -> list[ReadFiles]:
        if end["at"] is None:
            return [ReadFiles([], 1, 0)]
        wanted = self._bounds(start, end)
        return [ReadFiles(x.paths, wanted.low, wanted.high) for x in packed(listed(self.path, wanted.low, wanted.high))]

    def read(self, partition: ReadFiles) -> Iterator[pa.RecordBatch]:
        yield from _records(self.path, partition.paths, Wanted(partition.low, partition.high))


class ArchiveWriter(DataSourceArrowWriter):
    """Tasks write files per day into the staging folder, of bounded size in all; rows that come in the order of their times make fewer files; commit moves them where readers look, abort deletes them."""

    def __init__(self, path: str):
        self.staging = Staging(path).begin()

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        out, held, sizes = Written(TaskContext.get().partitionId()), {}, {}
        size = 0
        for batch in batches:
            at = batch.column("at").cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_pylist()
            for t, *rest in zip(at, *(batch.column(c).to_pylist() for c in ("id", "owner", "body")), strict=True):
                day, n = (t or 0) // DAY, sum(len(x) for x in rest if x is not None)
                held.setdefault(day, []).append({"at": t, **dict(zip(("id", "owner", "body"), rest, strict=True))})
                sizes[day] = sizes.get(day, 0) + n + RECORD_BYTES
                size += n + RECORD_BYTES
                if size >= HELD_BYTES or len(held[day]) >= FILE_RECORDS:
                    most = max(sizes, key=sizes.get) if size >= HELD_BYTES else day
                    size -= sizes.pop(most)
                    out.files.append(self._file(most, held.pop(most)))
        out.files += [self._file(day, records) for day, records in held.items()]
        return out

    def _file(self, day: int, records: list[dict]) -> str:
        times = [r["at"] or 0 for r in records]
        name = f"day={day}/{min(times)}_{max(times)}_{uuid.uuid4().hex}.jsonl.gz"
        with self.staging.new_file(name) as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) as packed_lines:
            for r in sorted(records, key=lambda r: (r["at"] or 0, r["id"] or "")):
                packed_lines.write(json.dumps(r, ensure_ascii=False).encode() + b"\n")
        return name

    def commit(self, messages: list[Written | None]) -> None:
        system, root = located(self.staging.path)
        for name in (f for m in messages if m for f in m.files):
            system.create_dir(f"{root}/{name.split('/')[0]}", recursive=True)
            system.move(f"{self.staging.folder}/{name}", f"{root}/{name}")
        self.staging.abort()  # what is left there

    def abort(self, messages: list[Written | None]) -> None:
        self.staging.abort()


class RecordArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def streamReader(self, schema: StructType) -> ArchiveStream:
        return ArchiveStream(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        if overwrite:
            raise ValueError("an archive is only added to")
        return ArchiveWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordArchive)


def new_records(stream: DataFrame) -> DataFrame:
    """A stream's records, each id once: what is read again for the sake of late ones is left out."""
    return stream.withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["id"])


def drained(spark: SparkSession, path: str, out: str, checkpoint: str) -> DataFrame:
    """Reads what is new in an archive since the last call with the same checkpoint, and returns it. A batch that is run again after a
    failure replaces what it had written."""
    before = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    system = before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = new_records(spark.readStream.format(FORMAT).load(path))
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not system.exists(before):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(out).select("id", "at", "owner", "body")
