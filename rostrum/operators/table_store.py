"""Tables that merges change in part: buckets of files under a manifest, which is swapped last.

    store = TableStore(spark, path).create(rows, by=["id"], buckets=64)
    store.merge(new, lambda old, new: upsert(old, new, ["id"]))
    store.read(); store.read(version=0)

A row lies in the bucket of the hash of its ``by`` columns. A merge reads and writes the buckets that its new rows fall into, and
takes the others over as they are; so it is for changes that concern rows with the same ``by`` values only, as upserts by a
key or replacements of a parent's children do. Files are never changed: a merge writes new ones, and then a manifest that says
which files each bucket has. Readers follow the newest manifest, so a job that dies before leaves the table as it was, and its
files go with the next :meth:`TableStore.vacuum`. There is one writer at a time.

Defined: nulls in ``by`` columns have a bucket like any value; an empty merge makes no version; a bucket may become empty.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rostrum.sources.store import located

_MANIFEST = re.compile(r"/v(\d{8})\.json$")
_BUCKET = "__bucket"


@dataclass
class Manifest:
    """A version of a table: its columns, how it is bucketed, and the folder of each bucket that has rows."""

    version: int
    schema: str
    by: list[str]
    buckets: int
    folders: dict[str, str]


class TableStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files, self.root = located(self.path)

    # -- versions

    def versions(self) -> list[int]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/_manifests", allow_not_found=True))
        return sorted(int(m[1]) for i in found if (m := _MANIFEST.search(i.path)))

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        if not known or version is not None and version not in known:
            raise FileNotFoundError(f"{self.path} has no version {'' if version is None else version}".rstrip())
        with self.files.open_input_stream(f"{self.root}/_manifests/v{known[-1] if version is None else version:08d}.json") as f:
            return Manifest(**json.loads(f.read()))

    def _publish(self, m: Manifest) -> None:
        """The manifest is there as a whole or not at all."""
        folder = f"{self.root}/_manifests"
        self.files.create_dir(folder, recursive=True)
        draft = f"{folder}/draft-{uuid.uuid4().hex}"
        with self.files.open_output_stream(draft, compression=None) as f:
            f.write(json.dumps(m.__dict__).encode())
        self.files.move(draft, f"{folder}/v{m.version:08d}.json")

    # -- rows

    def _bucketed(self, df: DataFrame, by: list[str], buckets: int) -> DataFrame:
        return df.withColumn(_BUCKET, F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))

    def _write(self, df: DataFrame, by: list[str], buckets: int) -> dict[str, str]:
        """Writes rows by bucket, and gives the folder of each bucket that has any."""
        name = f"data/{uuid.uuid4().hex}"
        parts = min(buckets, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1))
        self._bucketed(df, by, buckets).repartition(parts, _BUCKET).write.option("compression", "zstd").partitionBy(_BUCKET).parquet(f"{self.path}/{name}")
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/{name}", allow_not_found=True))
        return {m[1]: f"{name}/{_BUCKET}={m[1]}" for i in found if (m := re.search(rf"/{_BUCKET}=(\d+)$", i.path))}

    def _rows(self, m: Manifest, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(m.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def create(self, rows: DataFrame, by: list[str], buckets: int = 64) -> TableStore:
        if self.versions():
            raise FileExistsError(f"{self.path} is there already")
        self._publish(Manifest(0, rows.schema.json(), by, buckets, self._write(rows, by, buckets)))
        return self

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._rows(m, sorted(m.folders.values()))

    def merge(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> Manifest:
        """how(old, new): the rows of the touched buckets after the merge, of which ``old`` are those before."""
        m = self.manifest()
        touched = [str(r[0]) for r in self._bucketed(new.select(*m.by), m.by, m.buckets).select(_BUCKET).distinct().collect()]
        if not touched:
            return m
        old = self._rows(m, sorted(m.folders[b] for b in touched if b in m.folders))
        schema = StructType.fromJson(json.loads(m.schema))
        written = self._write(how(old, new).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]), m.by, m.buckets)
        if not set(written) <= set(touched):
            raise ValueError("a merge made rows of buckets that its new rows do not touch")
        after = Manifest(m.version + 1, m.schema, m.by, m.buckets, {b: f for b, f in m.folders.items() if b not in touched} | written)
        self._publish(after)
        return after

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the newest versions, and files that none of these has."""
        known = self.versions()
        used = {f for v in known[-keep:] for f in self.manifest(v).folders.values()}
        for v in known[:-keep]:
            self.files.delete_file(f"{self.root}/_manifests/v{v:08d}.json")
        for job in self.files.get_file_info(fs.FileSelector(f"{self.root}/data", allow_not_found=True)):
            for i in self.files.get_file_info(fs.FileSelector(job.path)):
                if i.type == fs.FileType.Directory and i.path[len(self.root) + 1 :] not in used:
                    self.files.delete_dir(i.path)
            if not any(f.startswith(job.path[len(self.root) + 1 :] + "/") for f in used):
                self.files.delete_dir(job.path)
