"""Files that tasks write and the driver commits: the two phases of this library's own writers, on any file system pyarrow knows."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import WriterCommitMessage


def shared_folder(spark: SparkSession) -> str:
    """A new folder in what the cluster names in spark.checkpoint.dir. Where nothing is named, a folder of this machine serves a
    local master, as in tests; on a cluster its executors could not read each other's, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='shared-')).rstrip('/')}/rostrum-{uuid.uuid4().hex}"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    """What a task attempt wrote: its partition, and the files below the staging folder."""

    partition: int
    files: list[str] = field(default_factory=list)


@dataclass
class Staging:
    """A folder next to ``path`` into which the tasks of one job write. Nobody reads it; commit takes over the files that the
    successful attempts name, and abort leaves nothing. The driver makes the folder, and tasks that go on after it is gone fail."""

    path: str
    job: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def folder(self) -> str:
        parent, name = posixpath.split(located(self.path)[1].rstrip("/"))
        return f"{parent}/_staging-{name}-{self.job}"

    def begin(self) -> Staging:
        located(self.path)[0].create_dir(self.folder, recursive=True)
        return self

    def new_file(self, name: str):
        """An output stream below the staging folder."""
        system, _ = located(self.path)
        where = f"{self.folder}/{name}"
        if "/" in name:
            system.create_dir(posixpath.dirname(where), recursive=False)
        return system.open_output_stream(where, compression=None)

    def drop_but(self, wanted: set[str]) -> None:
        """Deletes what attempts left that did not succeed."""
        system, _ = located(self.path)
        for info in system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True, recursive=True)):
            if info.type == fs.FileType.File and info.path[len(self.folder) + 1 :] not in wanted:
                system.delete_file(info.path)

    def become(self, overwrite: bool) -> None:
        """The staging folder as a whole becomes ``path``."""
        system, target = located(self.path)
        if system.get_file_info(target).type != fs.FileType.NotFound:
            if not overwrite:
                raise FileExistsError(f"{self.path} is there already")
            system.delete_dir(target)
        system.move(self.folder, target)

    def abort(self) -> None:
        system, _ = located(self.path)
        if system.get_file_info(self.folder).type != fs.FileType.NotFound:
            system.delete_dir(self.folder)


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: computed once, so what depends on how it was cut into partitions stays."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
