"""Preset files as a Spark data source: many small files are read in parts of equal bytes, and written under their own names.

`spark.read.format("presets").load(folder)` gives (name, content) for every file below the folder; `df.write.format("presets")`
writes such rows. A task writes to a folder of its attempt, and the files move to their names once all tasks are done, so that
a failed attempt leaves nothing. Paths may be those of any file system that Arrow knows.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import prepare

SCHEMA = "name string, content binary"
#: Bytes of the files of one partition, and what a file counts for at least.
PART_BYTES, FILE_BYTES = 64 << 20, 1 << 16
#: The folder of attempts; names that begin so aren't presets.
ATTEMPTS = "_attempts"


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files, root = located(self.path)
        found = [f for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
        found = [(posixpath.relpath(f.path, root), f.size or 0) for f in found if not posixpath.relpath(f.path, root).startswith("_")]
        parts: list[InputPartition] = []
        held: list[str] = []
        size = 0
        for name, n in sorted(found):
            if held and size + max(n, FILE_BYTES) > PART_BYTES:
                parts.append(Files(held))
                held, size = [], 0
            held.append(name)
            size += max(n, FILE_BYTES)
        return [*parts, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, root = located(self.path)
        for name in partition.names:
            with files.open_input_stream(f"{root}/{name}") as f:
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f.read()], pa.binary())], ["name", "content"])


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = located(self.path)
        folder, names = f"{ATTEMPTS}/{self.job}/{uuid.uuid4().hex}", []
        for b in iterator:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                clean = posixpath.normpath(name or "")
                if clean.startswith(("_", "/", "..")) or clean == ".":
                    raise ValueError(f"{name!r} can't name a file below the folder")
                at = f"{root}/{folder}/{clean}"
                files.create_dir(posixpath.dirname(at), recursive=True)
                with files.open_output_stream(at) as f:
                    f.write(content or b"")
                names.append(clean)
        return Written(folder, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = located(self.path)
        done = [m for m in messages if m]
        names = [n for m in done for n in m.names]
        if len(names) > len(set(names)):
            self.abort(messages)
            raise ValueError("two presets of one name")
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(root)):
                if posixpath.basename(f.path) != ATTEMPTS:
                    (files.delete_dir if f.type == fs.FileType.Directory else files.delete_file)(f.path)
        for folder in {posixpath.dirname(n) for n in names}:
            files.create_dir(f"{root}/{folder}".rstrip("/"), recursive=True)
        for m in done:
            for name in m.names:
                files.move(f"{root}/{m.folder}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = located(self.path)
        for folder in (f"{root}/{ATTEMPTS}/{self.job}", f"{root}/{ATTEMPTS}"):
            info = files.get_file_info(folder)
            if info.type == fs.FileType.Directory and (folder.endswith(self.job) or not files.get_file_info(fs.FileSelector(folder))):
                files.delete_dir(folder)


class Presets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "presets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to the session."""
    prepare(spark).dataSource.register(Presets)
    return spark
