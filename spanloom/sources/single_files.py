"""One file for each row: a data source ``single_files`` of (path, content) that reads and writes within tasks.

Writing: every task writes its files below a staging folder of its own attempt and, when all of them are whole, moves them
into the job's staged folder; the driver then puts that in place, by one rename where the target is new. It hears only how
many files there are. A task that dies leaves nothing behind but its attempt's folder, which the end of the job removes, and
another attempt writes the same files again. Reading: files are listed once and dealt into partitions of about
``partition_mb``; a task opens its own. ``glob`` keeps names that match.

Paths are those that ``pyarrow.fs`` knows: local or mounted ones, HDFS and object stores.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "single_files"
SCHEMA = "path string, content binary"


def _opened(where: str) -> tuple[pafs.FileSystem, str]:
    if where.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + where[5:].lstrip("/").rstrip("/")
    if "://" not in where:
        return pafs.LocalFileSystem(), where.rstrip("/")
    fs, path = pafs.FileSystem.from_uri(where)
    return fs, path.rstrip("/")


def _checked(path: str | None) -> str:
    if not path or path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"a file's path has to be below its folder: {path!r}")
    return path


@dataclass
class Written(WriterCommitMessage):
    files: int


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, root: str, replace: bool):
        self.root, self.replace = root.rstrip("/"), replace
        self.staged = f"{self.root}.staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, staged = _opened(self.staged)
        own, made, paths = f"{staged}/attempt-{uuid.uuid4().hex}", set(), []
        for batch in iterator:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folder = f"{own}/{_checked(path)}".rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(folder)
                    made.add(folder)
                with fs.open_output_stream(f"{own}/{path}") as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                paths.append(path)
        for path in paths:  # all of them are whole
            target = f"{staged}/files/{path}"
            fs.create_dir(target.rpartition("/")[0])
            fs.move(f"{own}/{path}", target)
        return Written(len(paths))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, staged = _opened(self.staged)
        _, root = _opened(self.root)
        fs.create_dir(f"{staged}/files")
        there = fs.get_file_info(root).type != pafs.FileType.NotFound
        if there and self.replace:
            fs.delete_dir(root)
            there = False
        if there:
            for info in fs.get_file_info(pafs.FileSelector(f"{staged}/files", recursive=True)):
                if info.type == pafs.FileType.File:
                    target = root + info.path[len(f"{staged}/files") :]
                    fs.create_dir(target.rpartition("/")[0])
                    fs.move(info.path, target)
        else:
            fs.create_dir(root.rpartition("/")[0])
            fs.move(f"{staged}/files", root)
        self._tidy(fs, staged)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, staged = _opened(self.staged)
        self._tidy(fs, staged)

    @staticmethod
    def _tidy(fs: pafs.FileSystem, staged: str) -> None:
        if fs.get_file_info(staged).type != pafs.FileType.NotFound:
            fs.delete_dir(staged)


class Some(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class FilesReader(DataSourceReader):
    def __init__(self, root: str, glob: str, size: int):
        self.root, self.glob, self.size = root, glob, size

    def partitions(self) -> list[InputPartition]:
        fs, root = _opened(self.root)
        found = [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File and fnmatch.fnmatch(x.base_name, self.glob)]
        out, held, total = [], [], 0
        for x in sorted(found, key=lambda x: x.path):
            if held and total + x.size > self.size:
                out.append(Some(held))
                held, total = [], 0
            held.append(x.path[len(root) + 1 :])
            total += x.size + 4096  # opening a file costs about as much as reading so many bytes
        return [*out, Some(held)] if held else out

    def read(self, partition: Some) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(self.root)
        for path in partition.paths:
            with fs.open_input_stream(f"{root}/{path}") as file:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([file.read()], pa.binary())], names=["path", "content"])


class SingleFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _root(self) -> str:
        root = self.options.get("path")
        if not root:
            raise ValueError("single_files needs a path")
        return root

    def reader(self, schema) -> FilesReader:
        return FilesReader(self._root(), self.options.get("glob", "*"), int(float(self.options.get("partition_mb", "32")) * (1 << 20)))

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self._root(), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """``spark``, which knows the format and whose workers can import it."""
    from ..shipping import ship

    ship(spark)
    spark.dataSource.register(SingleFiles)
    return spark


def write_files(files: DataFrame, folder: str, mode: str = "append") -> None:
    """Each row of ``files`` (path, content; binary or text) as a file of its own below ``folder``."""
    registered(files.sparkSession)
    files.select("path", F.col("content").cast("binary").alias("content")).write.format(FORMAT).mode(mode).save(folder)


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, content) of the files below ``folder``; path is relative to it."""
    return registered(spark).read.format(FORMAT).option("glob", glob).load(folder)
