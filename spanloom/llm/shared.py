"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: More rows than this are joined by a shuffle, not broadcast.
BROADCAST_ROWS = 200_000


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with underscores before it until no column has it, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset on a local master (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir isn't set: executors of {master} need a folder that all of them share")
        found = tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_remove_local, found)
    return found.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path as its own type."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = filesystem(spark, path)
    fs.delete(where, True)


_leftover: list[tuple[SparkSession, str]] = []


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Has ``path``, which a lazy result may still read, removed when the driver ends."""
    if not _leftover:
        atexit.register(_clean)
    _leftover.append((spark, path))


def _clean() -> None:
    for spark, path in _leftover:
        with contextlib.suppress(Exception):  # the session's JVM may be gone
            remove(spark, path)


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Plans made in here lose their shuffle files when they have run: the table that they write takes their place."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    if before is None:
        yield
        return
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def plain(spark: SparkSession):
    """Small tables are worked out in here without generated code, which driver and executors would compile and keep for each."""
    keys = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Stages:
    """Tables written once and read back, so that later steps neither recompute nor lose them.

    A table written here outlives its executors. ``drop`` removes one that no later step reads, ``keep`` all but those
    that the result reads; these go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.held: list[DataFrame] = []
        remove_at_exit(spark, self.root)

    def write(self, df: DataFrame, step: str, large: bool = False) -> DataFrame:
        """``large``: have the driver collect its garbage afterwards, which lets Spark remove shuffle files of earlier steps."""
        path = f"{self.root}/{step}-{len(self.held)}"
        with tidy(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        if large:
            context = self.spark.sparkContext
            context._jsc.sc().listenerBus().waitUntilEmpty(10_000)  # its last event still holds the plan
            gc.collect()
            context._jvm.System.gc()
            time.sleep(1)  # for Spark's cleaner
        self.held.append(out)
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            remove(self.spark, path)

    def keep(self, *frames: DataFrame) -> None:
        wanted = {id(f) for f in frames}
        for df in self.held:
            if id(df) not in wanted:
                self.drop(df)


def planned_bytes(df: DataFrame, default: int = 0) -> int:
    """Bytes that the optimizer expects ``df`` to hold, from file sizes; ``default`` where it doesn't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return default if size >= 1 << 60 else size


def bounded(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its rows, which are counted, are few."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def parts_for(df: DataFrame, each_mb: float, least: int = 0) -> int:
    """Partitions of about ``each_mb`` for ``df``, never fewer than the session's shuffle partitions."""
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(session, least, -(-planned_bytes(df) // int(each_mb * (1 << 20))))
