"""Folders for files that a query writes only to read them again."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master (tests).

    It is removed at exit.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir isn't set: executors of {master} need a folder that all of them share")
        root = tempfile.gettempdir()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at_exit_removed(spark, path)
    return path


def at_exit_removed(spark: SparkSession, path: str) -> None:
    """Has ``path``, which a lazy result may still read, removed when the driver ends."""
    atexit.register(_remove, spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session's JVM may be gone
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
