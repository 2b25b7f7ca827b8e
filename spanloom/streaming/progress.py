"""Progress events as a stream: duplicates dropped within a watermark, counts per window, the latest state of each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "run_id string, seq long, ts timestamp, status string, percent double, stage string"


def read_events(spark: SparkSession, folder: str, late: str = "10 minutes") -> DataFrame:
    """Events from JSON files as they arrive; one that repeats (run_id, seq) within ``late`` counts once."""
    return spark.readStream.schema(EVENT).json(folder).withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "seq"])


def per_window(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    """(start, end, stage, events, furthest) of each time window and stage."""
    agg = events.groupBy(F.window("ts", width).alias("w"), "stage").agg(F.count("*").alias("events"), F.max("percent").alias("furthest"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "stage", "events", "furthest")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each run; for update or complete output."""
    return events.groupBy("run_id").agg(F.max(F.struct("ts", "seq", "status", "percent", "stage")).alias("e")).select("run_id", "e.*")
