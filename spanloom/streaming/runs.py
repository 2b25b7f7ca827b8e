"""The state of runs as a stream: one row each time a run's state changes, a run that stalls included.

State is kept by run: the furthest event by (ts, seq), and until when the run may be silent. An event that isn't later than
the one kept changes nothing, so repeated and late events count once, and their order doesn't matter; events older than the
watermark are dropped before they get here. A run that isn't over and hears nothing for ``silence`` of event time is given
out as ``stalled``, once; its next event makes it run again. Over means completed or failed.

``write_states`` puts each micro-batch into a folder of its own number, replacing what is there: a batch that is run again
after a failure writes the same rows to the same place. ``latest_states`` reads the last state of each run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .progress import EVENT

STATE = "run_id string, ts timestamp, seq long, status string, percent double, stage string, events long"
#: Statuses after which a run is silent for good.
OVER = ("completed", "failed")


def read_arrivals(spark: SparkSession, folder: str, late: str = "10 minutes", files: int | None = None) -> DataFrame:
    """Progress events from JSON files as they arrive, ``files`` at most in each micro-batch."""
    read = spark.readStream.schema(EVENT)
    return (read if files is None else read.option("maxFilesPerTrigger", files)).json(folder).withWatermark("ts", late)


def states(events: DataFrame, silence: str = "15 minutes") -> DataFrame:
    """(run_id, ts, seq, status, percent, stage, events) at every change; ts of a stalled run is its last event's.

    events: how many different ones the run has had that were the furthest when they came, those of a micro-batch in order of
    time. Spark may hand over a run's rows in several frames, in any order; of each event its time and number, 16 bytes, are
    held until the micro-batch's last one.
    """
    from ..shipping import ship

    ship(events.sparkSession)
    quiet = int(pd.Timedelta(silence).total_seconds() * 1000)
    names = [c.split()[0] for c in STATE.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            kept = list(state.get)
            kept[2] = "stalled"
            state.update(tuple(kept))  # without another timer: given out once
            yield pd.DataFrame([(key[0], pd.Timestamp(kept[0], unit="us"), *kept[1:])], columns=names)
            return
        before = list(state.get) if state.exists else None
        kept, ahead = before, []  # ahead: (ts, seq) of events that are later than the one kept before
        for frame in frames:
            ts, seq = frame.ts.to_numpy("datetime64[us]").astype(np.int64), frame.seq.to_numpy(np.int64)
            if before:
                later = (ts > before[0]) | (ts == before[0]) & (seq > before[1])
                frame, ts, seq = frame[later], ts[later], seq[later]
            if not len(ts):
                continue
            ahead.append(np.unique(np.stack([ts, seq], 1), axis=0))
            at = tuple(map(int, ahead[-1][-1]))
            if kept is None or at > (kept[0], kept[1]):
                e = frame.iloc[int(np.flatnonzero((ts == at[0]) & (seq == at[1]))[0])]
                kept = [*at, e.status, float(e.percent), e.stage, 0]
        if ahead:
            kept[5] = (before[5] if before else 0) + len(np.unique(np.concatenate(ahead), axis=0))
        if kept == before:
            return
        state.update(tuple(kept))
        if kept[2] not in OVER:
            state.setTimeoutTimestamp(max(kept[0] // 1000 + quiet, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], pd.Timestamp(kept[0], unit="us"), *kept[1:])], columns=names)

    kind = "ts long, seq long, status string, percent double, stage string, events long"
    return events.groupBy("run_id").applyInPandasWithState(step, STATE, kind, "update", GroupStateTimeout.EventTimeTimeout)


def write_states(changes: DataFrame, folder: str, checkpoint: str, available: bool = True) -> StreamingQuery:
    """Starts writing ``states`` below ``folder``, a folder for each micro-batch; ``available``: what is there now, then stop."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch-{number:09d}")

    writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available else writer).start()


def latest_states(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of each run, by micro-batch; a micro-batch gives a run one row at most."""
    rows = spark.read.schema(f"{STATE}, batch long").option("recursiveFileLookup", True).parquet(folder)
    return rows.groupBy("run_id").agg(F.max_by(F.struct("ts", "seq", "status", "percent", "stage", "events"), "batch").alias("s")).select("run_id", "s.*")
