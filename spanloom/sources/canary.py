"""Where a merge's base transcript comes from: nowhere, a registered recognizer, or artifacts of earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stages
from .readers import read_chunked

#: Names of providers.
NONE, BACKEND, ARTIFACT = "none", "backend", "artifact"
SEGMENTS = "meeting_id string, seg_idx int, start double, end double, text string"


def provided(recordings: DataFrame, artifacts: str | None = None, backend: str = "canary") -> tuple[DataFrame, DataFrame]:
    """Segments (meeting_id, seg_idx, start, end, text), and (meeting_id, provider, available, n_segments) of all recordings.

    ``recordings`` (meeting_id, provider, ...) name their providers, as ``experiments.effective_options`` works them out.
    Those of ``backend`` go, all at once, to the stage registered as transcribe; artifacts are the chunked files of the folder,
    by meeting. available: whether a provider gave anything to choose from, which ``none`` never does.
    """
    known = F.col("provider").isin(NONE, BACKEND, ARTIFACT)
    checked = recordings.withColumn("provider", F.when(known, F.col("provider")).otherwise(F.raise_error(F.concat(F.lit("no transcript provider "), F.coalesce("provider", F.lit("null"))))))
    spark = recordings.sparkSession
    empty = spark.createDataFrame([], SEGMENTS)
    shaped = lambda df: df.select(F.col("meeting_id").cast("string").alias("meeting_id"), F.col("seg_idx").cast("int").alias("seg_idx"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "text")
    asked = checked.where(F.col("provider") == BACKEND)
    # a backend that nobody asks for need not be there
    heard = shaped(stages.apply("transcribe", backend, asked)) if stages.registered("transcribe", backend) or not asked.isEmpty() else empty
    wanted = checked.where(F.col("provider") == ARTIFACT).select(F.col("meeting_id").cast("string").alias("meeting_id"))
    found = shaped(read_chunked(spark, artifacts)).join(wanted, "meeting_id", "left_semi") if artifacts is not None else empty
    out = heard.unionByName(found)
    n = out.groupBy("meeting_id").agg(F.count("*").alias("n_segments"))
    meta = checked.select(F.col("meeting_id").cast("string").alias("meeting_id"), "provider").join(n, "meeting_id", "left").fillna(0, ["n_segments"])
    return out, meta.select("meeting_id", "provider", (F.col("provider") != NONE).alias("available"), "n_segments")
