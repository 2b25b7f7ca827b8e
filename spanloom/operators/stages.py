"""Stage outputs put right: records of external stages as columns, defaults, registries of pluggable stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import UNKNOWN

#: Pieces that decoders and tokenizers use as marks.
BLANK, UNKNOWN_LABEL, UNKNOWN_PIECE, SPACE_PIECE, BLANK_PIECES = "", "▁⁇▁", "<unk>", "▁", ("<blank>", "<blk>")


def clean_diarization(records: DataFrame) -> DataFrame:
    """Records (meeting_id, speaker, start, end, segment struct<start,end>) with times lifted from ``segment``."""
    out = records
    if "segment" in records.columns:
        out = out.withColumn("start", F.coalesce("start", "segment.start")).withColumn("end", F.coalesce("end", "segment.end")).drop("segment")
    return out.withColumn("speaker", F.coalesce(F.col("speaker").cast("string"), F.lit(UNKNOWN)))


def synthetic_diarization(meetings: DataFrame) -> DataFrame:
    """One speaker for a meeting's whole duration."""
    return meetings.select("meeting_id", F.lit("SPEAKER_00").alias("speaker"), F.lit(0.0).alias("start"), F.col("duration").cast("double").alias("end"))


def one_speaker(segments: DataFrame, mode: Column) -> DataFrame:
    """Segments as of a run without diarization: one named speaker in single-speaker mode, else the unknown one."""
    return segments.withColumn("speaker", F.when(mode == "single-speaker", "SPEAKER_00").otherwise(UNKNOWN)).withColumn("text", F.trim(F.coalesce("text", F.lit(""))))


def shifted(segments: DataFrame, offset: Column) -> DataFrame:
    """Segments and their words, if any, moved by an offset in seconds, to three digits; a missing end is the start."""
    move = lambda x: F.bround(x + offset, 3)
    out = segments.withColumn("end", move(F.coalesce("end", "start", F.lit(0.0)))).withColumn("start", move(F.coalesce("start", F.lit(0.0))))
    if "words" not in segments.columns:
        return out
    return out.withColumn("words", F.transform("words", lambda w: w.withField("start", move(w.start)).withField("end", move(w.end))))


def timed(segments: DataFrame) -> DataFrame:
    """(meeting_id, start, end, speaker) of segments with both times, for diarization scores."""
    return segments.where("start is not null and end is not null").select("meeting_id", "start", "end", F.coalesce(F.nullif("speaker", F.lit("")), F.lit("UNKNOWN")).alias("speaker"))


def skips_diarization(runs: DataFrame) -> Column:
    return F.coalesce("skip_diarization", F.lit(False)) | F.coalesce(F.col("content_mode") == "single-speaker", F.lit(False))


def speaker_bounds(runs: DataFrame, backend: str = "hybrid") -> DataFrame:
    """Runs with the bounds that hold: two speakers where ``backend`` has several and none are given."""
    hybrid = ~skips_diarization(runs) & (F.col("backend_id") == backend) & (F.col("content_mode") == "multi-speaker")
    return runs.withColumns({c: F.coalesce(c, F.when(hybrid, 2)) for c in ("min_speakers", "max_speakers")})


def promoted(runs: DataFrame, stages: DataFrame, columns: list[str]) -> DataFrame:
    """Runs (run_id, ...) in which a stage's later values win over defaults, column by column."""
    later = stages.select(F.col("run_id").alias("__run"), *(F.col(c).alias(f"__{c}") for c in columns))
    out = runs.join(later, F.col("run_id") == F.col("__run"), "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop("__run", *(f"__{c}" for c in columns))


def output_text(payload: Column) -> Column:
    """The text in a model's JSON output: a string, the first of text, prediction and transcription, or joined chunks."""
    plain = F.coalesce(*(F.nullif(F.trim(F.get_json_object(payload, f"$.{k}")), F.lit("")) for k in ("text", "prediction", "transcription")))
    chunks = F.from_json(F.get_json_object(payload, "$.chunks"), "array<struct<text:string,prediction:string,transcription:string>>")
    listed = F.from_json(payload, "array<struct<text:string,prediction:string,transcription:string>>")
    each = lambda xs: F.array_join(F.filter(F.transform(xs, lambda c: F.trim(F.coalesce(c.text, c.prediction, c.transcription, F.lit("")))), lambda t: t != ""), " ")
    first = F.substring(F.ltrim(payload), 1, 1)
    return F.when(payload.isNull(), "").when(first == "[", F.coalesce(each(listed), F.lit(""))).when(first == "{", F.coalesce(plain, each(chunks), F.lit(""))).otherwise(F.trim(payload))


def decoder_labels(pieces: Column, size: Column) -> Column:
    """A decoder's labels for ``size`` outputs: with one piece less a blank is added, with as many exactly one must be there."""
    own = F.transform(pieces, lambda p: F.when(p == UNKNOWN_PIECE, UNKNOWN_LABEL).when(p.isin(*BLANK_PIECES), BLANK).when(p == " ", SPACE_PIECE).otherwise(p))
    blanks = F.size(F.filter(own, lambda p: p == BLANK))
    n = F.size(pieces)
    wrong = F.raise_error(F.concat(F.lit("labels don't fit "), size.cast("string"), F.lit(" outputs: "), n.cast("string"), F.lit(" pieces, "), blanks.cast("string"), F.lit(" blanks"))).cast("array<string>")
    return F.when((n + 1 == size) & (blanks == 0), F.concat(own, F.array(F.lit(BLANK)))).when((n == size) & (blanks == 1) & (size > 0), own).otherwise(wrong)


def zipped(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Segments with ``columns`` filled in, where they are null, from those of the same position in the other transcript.

    Both are taken in the order of (start, end, seg_idx); positions beyond the shorter one stay as they are.
    """
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy(F.asc_nulls_last("start"), "end", "seg_idx"))
    other = right.select(F.col("meeting_id").alias("__m"), n.alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns))
    out = left.withColumn("__n", n).join(other, (F.col("meeting_id") == F.col("__m")) & (F.col("__n") == F.col("__k")), "left")
    return out.withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop("__n", "__m", "__k", *(f"__{c}" for c in columns))


def longest_end(segments: DataFrame) -> DataFrame:
    """(meeting_id, end): where a meeting's last segment ends, which is its start if it has no end; 0 of none with either."""
    return segments.groupBy("meeting_id").agg(F.coalesce(F.max(F.coalesce("end", "start")), F.lit(0)).alias("end"))


def resampled(audio: DataFrame, source: int, target: int) -> DataFrame:
    """Audio (path, samples) at another rate, by linear interpolation in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("samples").to_pylist():
                n = max(1, round(len(x) / source * target))
                out.append(np.interp(np.arange(n) / target, np.arange(len(x)) / source, x).astype(np.float32) if source != target and len(x) else np.array(x, np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.list_(pa.float32()))], names=["path", "samples"])

    return audio.select("path", "samples").mapInArrow(run, "path string, samples array<float>")


# ---- stages that run models: a name, and a function from a table to a table of a fixed schema

Stage = Callable[[DataFrame], DataFrame]
_stages: dict[tuple[str, str], tuple[Stage, str]] = {}


def register(kind: str, name: str, stage: Stage, schema: str) -> None:
    """A stage (kind: transcribe, align, diarize, merge, audio) whose output must have ``schema``."""
    _stages[kind, name] = stage, schema


def registered(kind: str, name: str) -> bool:
    return (kind, name) in _stages


def apply(kind: str, name: str, table: DataFrame) -> DataFrame:
    """The registered stage's output, cast to its schema; a stage that isn't there is an error before anything runs."""
    if (kind, name) not in _stages:
        raise ValueError(f"no {kind} stage {name!r}; there are {', '.join(n for k, n in _stages if k == kind) or 'none'}")
    stage, schema = _stages[kind, name]
    kinds = table.sparkSession.createDataFrame([], schema).schema
    out = stage(table)
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds.fields))
