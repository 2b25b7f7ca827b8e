"""Quality of transcripts and runs without a reference, as grouped aggregates; a registry of checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..model import UNKNOWN


def share(part: Column, whole: Column) -> Column:
    """part / whole to six digits; 0 of nothing."""
    return F.coalesce(F.bround(F.try_divide(part.cast("double"), whole.cast("double")), 6), F.lit(0.0))


def proxy_quality(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Per meeting: five ratios, each to six digits, and their weighted score.

    Segments (meeting_id, seg_idx, speaker, start, end, text), words (meeting_id, start, end, score). A segment is short
    below 0.35 seconds or without words.
    """
    s = segments.withColumn("w", tokens(F.col("text")))
    short = (F.size("w") == 0) | (F.greatest(F.col("end") - F.col("start"), F.lit(0)) < 0.35)
    named = F.coalesce((F.col("speaker") != "") & (F.col("speaker") != UNKNOWN), F.lit(False))
    a = s.groupBy("meeting_id").agg(F.count("*").alias("n"), F.count_if(named).alias("named"), F.count_if(short).alias("short"))
    # repeated words: all less distinct ones, from counts by word, so no meeting's words are gathered
    each = s.select("meeting_id", F.explode("w").alias("word")).groupBy("meeting_id", "word").count()
    b = each.groupBy("meeting_id").agg(F.sum("count").alias("all_words"), F.sum(F.col("count") - 1).alias("again"))
    c = words.groupBy("meeting_id").agg(F.count("*").alias("m"), F.count_if(F.col("start").isNotNull() & F.col("end").isNotNull()).alias("timed"), F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
    j = a.join(b, "meeting_id", "left").join(c, "meeting_id", "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    out = j.select(
        "meeting_id", share(zero("timed"), zero("m")).alias("timed_word_ratio"), share(zero("score"), zero("m")).alias("mean_word_score"), share(F.col("named"), F.col("n")).alias("labeled_speaker_ratio"),
        share(F.col("short"), F.col("n")).alias("empty_or_short_segment_ratio"), share(zero("again"), zero("all_words")).alias("repetition_ratio"),
    )
    score = F.col("timed_word_ratio") * 0.35 + F.col("mean_word_score") * 0.25 + F.col("labeled_speaker_ratio") * 0.20 + (1 - F.col("empty_or_short_segment_ratio")) * 0.10 + (1 - F.col("repetition_ratio")) * 0.10
    return out.withColumn("proxy_quality_score", F.bround(score, 6))


def stability(runs: DataFrame) -> DataFrame:
    """``runs`` with fallback reasons and skipped stages, in the order asr, alignment, diarization.

    Columns read: asr_fallback, alignment_fallback, diarization_fallback, skip_alignment, alignment_skip_reason,
    skip_diarization, diarization_mode, duration_sec, wall_clock_sec.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    reasons = F.array_compact(F.array(some("asr_fallback"), some("alignment_fallback"), some("diarization_fallback")))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    skipped = F.array_compact(F.array(F.when(yes("skip_alignment") | some("alignment_skip_reason").isNotNull(), "alignment"), F.when(yes("skip_diarization") | F.coalesce(F.col("diarization_mode") == "synthetic_single_speaker", F.lit(False)), "diarization")))
    out = runs.withColumn("fallback_reasons", reasons).withColumn("skipped_stages", skipped)
    return out.withColumn("fallback_count", F.size("fallback_reasons").cast("long")).withColumn("skipped_stage_count", F.size("skipped_stages").cast("long")).withColumn("realtime_factor", share(F.coalesce("wall_clock_sec", F.lit(0.0)), F.coalesce("duration_sec", F.lit(0.0))))


Check = Callable[[dict[str, DataFrame]], DataFrame]
_checks: dict[str, tuple[str, Check]] = {}
SECTIONS = ("performance", "stability", "metrics")


def register(name: str, check: Check, section: str = "metrics") -> None:
    """A check takes named tables and returns rows keyed by meeting_id, for a section of the report."""
    _checks[name] = section, check


def _performance(t: dict[str, DataFrame]) -> DataFrame:
    return stability(t["runs"]).select("meeting_id", F.coalesce("wall_clock_sec", F.lit(0.0)).alias("wall_clock_sec"), "realtime_factor")


def _stability(t: dict[str, DataFrame]) -> DataFrame:
    return stability(t["runs"]).select("meeting_id", "fallback_reasons", "fallback_count", "skipped_stages", "skipped_stage_count")


def _reference(t: dict[str, DataFrame]) -> DataFrame:
    from .scoring import error_rates, flat_text

    said = flat_text(t["segments"]).withColumnRenamed("text", "hyp_text")
    known = flat_text(t["reference"]).withColumnRenamed("text", "ref_text")
    heard = t["segments"].select("meeting_id").distinct()
    return error_rates(known.join(heard, "meeting_id").join(said, "meeting_id", "left").fillna("", ["hyp_text"])).select("meeting_id", "wer", "cer")


register("performance", _performance, "performance")
register("stability", _stability, "stability")
register("proxy_transcript_quality", lambda t: proxy_quality(t["segments"], t["words"]))
register("reference_transcript_quality", _reference)
_NEEDS = {"performance": ("runs",), "stability": ("runs",), "proxy_transcript_quality": ("segments", "words"), "reference_transcript_quality": ("segments", "reference")}


def default_checks(tables: dict[str, DataFrame]) -> list[str]:
    """The registered checks whose tables are there; the reference's only with a reference."""
    return [name for name in _checks if all(t in tables for t in _NEEDS.get(name, ()))]


def report(tables: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """All checks' columns by meeting; of equal columns the later check's. Meetings without values of a check have nulls."""
    out = None
    for name in names or default_checks(tables):
        made = _checks[name][1](tables)
        if out is None:
            out = made
        else:
            out = out.drop(*(c for c in made.columns if c in out.columns and c != "meeting_id")).join(made, "meeting_id", "full")
    return out


def report_sections(tables: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """The report as one struct for each section; a section without checks is empty."""
    names = names or default_checks(tables)
    out = None
    for section in SECTIONS:
        mine = [n for n in names if _checks[n][0] == section]
        if mine:
            flat = report(tables, mine)
            made = flat.select("meeting_id", F.struct(*(c for c in flat.columns if c != "meeting_id")).alias(section))
            out = made if out is None else out.join(made, "meeting_id", "full")
    return out
