"""Experiments: variants and items to runs, runs to summaries, scores, leaderboards."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking
from .quality import share
from .search import few

#: What a hybrid backend's options are where they aren't given.
DEFAULTS = {
    "ctc.chunk_duration_sec": 20.0, "ctc.decoder.strategy": "beam", "ctc.decoder.beam_width": 32, "ctc.decoder.lm.enabled": True, "ctc.decoder.lm.alpha": 0.1, "ctc.decoder.lm.beta": 0.0,
    "canary.backend_id": "canary", "speaker_assignment_strategy": "whisperx", "speaker_label_style": "alpha", "merge_consecutive_speakers": False, "speaker_merge_gap_sec": 0.35,
}
_KINDS = {float: "double", int: "int", bool: "boolean", str: "string"}


def planned(variants: DataFrame, items: DataFrame) -> DataFrame:
    """Every variant (preset_id, ...) on every item (item_id, duration_limit, ...); an item's limit wins over the variant's.

    Variants are configuration and, up to ``search.FEW`` of them, go to each task; items, of any number, stay where they are.
    """
    limit = F.col("item_limit").cast("double")
    out = items.withColumnRenamed("duration_limit", "item_limit").crossJoin(few(variants))
    return out.withColumn("duration_limit", F.coalesce(limit, F.col("duration_limit"))).drop("item_limit")


def effective_options(options: Column) -> dict[str, Column]:
    """Each of ``DEFAULTS`` as a column, from JSON options where they say so; zeros and false count as said.

    canary.provider: artifact with a transcript path, else as said, else backend.
    """
    said = lambda key: F.get_json_object(options, f"$.{key}")
    out = {key: F.coalesce(said(key).cast(_KINDS[type(value)]), F.lit(value)).alias(key.replace(".", "_")) for key, value in DEFAULTS.items()}
    provider = F.when(said("canary_transcript_path").isNotNull(), "artifact").otherwise(F.coalesce(said("canary.provider"), F.lit("backend")))
    return out | {"canary.provider": provider.alias("canary_provider")}


def routed_model(language: Column, explicit: Column, override: Column, fixed: dict[str, str], default: str) -> Column:
    """The model of a language: the explicit map's, else the override, else the fixed one, else the default.

    Languages that aren't listed take the map's ``default`` entry before the override.
    """
    listed = language.isin("ru", "uk", "en")
    own = F.coalesce(F.try_element_at(explicit, F.when(listed, language).otherwise("default")), F.nullif(override, F.lit("")))
    known = F.coalesce(*(F.when(language == k, v) for k, v in fixed.items()), F.lit(default))
    return F.coalesce(own, known)


def models_used(presets: DataFrame) -> DataFrame:
    """(backend_id, model): the distinct models that presets (backend_id, models array) ask for, sorted."""
    return presets.select("backend_id", F.explode("models").alias("model")).where("model is not null and model <> ''").distinct().orderBy("backend_id", "model")


def run_options(presets: DataFrame) -> DataFrame:
    """Presets (preset_id, pipeline, backend_id, options; JSON) as typed options of a run."""
    p = lambda key, kind: F.get_json_object("pipeline", f"$.{key}").cast(kind).alias(key)
    yes = lambda key, default: F.coalesce(F.get_json_object("pipeline", f"$.{key}").cast("boolean"), F.lit(default)).alias(key)
    mode = F.coalesce(F.nullif(F.get_json_object("pipeline", "$.content_mode"), F.lit("")), F.lit("multi-speaker")).alias("content_mode")
    asr = F.nullif(F.get_json_object("options", "$.asr_options"), F.lit("{}")).alias("asr_options")
    return presets.select("preset_id", p("language", "string"), p("min_speakers", "int"), p("max_speakers", "int"), mode, p("duration_limit", "double"), yes("parallel_post_asr", True), yes("skip_alignment", False), yes("skip_diarization", False), "backend_id", asr)


def effective_workers(presets: DataFrame, requested: int) -> DataFrame:
    """(requested, effective, reason): one worker unless all presets (devices array) run on the CPU alone."""
    cpu = F.bool_and(F.forall("devices", lambda d: d == "cpu"))
    n = max(1, requested)
    alone = F.coalesce(cpu, F.lit(True)) | F.lit(n == 1)
    reason = F.when(~alone, "Non-CPU preset detected; compare mode was serialized for stability.")
    return presets.agg(F.lit(n).alias("requested"), F.when(alone, n).otherwise(1).alias("effective"), reason.alias("reason"))


def run_states(runs: DataFrame, meta: DataFrame, progress: DataFrame, errors: DataFrame) -> DataFrame:
    """``runs`` (run_id, ...) with what is known of each: meta's times, the last progress event, the error if there is one.

    meta: (run_id, duration_sec, wall_clock_sec); progress: (run_id, percent, stage), one a run; errors: (run_id, stage,
    error). A run with an error has failed, at the error's stage or the last one that progress tells; others are completed
    and have no failure stage. Whatever is missing is null.
    """
    e = errors.select("run_id", F.col("stage").alias("error_stage"), "error")
    out = runs.join(meta, "run_id", "left").join(progress, "run_id", "left").join(e, "run_id", "left")
    failed = F.col("error").isNotNull() | F.col("error_stage").isNotNull()
    return out.withColumn("status", F.when(failed, "failed").otherwise("completed")).withColumn("failure_stage", F.when(failed, F.coalesce("error_stage", "stage"))).withColumn("realtime_factor", share(F.coalesce("wall_clock_sec", F.lit(0.0)), F.coalesce("duration_sec", F.lit(0.0)))).drop("error_stage", "stage")


def score_rows(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Flat results (variant, item_id, status, ..., wer, cer, cp_wer, der) of runs (preset_id, item_id, status, ...).

    scores: (preset_id, item_id, wer, cer, cp_wer, der) of items with a reference; only completed runs take them.
    """
    kept = [F.when(F.col("status") == "completed", F.col(c)).alias(c) for c in ("wer", "cer", "cp_wer", "der")]
    out = runs.join(scores, ["preset_id", "item_id"], "left")
    return out.select(F.col("preset_id").alias("variant"), "item_id", "status", "realtime_factor", "wall_clock_sec", F.coalesce("fallback_count", F.lit(0)).alias("fallback_count"), "proxy_quality_score", *kept)


def summaries(ranked: DataFrame) -> DataFrame:
    """(experiment_id, n_runs, n_completed, best_preset_id, presets): presets by rank; of runs with ranks."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "preset_id"))), lambda x: x.preset_id)
    return ranked.groupBy("experiment_id").agg(F.count("*").alias("n_runs"), F.count_if(F.col("status") == "completed").alias("n_completed"), F.min_by("preset_id", "rank").alias("best_preset_id"), order.alias("presets"))


def run_manifest(variants: DataFrame, items: DataFrame, runner: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], dry: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Results of all variants on all items and their leaderboard.

    runner: makes ``planned`` rows into runs (preset_id, item_id, status, ...); score: runs into scores, as ``score_rows``
    takes them. With ``dry`` nothing runs: the plan, and no leaderboard.
    """
    plan = planned(variants, items)
    if dry:
        return plan, None
    runs = runner(plan)
    rows = score_rows(runs, score(runs))
    return rows, ranking.leaderboard(rows)


def iso(ts: Column) -> Column:
    """A UTC time as ISO 8601, to microseconds where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts.cast("timestamp")) % 1_000_000
    return F.concat(whole, F.when(micros == 0, "").otherwise(F.format_string(".%06d", micros)), F.lit("+00:00"))


def slug_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


class Stopwatch:
    """Seconds of named stages of a driver's run, six digits; a stage that comes again adds up."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter):
        self.clock, self.seconds = clock, {}

    @contextlib.contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = self.clock()
        try:
            yield
        finally:
            self.seconds[name] = round(self.seconds.get(name, 0.0) + self.clock() - began, 6)
