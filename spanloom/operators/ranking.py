"""Leaderboards, tuning grids and rankings; every order ends in a key that makes it total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _mean(c: str, where: Column) -> Column:
    return F.bround(F.avg(F.when(where, F.col(c))), 6)


def leaderboard(rows: DataFrame) -> DataFrame:
    """Results (variant, item_id, status, wer, cer, realtime_factor, proxy_quality_score, fallback_count) by variant, ranked.

    Means are over completed items that have a value, fallbacks over all. Complete variants come first; then by wer, cer,
    speed if any variant has a wer, else by proxy score and fallbacks; then by name. The one-row flag of which order holds
    is a window over variants, not rows.
    """
    done = F.col("status") == "completed"
    for c in ("cp_wer", "der"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("double"))
    agg = rows.groupBy("variant").agg(
        F.count("*").alias("n_items"), F.count_if(done).alias("n_completed"), _mean("wer", done).alias("macro_wer"), _mean("cer", done).alias("macro_cer"), _mean("cp_wer", done).alias("macro_cp_wer"), _mean("der", done).alias("mean_der"),
        _mean("realtime_factor", done).alias("mean_rtf"), _mean("proxy_quality_score", done).alias("proxy"), F.sum(F.coalesce("fallback_count", F.lit(0))).alias("fallbacks"),
    )
    scored = agg.withColumn("__ref", F.max(F.col("macro_wer").isNotNull()).over(Window.partitionBy()))
    far = lambda c: F.coalesce(F.col(c), F.lit(1e9))
    when = lambda a, b: F.when(F.col("__ref"), a).otherwise(b)
    order = [F.when(F.col("n_completed") == F.col("n_items"), 0).otherwise(1), when(far("macro_wer"), -F.coalesce("proxy", F.lit(-1.0))), when(far("macro_cer"), F.col("fallbacks").cast("double")), when(far("mean_rtf"), F.lit(0.0)), F.col("variant")]
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).drop("__ref")


def rank_runs(runs: DataFrame, has_reference: bool) -> DataFrame:
    """Runs of an experiment, best first: completed ones, then by error or by proxy score, speed, stability, name."""
    z = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    first, proxy = F.when(F.col("status") == "completed", 0).otherwise(1), -z("proxy_quality_score", 0.0)
    with_ref = [first, z("wer", 1.0), z("cer", 1.0), z("realtime_factor", 0.0), z("fallback_count", 0), z("skipped_stage_count", 0), z("wall_clock_sec", 0.0), proxy, F.col("preset_id")]
    without = [first, proxy, z("fallback_count", 0), z("skipped_stage_count", 0), z("wall_clock_sec", 0.0), F.col("preset_id")]
    return runs.withColumn("rank", F.row_number().over(Window.partitionBy("experiment_id").orderBy(*(with_ref if has_reference else without))).cast("long"))


def tuning_results(cases: DataFrame) -> DataFrame:
    """Candidates' means over cases, ranked; one case that failed fails its candidate: wer and cer 1, rtf 1e9."""
    agg = cases.groupBy("candidate_id").agg(F.bool_and(F.coalesce(F.col("status") == "completed", F.lit(False))).alias("ok"), *(F.avg(c).alias(f"a_{c}") for c in ("wer", "cer", "realtime_factor")), F.sum(F.coalesce("wall_clock_sec", F.lit(0.0))).alias("wall"))
    out = agg.select("candidate_id", F.when(F.col("ok"), "completed").otherwise("failed").alias("status"), *(F.when(F.col("ok"), F.bround(F.col(f"a_{c}"), 6)).otherwise(F.lit(d)).alias(c) for c, d in (("wer", 1.0), ("cer", 1.0), ("realtime_factor", 1e9))), F.bround("wall", 6).alias("wall_clock_sec"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.when(F.col("status") == "completed", 0).otherwise(1), "wer", "cer", "realtime_factor", "candidate_id")).cast("long"))


def tuning_grid(spark: SparkSession, widths: list[int], alphas: list[float], betas: list[float], external: bool = True) -> DataFrame:
    """(candidate_id, family, beam_width, alpha, beta): greedy, beams without a model, and all combinations with one."""
    one = spark.range(1)
    greedy = one.select(F.lit("greedy").alias("candidate_id"), F.lit("greedy").alias("family"), F.lit(None).cast("int").alias("beam_width"), F.lit(None).cast("double").alias("alpha"), F.lit(None).cast("double").alias("beta"))
    w = one.select(F.explode(F.array(*map(F.lit, widths))).alias("beam_width"))
    plain = w.select(F.format_string("beam_no_lm_bw%d", "beam_width").alias("candidate_id"), F.lit("beam_no_lm").alias("family"), "beam_width", F.lit(None).cast("double").alias("alpha"), F.lit(None).cast("double").alias("beta"))
    grid = w.withColumn("alpha", F.explode(F.array(*(F.lit(float(a)) for a in alphas)))).withColumn("beta", F.explode(F.array(*(F.lit(float(b)) for b in betas))))
    out = greedy.union(plain)
    for kind in ("external", "self") if external else ("self",):
        out = out.union(grid.select(F.format_string(f"beam_{kind}_bw%d_a%.2f_b%.2f", "beam_width", "alpha", "beta"), F.lit(f"beam_{kind}_lm"), "beam_width", "alpha", "beta"))
    return out


def grid_values(raw: str, kind: type = float) -> list:
    """Comma-separated numbers; empty parts are dropped, nothing left is an error."""
    out = [kind(x) for x in raw.split(",") if x.strip()]
    if not out:
        raise ValueError("a grid needs at least one value")
    return out


def prompt_summary(decisions: DataFrame) -> DataFrame:
    """Prompt variants' mean scores over decisions (variant, score, anchor_overlap, unsupported, source, changed), ranked."""
    agg = decisions.groupBy("variant").agg(F.count("*").alias("candidate_count"), F.bround(F.avg("score"), 4).alias("avg_score"), F.bround(F.avg("anchor_overlap"), 4).alias("avg_anchor_overlap"), F.sum("unsupported").cast("long").alias("unsupported_token_total"), F.count_if(F.col("source") == "merged").alias("llm_accepted_count"), F.count_if("changed").alias("changed_from_canary_count"), F.min("position").alias("position"))
    return agg.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("avg_score"), "unsupported_token_total", F.desc("llm_accepted_count"), "position")).cast("long")).drop("position")


def with_hypotheses(items: DataFrame, hypotheses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with their hypothesis, and those without any."""
    return items.join(hypotheses, "item_id"), items.join(hypotheses, "item_id", "left_anti")
