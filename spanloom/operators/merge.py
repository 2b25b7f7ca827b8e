"""Choosing one text from competing transcripts: rules, guards and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CYRILLIC, LATIN, content_set, content_tokens, has_script, looks_foreign, overlap_ratio, source_ratio, squeeze, unsupported
from .intervals import BUCKET, window_text
from .windows import uniform_words, within_budget


def decide(canary: Column, ctc: Column, whisper: Column, language: Column) -> Column:
    """struct<text, confidence, source, note> by fixed rules: the base text unless it is missing, of the wrong script, or
    two other transcripts agree against it."""
    c, t, w = squeeze(canary), squeeze(ctc), squeeze(whisper)
    c_ok, t_ok, w_ok = has_script(c, language), has_script(t, language), has_script(w, language)

    def made(text: Column, source: str, note: str, confidence: str = "high") -> Column:
        return F.struct(text.alias("text"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), F.lit(note).alias("note"))

    def instead(kind: str, otherwise: str) -> Column:
        return F.when((t != "") & t_ok, made(t, "ctc_anchor", f"{kind}_ctc_anchor")).when((w != "") & w_ok, made(w, "whisper_fallback", f"{kind}_whisper_fallback")).otherwise(made(F.lit(""), "merged", otherwise, "low"))

    return (
        F.when(c == "", instead("missing_canary", "missing_canary_transcript"))
        .when(~c_ok, instead("canary_script_guard", "language_script_guard_drop"))
        .when(t == "", made(c, "canary_base", "missing_ctc_canary_base"))
        .when(~t_ok, made(c, "canary_base", "unexpected_ctc_script_canary_base"))
        .when(t == c, made(c, "canary_base", "canary_ctc_consensus"))
        .when((w != "") & w_ok & (t == w), made(t, "ctc_consensus_override", "ctc_whisper_consensus_override"))
        .otherwise(made(c, "canary_base", "rule_based_canary_base"))
    )


def requests(base: DataFrame, ctc: DataFrame, whisper: DataFrame, ctc_words: DataFrame | None = None, whisper_words: DataFrame | None = None, bucket: float | None = BUCKET) -> DataFrame:
    """Base segments (meeting_id, seg_idx, start, end, text) with the texts of both others over the same time."""
    w = base.select("meeting_id", F.col("seg_idx").alias("window_id"), "start", "end", squeeze(F.col("text")).alias("canary_text"))
    c = window_text(w, ctc, ctc_words, bucket).select("meeting_id", "window_id", F.col("text").alias("ctc_text"))
    h = window_text(w, whisper, whisper_words, bucket).select("meeting_id", "window_id", F.col("text").alias("whisper_text"))
    return w.join(c, ["meeting_id", "window_id"]).join(h, ["meeting_id", "window_id"]).withColumnRenamed("window_id", "seg_idx")


def merged(asked: DataFrame, language: Column) -> DataFrame:
    """``requests`` with their decisions; an empty decision falls back to any text unless a script guard made it; rows
    without text go."""
    out = asked.withColumn("d", decide(F.col("canary_text"), F.col("ctc_text"), F.col("whisper_text"), language))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    text = F.when(F.col("d.text") != "", F.col("d.text")).when(F.col("d.note") == "language_script_guard_drop", "").otherwise(F.coalesce(some("canary_text"), some("ctc_text"), some("whisper_text"), F.lit("")))
    return out.select("meeting_id", "seg_idx", "start", "end", text.alias("text"), "d.confidence", "d.source", "d.note").where("text <> ''")


def replace_uniform(segments: DataFrame, words: DataFrame, ctc: DataFrame, ctc_words: DataFrame | None = None, bucket: float | None = BUCKET) -> DataFrame:
    """Segments whose word times look made up get the other transcript's text: confidence low, source ctc_fallback.

    Without such text they keep their own, low where nothing is set. ``flagged`` and ``reason`` tell.
    """
    for c in ("confidence", "source"):
        segments = segments if c in segments.columns else segments.withColumn(c, F.lit(None).cast("string"))
    marked = segments.join(uniform_words(words), ["meeting_id", "seg_idx"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    open_ = marked.where("flagged").select("meeting_id", F.col("seg_idx").alias("window_id"), "start", "end")
    found = window_text(open_, ctc, ctc_words, bucket).select("meeting_id", F.col("window_id").alias("seg_idx"), F.col("text").alias("__ctc"))
    out = marked.join(found, ["meeting_id", "seg_idx"], "left")
    hit = F.coalesce(F.col("flagged") & (F.col("__ctc") != ""), F.lit(False))
    return (
        out.withColumn("text", F.when(hit, F.col("__ctc")).otherwise(F.col("text")))
        .withColumn("confidence", F.when(hit, "low").otherwise(F.coalesce("confidence", F.when(F.col("flagged"), "low").otherwise("high"))))
        .withColumn("source", F.when(hit, "ctc_fallback").otherwise(F.coalesce("source", F.lit("merged"))))
        .withColumn("reason", F.when(hit, "uniform_word_durations").when(F.col("flagged"), "uniform_word_durations_no_ctc_text"))
        .drop("__ctc")
    )


def flagged_ranges(marked: DataFrame) -> DataFrame:
    """(meeting_id, ranges): the flagged segments of ``replace_uniform`` as sorted (start, end, reason)."""
    one = F.struct("start", "end", "reason")
    return marked.where("flagged").groupBy("meeting_id").agg(F.array_sort(F.collect_list(one)).alias("ranges"))


def validate_base(segments: DataFrame, words: DataFrame, language: Column, meetings: DataFrame | None = None) -> DataFrame:
    """Per meeting: counts, the share of timed words, and whether the base transcript is accepted, with reasons.

    meetings: (meeting_id) of all meetings; those without a segment are missing their base. language is a segment's own or
    fixed.
    """
    timed = words.where("start is not null and end is not null").groupBy("meeting_id", "seg_idx").agg(F.count("*").alias("timed"))
    text = squeeze(F.col("text"))
    each = segments.withColumn("lang", language).join(timed, ["meeting_id", "seg_idx"], "left").select(
        "meeting_id", "lang", F.when(text == "", 0).otherwise(F.size(F.split(text, " "))).alias("words"), F.coalesce("timed", F.lit(0)).alias("timed"), text.rlike(CYRILLIC).alias("cyr"), text.rlike(LATIN).alias("lat"),
    )
    sums = each.groupBy("meeting_id").agg(F.first("lang").alias("lang"), F.count("*").alias("segment_count"), F.sum("words").cast("long").alias("total_words"), F.sum("timed").cast("long").alias("timed_words"), F.count_if(F.col("timed") > 0).alias("timed_segment_count"), F.count_if(F.col("cyr")).alias("cyrillic_segment_count"), F.count_if(F.col("lat") & ~F.col("cyr")).alias("latin_only_segment_count"))
    if meetings is not None:
        sums = meetings.select("meeting_id").join(sums, "meeting_id", "left").fillna(0)
    none = F.col("segment_count") == 0
    ratio = F.when(F.col("total_words") > 0, F.col("timed_words") / F.col("total_words")).otherwise(0.0)
    guarded, latin = F.coalesce(F.lower("lang").isin("ru", "uk"), F.lit(False)), F.col("latin_only_segment_count")
    reasons = F.array_compact(F.array(
        F.when(none, "missing_canary_segments"),
        F.when(guarded & ~none & (latin == F.col("segment_count")), "latin_only_transcript").when(guarded & ~none & (latin >= F.greatest(F.lit(2), F.floor(F.col("segment_count") / 2))), "predominantly_latin_transcript"),
        F.when(guarded & (F.col("cyrillic_segment_count") == 0) & (latin > 0) & (ratio < 0.2), "alignment_coverage_incompatible_with_transcript"),
    ))
    out = sums.withColumn("timed_word_ratio", F.bround(ratio, 3)).withColumn("__r", reasons).withColumn("accepted", F.size("__r") == 0)
    decision = F.when(none, "missing_canary").when(F.col("accepted"), "accepted_canary").otherwise("accepted_with_warnings")
    return out.withColumn("runtime_decision", decision).withColumn("fallback_reason", F.nullif(F.array_join("__r", "; "), F.lit(""))).drop("__r", "lang")


def divergent(asked: DataFrame, most_tokens: int = 18, least_tokens: int = 3, limit: int = 8) -> DataFrame:
    """Per meeting, the requests in which the base differs most from both others, up to ``limit`` (1 at least)."""
    c, t, w = (content_set(F.col(f"{x}_text")) for x in ("canary", "ctc", "whisper"))
    out = asked.withColumn("__c", c).withColumn("__t", t).withColumn("__w", w)
    longest = F.greatest(F.size("__c"), F.size("__t"), F.size("__w"))
    gap = 1.0 - F.greatest(overlap_ratio(F.col("__c"), F.col("__t")), overlap_ratio(F.col("__c"), F.col("__w")))
    out = out.where((F.col("canary_text") != "") & (F.col("ctc_text") != "") & (F.size("__c") >= least_tokens) & (F.size("__t") >= least_tokens) & (longest <= most_tokens)).withColumn("gap", gap).where("gap > 0")
    out = out.withColumn("divergence", F.bround("gap", 3)).withColumn("max_token_count", longest.cast("long"))
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy(F.desc("divergence"), "start", "seg_idx"))
    return out.withColumn("n", n).where(F.col("n") <= max(1, limit)).drop("__c", "__t", "__w", "gap")


def decision_score(text: Column, canary: Column, ctc: Column, whisper: Column, language: Column) -> Column:
    """A decision's score: support by the sources, agreement with each, script, gain by consensus, less unsupported words."""
    x, c, t, w = (content_set(s) for s in (text, canary, ctc, whisper))
    gain = F.when(overlap_ratio(t, w) >= 0.6, F.greatest(F.lit(0.0), overlap_ratio(x, t) - overlap_ratio(x, c))).otherwise(0.0)
    total = 2.0 * source_ratio(x, c, t, w) + 0.75 * overlap_ratio(x, c) + 0.75 * overlap_ratio(x, t) + 0.5 * overlap_ratio(x, w) + F.when(has_script(text, language), 0.5).otherwise(-1.0) + 0.75 * gain - 0.5 * unsupported(x, c, t, w)
    return F.bround(total, 4)


def guard_reply(reply: Column, canary: Column, ctc: Column, whisper: Column, language: Column) -> Column:
    """Why a model's reply can't be taken, or null: empty, foreign, without support in the sources, or too long."""
    x, *sources = (content_set(s) for s in (reply, canary, ctc, whisper))
    return (
        F.when(squeeze(reply) == "", "empty_ollama_response")
        .when(looks_foreign(reply, language), "language_script_guard_ollama")
        .when((F.size(x) >= 3) & (source_ratio(x, *sources) < 0.5), "low_anchor_overlap_ollama")
        .when(F.size(x) > F.greatest(*(F.size(s) for s in sources)) + 3, "candidate_too_long_ollama")
    )


def _script_or_other(text: Column, language: Column) -> Column:
    """The script test for ru and uk alone; any text passes for other languages."""
    return ~F.coalesce(F.lower(language).isin("ru", "uk"), F.lit(False)) | has_script(text, language)


def candidate_problems(candidate: Column, canary: Column, ctc: Column, whisper: Column, language: Column) -> Column:
    """Reasons against a corrector's candidate; support and length count only for one that equals no source."""
    x = squeeze(candidate)
    new = ~((x == squeeze(canary)) | (x == squeeze(ctc)) | (x == squeeze(whisper)))
    c, k, a, b = (content_tokens(s) for s in (candidate, canary, ctc, whisper))
    return F.array_compact(F.array(
        F.when(x == "", "empty_candidate"),
        F.when((x != "") & ~_script_or_other(x, language), "unexpected_script"),
        F.when(x.rlike(r"(?i)\b(ctc|whisper)\b"), "prompt_leak"),
        F.when(new & (F.size(c) >= 3) & (source_ratio(F.array_distinct(c), a, b) < 0.5), "low_anchor_overlap"),
        F.when(new & (F.size(c) > F.greatest(F.size(k), F.size(a), F.size(b), F.lit(1)) + 3), "candidate_too_long"),
    ))


def worth_correcting(ctc: Column, whisper: Column, language: Column) -> Column:
    """Whether a corrector is asked: two short texts of the right script that nearly agree."""
    a, b = squeeze(ctc), squeeze(whisper)
    n, m = F.size(content_tokens(a)), F.size(content_tokens(b))
    return (a != "") & (b != "") & (a != b) & _script_or_other(a, language) & _script_or_other(b, language) & (overlap_ratio(content_set(a), content_set(b)) >= 0.8) & (F.abs(n - m) <= 2) & (F.greatest(n, m) <= 5)


def with_replies(asked: DataFrame, language: Column, most_tokens: int = 12, budget: int = 8, replies: DataFrame | None = None) -> DataFrame:
    """``requests`` decided by rules first, then by a model's replies (meeting_id, seg_idx, reply, failed) within budget.

    ``calls`` says which rows a model is asked for. Rules settle missing or wrong-script texts and agreements; longer
    segments and calls beyond the budget keep the rules' choice, and so does a reply that ``guard_reply`` rejects. The
    model runs between two plans: ask for the rows that call, then pass the replies.
    """
    c, t, w = (F.col(f"{x}_text") for x in ("canary", "ctc", "whisper"))
    out = asked.withColumn("d", decide(c, t, w, language))
    longest = F.greatest(*(F.size(content_set(x)) for x in (c, t, w)))
    blank = (c == "") & (t == "") & (w == "")
    open_ = (F.col("d.note") == "rule_based_canary_base") & ~blank
    fits = open_ & (longest <= most_tokens)
    out = within_budget(out.withColumn("fits", fits).withColumn("open", open_), F.col("fits"), budget, "start", "end", "seg_idx")
    if replies is None:
        replies = asked.sparkSession.createDataFrame([], f"meeting_id {dict(asked.dtypes)['meeting_id']}, seg_idx {dict(asked.dtypes)['seg_idx']}, reply string, failed boolean")
    out = out.join(replies, ["meeting_id", "seg_idx"], "left")
    why = F.coalesce(guard_reply(F.coalesce("reply", F.lit("")), c, t, w, language), F.lit(""))
    why = F.when(F.coalesce("failed", F.col("reply").isNull()), "ollama_fallback").otherwise(why)
    note = F.when(blank, "empty_inputs").when(~F.col("open"), F.col("d.note")).when(~F.col("fits"), "ollama_segment_budget_canary_base").when(~F.col("calls"), "ollama_call_budget_canary_base").when(why != "", why)
    took = note.isNull()
    return out.select("meeting_id", "seg_idx", "start", "end", "calls", F.when(took, squeeze(F.col("reply"))).otherwise(F.col("d.text")).alias("text"), F.when(took, "high").otherwise(F.col("d.confidence")).alias("confidence"), F.when(took, "merged").otherwise(F.col("d.source")).alias("source"), note.alias("note"))


def corrector_input(ctc: Column, whisper: Column) -> Column:
    return F.concat(F.lit("ctc: "), squeeze(ctc), F.lit(" whisper: "), squeeze(whisper))
