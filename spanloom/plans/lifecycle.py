"""Queries of the speaker pipeline, stage records, options, experiments and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import experiments, intervals, quality, ranking, speakers, stages, windows
from . import roles
from .registry import BUCKET, query
from .roles import norm, using
from .scores import rate

# ---- speakers

_ASSIGNED = using("seg", "word") + """, dz AS (SELECT meeting_id, CASE WHEN seg_idx % 4 < 2 THEN 'spk_b' ELSE 'spk_a' END AS speaker, s + 900 AS s, e + 900 AS e FROM seg),
o AS (
  SELECT w.meeting_id, w.seg_idx, w.word_idx, z.speaker, sum(least(w.we, z.e) - greatest(w.ws, z.s)) AS ov
  FROM word w JOIN dz z ON z.meeting_id = w.meeting_id AND z.s < w.we AND w.ws < z.e GROUP BY 1, 2, 3, 4
),
b AS (SELECT meeting_id, seg_idx, word_idx, arg_max(speaker, struct_pack(ov := ov, sp := speaker)) AS speaker FROM o GROUP BY 1, 2, 3),
ws AS (SELECT w.*, coalesce(b.speaker, 'SPEAKER_UNKNOWN') AS speaker FROM word w LEFT JOIN b USING (meeting_id, seg_idx, word_idx)),
a AS (SELECT meeting_id, seg_idx, speaker, sum(we - ws) AS t FROM ws GROUP BY 1, 2, 3),
sp AS (SELECT meeting_id, seg_idx, arg_max(speaker, struct_pack(t := t, sp := speaker)) AS speaker FROM a GROUP BY 1, 2),
pos AS (SELECT s.meeting_id, s.seg_idx, s.s, s.e, s.text, sp.speaker, row_number() OVER (PARTITION BY s.meeting_id ORDER BY s.s, s.e, sp.speaker, s.seg_idx) - 1 AS p FROM seg s JOIN sp USING (meeting_id, seg_idx)),
said AS (SELECT meeting_id, p, -1 AS k, speaker FROM pos UNION ALL SELECT pos.meeting_id, p, word_idx, ws.speaker FROM ws JOIN pos USING (meeting_id, seg_idx)),
first_ AS (SELECT meeting_id, speaker, min(p * 100000 + k) AS x FROM said WHERE speaker <> 'SPEAKER_UNKNOWN' GROUP BY 1, 2),
label AS (SELECT meeting_id, speaker, chr((64 + row_number() OVER (PARTITION BY meeting_id ORDER BY x))::INTEGER) AS label FROM first_),
named AS (SELECT pos.*, coalesce(label, pos.speaker) AS who FROM pos LEFT JOIN label USING (meeting_id, speaker)),
words AS (SELECT ws.meeting_id, ws.seg_idx, ws.ws, ws.word || '/' || coalesce(label, ws.speaker) AS w FROM ws LEFT JOIN label ON label.meeting_id = ws.meeting_id AND label.speaker = ws.speaker),
ord AS (SELECT *, row_number() OVER m AS n, lag(who) OVER m AS before FROM named WINDOW m AS (PARTITION BY meeting_id ORDER BY s, e, who, p)),
run AS (SELECT *, sum((before IS DISTINCT FROM who)::INT) OVER (PARTITION BY meeting_id ORDER BY n) AS r FROM ord),
br AS (SELECT *, before IS DISTINCT FROM who OR s - max(e) OVER (PARTITION BY meeting_id, r ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 350 AS cut FROM run),
isl AS (SELECT *, sum(cut::INT) OVER (PARTITION BY meeting_id ORDER BY n) AS i FROM br),
spoken AS (SELECT isl.meeting_id, i, string_agg(words.w, ' ' ORDER BY words.ws) AS spoken, count(*) AS n_words FROM isl JOIN words USING (meeting_id, seg_idx) GROUP BY 1, 2)
SELECT meeting_id, min(p) AS seg_idx, any_value(who) AS speaker, min(s)::DOUBLE AS start, max(e)::DOUBLE AS "end", string_agg(trim(text), ' ' ORDER BY n) AS text, any_value(n_words) AS n_words, any_value(spoken) AS spoken
FROM isl JOIN spoken USING (meeting_id, i) GROUP BY meeting_id, i"""


@query(_ASSIGNED)
def assign_and_build(spark: SparkSession, d: str) -> DataFrame:
    """Segments and words given to two drifting speakers, relabelled, merged across short gaps, put right; words are kept."""
    s = roles.segments(spark, d).where("size(w) > 0")
    diar = s.select("meeting_id", F.when(F.col("seg_idx") % 4 < 2, "spk_b").otherwise("spk_a").alias("speaker"), (F.col("start") + 900).alias("start"), (F.col("end") + 900).alias("end"))
    out = speakers.assign_and_build(s.drop("speaker", "w"), roles.words(s), diar, merge=True, gap=350, label_style="alpha", bucket=BUCKET)
    shown = F.array_join(F.transform("words", lambda w: F.concat(w.word, F.lit("/"), F.coalesce(w.speaker, F.lit("-")))), " ")
    return out.select("meeting_id", F.col("seg_idx").cast("long").alias("seg_idx"), "speaker", "start", "end", "text", F.size("words").cast("long").alias("n_words"), shown.alias("spoken"))


_BROKEN = using("seg", "word") + """, x AS (
  SELECT meeting_id, seg_idx, word_idx, CASE WHEN word_idx % 5 <> 4 THEN ws::DOUBLE END AS ws, CASE WHEN word_idx % 7 = 3 THEN ws - 100.0::DOUBLE ELSE we::DOUBLE END AS we FROM word
),
v AS (SELECT meeting_id, seg_idx, min(ws) AS lo, max(greatest(ws, we)) AS hi, count(*) AS n FROM x WHERE ws IS NOT NULL GROUP BY 1, 2),
y AS (SELECT meeting_id, seg_idx, CASE WHEN seg_idx % 4 <> 1 THEN s + 200.0::DOUBLE END AS s, CASE WHEN seg_idx % 4 = 2 THEN s - 50.0::DOUBLE ELSE e - 300.0::DOUBLE END AS e FROM seg),
z AS (SELECT y.*, lo, hi, coalesce(n, 0) AS n, least(coalesce(y.s, lo, 0.0), coalesce(lo, y.s, 0.0)) AS start FROM y LEFT JOIN v USING (meeting_id, seg_idx))
SELECT meeting_id, seg_idx, start, greatest(coalesce(e, start), start, coalesce(hi, start)) AS "end", n AS n_words FROM z"""


@query(_BROKEN)
def sanitized_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Segments and words with missing starts and ends before starts, put right."""
    s = roles.segments(spark, d)
    start, k = F.col("start").cast("double"), F.col("word_idx")
    w = roles.words(s).select("meeting_id", "seg_idx", "word_idx", F.struct(F.when(k % 5 != 4, start).alias("start"), F.when(k % 7 == 3, start - 100).otherwise(F.col("end").cast("double")).alias("end")).alias("w"))
    nested = w.groupBy("meeting_id", "seg_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "w"))), lambda x: x.w).alias("words"))
    q = F.col("seg_idx") % 4
    broken = s.select("meeting_id", "seg_idx", F.when(q != 1, start + 200).alias("start"), F.when(q == 2, start - 50).otherwise(F.col("end").cast("double") - 300).alias("end")).join(nested, ["meeting_id", "seg_idx"], "left")
    return windows.sanitize(broken).select("meeting_id", "seg_idx", "start", "end", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_words"))


@query(
    using("seg", "word") + """, b AS (SELECT meeting_id, seg_idx, s + 1000 AS s, e - 1000 AS e FROM seg WHERE meeting_id % 3 <> 0 AND s + 1000 <= e - 1000),
i AS (SELECT b.meeting_id, b.seg_idx, b.s, b.e, string_agg(w.word, ' ' ORDER BY w.ws, w.word_idx) AS text FROM b JOIN word w ON w.meeting_id = b.meeting_id AND w.ws >= b.s AND w.we <= b.e GROUP BY 1, 2, 3, 4),
bare AS (SELECT DISTINCT meeting_id FROM seg WHERE meeting_id NOT IN (SELECT meeting_id FROM i)),
t AS (SELECT meeting_id, min(ws) AS s, max(we) AS e, string_agg(word, ' ' ORDER BY ws, word_idx) AS said FROM word GROUP BY 1)
SELECT meeting_id, seg_idx, s::DOUBLE AS start, e::DOUBLE AS "end", text FROM i
UNION ALL SELECT bare.meeting_id, 0, coalesce(s, 0)::DOUBLE, coalesce(e, 0)::DOUBLE, CASE WHEN bare.meeting_id % 2 = 0 THEN 'text of ' || bare.meeting_id ELSE said END FROM bare LEFT JOIN t USING (meeting_id)"""
)
def recognizer_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments from contained words; every third meeting has none of its own and gets one from its words."""
    s = roles.segments(spark, d)
    w = roles.words(s).withColumn("start", F.col("start").cast("double")).withColumn("end", F.col("end").cast("double"))
    narrow = s.where("meeting_id % 3 <> 0").select("meeting_id", "seg_idx", (F.col("start") + 1000.0).alias("start"), (F.col("end") - 1000.0).alias("end"), F.lit("").alias("text"))
    texts = s.select("meeting_id").distinct().withColumn("text", F.when(F.col("meeting_id") % 2 == 0, F.concat(F.lit("text of "), F.col("meeting_id"))))
    return intervals.segments_from_words(texts, narrow, w, BUCKET)


@query(
    using("seg") + """, r AS (SELECT *, CASE seg_idx % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE speaker END AS who, CASE WHEN seg_idx % 5 <> 4 THEN s END AS a, CASE WHEN seg_idx % 7 <> 6 THEN e END AS b FROM seg)
SELECT meeting_id, a AS start, b AS "end", coalesce(nullif(who, ''), 'UNKNOWN') AS speaker FROM r WHERE a IS NOT NULL AND b IS NOT NULL"""
)
def timed_turns(spark: SparkSession, d: str) -> DataFrame:
    """Segments with both times, nameless speakers as UNKNOWN."""
    k = F.col("seg_idx")
    s = roles.segments(spark, d).withColumn("speaker", F.when(k % 3 == 1, "").when(k % 3 == 2, F.col("speaker")))
    return stages.timed(s.withColumn("start", F.when(k % 5 != 4, F.col("start"))).withColumn("end", F.when(k % 7 != 6, F.col("end"))))


@query(
    using("seg") + """, r AS (SELECT meeting_id, seg_idx, CASE WHEN seg_idx % 2 = 0 THEN s END AS s, CASE WHEN seg_idx % 3 = 0 THEN e END AS e, s AS os, e AS oe, speaker FROM seg)
SELECT meeting_id, seg_idx, coalesce(s, CASE WHEN seg_idx % 4 <> 3 THEN os + 5 END, -1) AS start, coalesce(e, CASE WHEN seg_idx % 4 <> 3 THEN oe + 5 END, -1) AS "end", CASE WHEN seg_idx % 5 = 0 THEN 'SPEAKER_UNKNOWN' ELSE speaker END AS speaker FROM r"""
)
def clean_diarization(spark: SparkSession, d: str) -> DataFrame:
    """Records whose times are lifted from a nested segment where they are missing, unnamed speakers as unknown."""
    s, k = roles.segments(spark, d), F.col("seg_idx")
    inner = F.when(k % 4 != 3, F.struct((F.col("start") + 5).alias("start"), (F.col("end") + 5).alias("end")))
    r = s.select("meeting_id", "seg_idx", F.when(k % 5 != 0, F.col("speaker")).alias("speaker"), F.when(k % 2 == 0, F.col("start")).alias("start"), F.when(k % 3 == 0, F.col("end")).alias("end"), inner.alias("segment"))
    known = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return stages.clean_diarization(r).select("meeting_id", "seg_idx", known("start"), known("end"), "speaker")


@query(
    using("seg") + """, m AS (SELECT meeting_id, CASE WHEN meeting_id % 2 = 0 THEN 'single-speaker' ELSE 'multi-speaker' END AS mode, max(e) AS d FROM seg GROUP BY 1)
SELECT s.meeting_id, s.seg_idx, CASE WHEN mode = 'single-speaker' THEN 'SPEAKER_00' ELSE 'SPEAKER_UNKNOWN' END AS speaker, trim(s.text) AS text, d::DOUBLE AS whole FROM seg s JOIN m USING (meeting_id)"""
)
def one_speaker(spark: SparkSession, d: str) -> DataFrame:
    """Turns of runs without diarization, with the length of the synthetic record that stands in for it."""
    s = roles.segments(spark, d)
    mode = F.when(F.col("meeting_id") % 2 == 0, "single-speaker").otherwise("multi-speaker")
    record = stages.synthetic_diarization(s.groupBy("meeting_id").agg(F.max("end").alias("duration"))).select("meeting_id", F.col("end").alias("whole"))
    return stages.one_speaker(s, mode).join(record, "meeting_id").select("meeting_id", "seg_idx", "speaker", "text", "whole")


@query(
    using("seg", "ctc") + """, l AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY s, e, seg_idx) AS n FROM seg),
r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY s, e, seg_idx) AS n FROM ctc WHERE seg_idx % 4 <> 3)
SELECT l.meeting_id, l.seg_idx, CASE WHEN l.seg_idx % 3 = 0 THEN 'own' ELSE CASE WHEN r.n IS NULL THEN NULL ELSE 'from ' || r.seg_idx END END AS source FROM l LEFT JOIN r ON r.meeting_id = l.meeting_id AND r.n = l.n"""
)
def zipped_segments(spark: SparkSession, d: str) -> DataFrame:
    """A column filled in by position from a transcript that lacks some segments."""
    s = roles.segments(spark, d)
    left = s.withColumn("source", F.when(F.col("seg_idx") % 3 == 0, "own"))
    right = roles.ctc(s).where("seg_idx % 4 <> 3").withColumn("source", F.concat(F.lit("from "), F.col("seg_idx")))
    return stages.zipped(left, right, ["source"]).select("meeting_id", "seg_idx", "source")


@query(using("seg") + ' SELECT meeting_id, coalesce(max(CASE WHEN seg_idx % 3 = 0 THEN s WHEN seg_idx % 3 = 1 THEN e END), 0)::BIGINT AS "end" FROM seg GROUP BY 1')
def longest_ends(spark: SparkSession, d: str) -> DataFrame:
    """Where meetings end; a third of their segments have no end, a third no times at all."""
    k = F.col("seg_idx") % 3
    s = roles.segments(spark, d).withColumn("end", F.when(k == 1, F.col("end"))).withColumn("start", F.when(k == 0, F.col("start")))
    out = stages.longest_end(s)
    return out.withColumn("end", F.col("end").cast("long"))


# ---- options and runs

_RUN = """WITH r AS (
  SELECT doc_id AS run_id, CASE WHEN n_chars % 2 = 0 THEN 3 END AS lo, CASE WHEN n_chars % 11 = 0 THEN 9 END AS hi, CASE n_chars % 3 WHEN 0 THEN 'multi-speaker' WHEN 1 THEN 'single-speaker' END AS mode,
    CASE WHEN n_chars % 5 < 3 THEN 'hybrid' ELSE 'other' END AS backend, CASE n_chars % 7 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS skip, n_chars FROM documents
)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return roles.table(spark, d, "documents").select(
        F.col("doc_id").alias("run_id"), F.when(n % 2 == 0, 3).alias("min_speakers"), F.when(n % 11 == 0, 9).alias("max_speakers"), F.when(n % 3 == 0, "multi-speaker").when(n % 3 == 1, "single-speaker").alias("content_mode"),
        F.when(n % 5 < 3, "hybrid").otherwise("other").alias("backend_id"), F.when(n % 7 == 0, True).when(n % 7 > 1, False).alias("skip_diarization"), n.alias("n_chars"),
    )


@query(
    _RUN + """, s AS (SELECT *, coalesce(skip, false) OR coalesce(mode = 'single-speaker', false) AS skips FROM r)
SELECT run_id, coalesce(lo, CASE WHEN NOT skips AND backend = 'hybrid' AND mode = 'multi-speaker' THEN 2 END, -1) AS min_speakers, coalesce(hi, CASE WHEN NOT skips AND backend = 'hybrid' AND mode = 'multi-speaker' THEN 2 END, -1) AS max_speakers, skips FROM s"""
)
def run_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Speaker bounds that hold for runs, and which runs skip diarization."""
    out = stages.speaker_bounds(_runs(spark, d))
    known = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return out.select("run_id", known("min_speakers"), known("max_speakers"), stages.skips_diarization(out).alias("skips"))


@query(_RUN + " SELECT run_id, CASE WHEN n_chars % 4 = 0 AND n_chars % 3 <> 2 THEN 'cuda' ELSE 'cpu' END AS device, CASE WHEN n_chars % 4 = 0 THEN n_chars ELSE CASE WHEN n_chars % 2 = 0 THEN 1 ELSE -1 END END AS batch FROM r")
def promoted_runs(spark: SparkSession, d: str) -> DataFrame:
    """Run records in which a later stage's values win where there are any."""
    n = F.col("n_chars")
    r = _runs(spark, d).withColumn("device", F.lit("cpu")).withColumn("batch", F.when(n % 2 == 0, F.lit(1).cast("long")))
    later = r.where(n % 4 == 0).select("run_id", F.when(n % 3 != 2, "cuda").alias("device"), n.cast("long").alias("batch"))
    return stages.promoted(r, later, ["device", "batch"]).select("run_id", "device", F.coalesce("batch", F.lit(-1)).alias("batch"))


@query(
    """WITH d AS (SELECT doc_id AS id, n_chars AS n FROM documents)
SELECT id, CASE WHEN n % 3 = 0 THEN 0.0::DOUBLE ELSE 20.0::DOUBLE END AS chunk, CASE WHEN n % 5 = 0 THEN 64 ELSE 32 END AS width, CASE WHEN n % 5 = 0 THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END AS alpha, CASE WHEN n % 2 = 0 THEN false ELSE true END AS lm,
  CASE WHEN n % 7 = 0 THEN 'artifact' WHEN n % 4 = 0 THEN 'none' ELSE 'backend' END AS provider, CASE WHEN n % 4 = 0 THEN 'overlap' ELSE 'whisperx' END AS strategy, CASE WHEN n % 3 = 1 THEN 1.5::DOUBLE ELSE 0.35::DOUBLE END AS gap FROM d"""
)
def hybrid_options(spark: SparkSession, d: str) -> DataFrame:
    """A backend's options from JSON, with defaults; zeros and false that are said count."""
    t = roles.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("n"))
    n = F.col("n")
    decoder = F.struct(F.when(n % 5 == 0, 64).alias("beam_width"), F.struct(F.when(n % 2 == 0, False).alias("enabled"), F.when(n % 5 == 0, 0.0).alias("alpha")).alias("lm"))
    options = F.struct(F.struct(F.when(n % 3 == 0, 0.0).alias("chunk_duration_sec"), decoder.alias("decoder")).alias("ctc"), F.when(n % 7 == 0, "a.json").alias("canary_transcript_path"), F.struct(F.when(n % 4 == 0, "none").alias("provider")).alias("canary"), F.when(n % 4 == 0, "overlap").alias("speaker_assignment_strategy"), F.when(n % 3 == 1, 1.5).alias("speaker_merge_gap_sec"))
    e = experiments.effective_options(F.col("options"))
    return t.withColumn("options", F.to_json(options)).select(
        "id", e["ctc.chunk_duration_sec"].alias("chunk"), e["ctc.decoder.beam_width"].alias("width"), e["ctc.decoder.lm.alpha"].alias("alpha"), e["ctc.decoder.lm.enabled"].alias("lm"), e["canary.provider"].alias("provider"),
        e["speaker_assignment_strategy"].alias("strategy"), e["speaker_merge_gap_sec"].alias("gap"),
    )


@query(
    """SELECT doc_id, CASE WHEN lang = 'en' THEN CASE WHEN n_chars % 3 = 0 THEN 'map-en' WHEN n_chars % 2 = 0 THEN 'override' ELSE 'fixed-en' END
  WHEN n_chars % 5 = 0 AND lang <> 'ru' AND lang <> 'uk' THEN 'map-default' WHEN n_chars % 2 = 0 THEN 'override' ELSE 'large' END AS model FROM documents"""
)
def routed_models(spark: SparkSession, d: str) -> DataFrame:
    """The model of each document's language: the map's, the override, the fixed one, the default."""
    n = F.col("n_chars")
    none = F.create_map().cast("map<string,string>")
    said = F.map_concat(F.when(n % 3 == 0, F.create_map(F.lit("en"), F.lit("map-en"))).otherwise(none), F.when(n % 5 == 0, F.create_map(F.lit("default"), F.lit("map-default"))).otherwise(none))
    model = experiments.routed_model(F.col("lang"), said, F.when(n % 2 == 0, "override"), {"en": "fixed-en"}, "large")
    return roles.table(spark, d, "documents").select("doc_id", model.alias("model"))


@query("SELECT DISTINCT source AS backend_id, lang || '-' || (n_chars % 3) AS model FROM documents WHERE n_chars % 2 = 0 UNION SELECT DISTINCT source, 'shared' FROM documents")
def models_used(spark: SparkSession, d: str) -> DataFrame:
    """Distinct models by backend."""
    own = F.when(F.col("n_chars") % 2 == 0, F.concat("lang", F.lit("-"), F.col("n_chars") % 3))
    return experiments.models_used(roles.table(spark, d, "documents").select(F.col("source").alias("backend_id"), F.array(own, F.lit("shared")).alias("models")))


@query(
    """SELECT lpad(doc_id::VARCHAR, 9, '0') AS preset_id, CASE WHEN n_chars % 2 = 0 THEN lang END AS language, CASE WHEN n_chars % 3 = 0 THEN 'single-speaker' ELSE 'multi-speaker' END AS content_mode, CASE WHEN n_chars % 5 = 0 THEN (n_chars % 100)::DOUBLE END AS duration_limit,
  n_chars % 7 <> 0 AS parallel_post_asr, n_chars % 2 = 1 AS skip_alignment, CASE n_chars % 3 WHEN 0 THEN '{"beam":' || (n_chars % 9) || '}' END AS asr_options FROM documents"""
)
def preset_options(spark: SparkSession, d: str) -> DataFrame:
    """Typed run options of presets in JSON; empty recognizer options are none."""
    n = F.col("n_chars")
    pipeline = F.struct(F.when(n % 2 == 0, F.col("lang")).alias("language"), F.when(n % 3 == 0, "single-speaker").when(n % 3 == 1, "").alias("content_mode"), F.when(n % 5 == 0, n % 100).alias("duration_limit"), F.when(n % 7 == 0, False).alias("parallel_post_asr"), (n % 2 == 1).alias("skip_alignment"))
    options = F.when(n % 3 == 0, F.to_json(F.struct(F.struct((n % 9).alias("beam")).alias("asr_options")))).when(n % 3 == 1, '{"asr_options":{}}').otherwise("{}")
    p = roles.table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("preset_id"), F.to_json(pipeline).alias("pipeline"), F.lit("b").alias("backend_id"), options.alias("options"))
    return experiments.run_options(p).select("preset_id", "language", "content_mode", "duration_limit", "parallel_post_asr", "skip_alignment", "asr_options")


@query(
    """WITH v AS (SELECT * FROM (VALUES ('a', NULL), ('b', 60.0::DOUBLE), ('c', 90.0::DOUBLE)) t(preset_id, lim)), i AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN (item_id % 50)::DOUBLE END AS own FROM benchmark)
SELECT preset_id, item_id, coalesce(own, lim) AS duration_limit FROM v, i"""
)
def planned_runs(spark: SparkSession, d: str) -> DataFrame:
    """Three variants on every item; an item's own limit wins."""
    v = spark.createDataFrame([("a", None), ("b", 60.0), ("c", 90.0)], "preset_id string, duration_limit double")
    i = roles.table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, F.col("item_id") % 50).alias("duration_limit"))
    return experiments.planned(v, i).select("preset_id", "item_id", "duration_limit")


@query("""WITH w AS (SELECT count(*) FILTER (n_chars % 997 = 0) AS bad FROM documents)
SELECT 4 AS requested, CASE WHEN bad = 0 THEN 4 ELSE 1 END AS effective, CASE WHEN bad > 0 THEN 'Non-CPU preset detected; compare mode was serialized for stability.' END AS reason FROM w""")
def effective_workers(spark: SparkSession, d: str) -> DataFrame:
    """Workers of an experiment, clamped to one unless all its presets run on the CPU."""
    devices = F.array(F.lit("cpu"), F.when(F.col("n_chars") % 997 == 0, "mps").otherwise("cpu"))
    return experiments.effective_workers(roles.table(spark, d, "documents").select(devices.alias("devices")), 4)


_STATES = """WITH e AS (SELECT user_id AS run_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS stage, arg_max(value, struct_pack(t := ts, i := event_id)) AS percent FROM events GROUP BY 1),
r AS (SELECT d.doc_id AS run_id, n_chars, e.stage, e.percent, l.quality FROM documents d LEFT JOIN e ON e.run_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT run_id, CASE WHEN quality = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN quality = 0 THEN coalesce(CASE WHEN n_chars % 2 = 0 THEN 'align' END, stage) END AS failure_stage, percent,
  CASE WHEN n_chars % 3 = 0 THEN coalesce(round_even((n_chars % 71)::DOUBLE / nullif(n_chars % 13, 0), 6), 0.0) ELSE 0.0 END AS realtime_factor FROM r"""


@query(_STATES)
def run_states(spark: SparkSession, d: str) -> DataFrame:
    """Runs with their meta, last progress event and error, any of which may be missing."""
    from ..sources.writers import latest_events

    docs = roles.table(spark, d, "documents").select(F.col("doc_id").alias("run_id"), "n_chars")
    n = F.col("n_chars")
    meta = docs.where(n % 3 == 0).select("run_id", (n % 13).cast("double").alias("duration_sec"), (n % 71).cast("double").alias("wall_clock_sec"))
    e = roles.table(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("seq"), F.lit("run").alias("status"), F.col("value").alias("percent"), F.col("event_type").alias("stage"), F.lit("").alias("details"))
    errors = docs.join(roles.table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("run_id")), "run_id").select("run_id", F.when(n % 2 == 0, "align").alias("stage"), F.lit("went wrong").alias("error"))
    out = experiments.run_states(docs.select("run_id"), meta, latest_events(e).select("run_id", "percent", "stage"), errors)
    return out.select("run_id", "status", "failure_stage", "percent", "realtime_factor")


@query(
    using("runs") + """ SELECT variant, item_id, status, realtime_factor, wall_clock_sec, CASE WHEN item_id % 4 = 0 THEN 0 ELSE fallback_count END AS fallback_count, proxy_quality_score,
  CASE WHEN status = 'completed' AND item_id % 2 = 0 THEN wer END AS wer, CASE WHEN status = 'completed' AND item_id % 2 = 0 THEN cer END AS cer FROM runs"""
)
def experiment_scores(spark: SparkSession, d: str) -> DataFrame:
    """Flat result rows: scores of completed runs on items with a reference."""
    r = roles.runs(spark, d).withColumnRenamed("variant", "preset_id")
    scores = r.where("item_id % 2 = 0").select("preset_id", "item_id", "wer", "cer", F.lit(None).cast("double").alias("cp_wer"), F.lit(None).cast("double").alias("der"))
    runs = r.drop("wer", "cer").withColumn("fallback_count", F.when(F.col("item_id") % 4 != 0, F.col("fallback_count")))
    return experiments.score_rows(runs, scores).select("variant", "item_id", "status", "realtime_factor", "wall_clock_sec", F.col("fallback_count").cast("long").alias("fallback_count"), "proxy_quality_score", "wer", "cer")


@query(
    using("runs") + """, k AS (SELECT variant AS experiment_id, status, lpad(item_id::VARCHAR, 12, '0') AS p, row_number() OVER (PARTITION BY variant ORDER BY (status <> 'completed')::INT, wer, cer, realtime_factor, fallback_count, skipped_stage_count, wall_clock_sec, -proxy_quality_score, lpad(item_id::VARCHAR, 12, '0')) AS rank FROM runs)
SELECT experiment_id, count(*) AS n_runs, count(*) FILTER (status = 'completed') AS n_completed, arg_min(p, rank) AS best_preset_id, string_agg(p, ',' ORDER BY rank) AS presets FROM k GROUP BY 1"""
)
def experiment_summary(spark: SparkSession, d: str) -> DataFrame:
    """Experiments with their best run and all presets by rank."""
    r = roles.runs(spark, d).withColumn("experiment_id", F.col("variant")).withColumn("preset_id", F.lpad(F.col("item_id").cast("string"), 12, "0"))
    return experiments.summaries(ranking.rank_runs(r, True)).withColumn("presets", F.array_join("presets", ","))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END || '+00:00' AS iso, strftime(ts, '%Y%m%d_%H%M%S') AS slug FROM events")
def run_times(spark: SparkSession, d: str) -> DataFrame:
    """Times as records and folder names show them."""
    return roles.table(spark, d, "events").select("event_id", experiments.iso(F.col("ts")).alias("iso"), experiments.slug_time(F.col("ts")).alias("slug"))


#: The second transcript only leaves words out, so its distance is how many.
_REPORT = using("seg", "ctc") + f""", pair AS (
  SELECT s.meeting_id AS k, {norm("string_agg(trim(s.text), ' ' ORDER BY s.seg_idx)")} AS r, {norm("string_agg(array_to_string(c.w, ' '), ' ' ORDER BY c.seg_idx) FILTER (len(c.w) > 0)")} AS h
  FROM seg s JOIN ctc c USING (meeting_id, seg_idx) GROUP BY 1
), edit AS (SELECT k, len(r) - len(h) AS edits, len(r) AS n, len(h) AS m FROM pair), wer AS (SELECT k AS meeting_id, {rate('edits', 'n', 'm')} AS wer FROM edit),
z AS (SELECT meeting_id, {norm("array_to_string(w, ' ')")} AS t, e - s AS len, speaker FROM ctc),
p AS (SELECT meeting_id, round_even(count(*) FILTER (len(t) = 0 OR len < 350)::DOUBLE / count(*), 6) AS short FROM z GROUP BY 1),
m AS (SELECT DISTINCT meeting_id FROM seg)
SELECT meeting_id, (meeting_id % 50)::DOUBLE AS wall_clock_sec, CASE WHEN meeting_id % 7 = 0 THEN 0.0 ELSE round_even((meeting_id % 50)::DOUBLE / (meeting_id % 7), 6) END AS realtime_factor,
  ((meeting_id % 3 = 0)::BIGINT + (meeting_id % 5 = 0)::BIGINT) AS fallback_count, concat_ws(',', CASE WHEN meeting_id % 2 = 0 THEN 'alignment' END, CASE WHEN meeting_id % 6 = 0 THEN 'diarization' END) AS skipped,
  short AS empty_or_short_segment_ratio, wer FROM m LEFT JOIN p USING (meeting_id) LEFT JOIN wer USING (meeting_id)"""


@query(_REPORT)
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    """All four checks of whole meetings: performance, stability, proxy quality, errors against the reference."""
    s = roles.segments(spark, d)
    heard, m = roles.ctc(s), F.col("meeting_id")
    seconds = heard.withColumn("start", F.col("start") / 1000).withColumn("end", F.col("end") / 1000)
    runs = s.select("meeting_id").distinct().select(
        "meeting_id", F.when(m % 3 == 0, "no gpu").alias("asr_fallback"), F.when(m % 5 == 0, "no model").alias("alignment_fallback"), F.lit("").alias("diarization_fallback"), (m % 2 == 0).alias("skip_alignment"), F.lit(None).cast("string").alias("alignment_skip_reason"),
        F.lit(False).alias("skip_diarization"), F.when(m % 6 == 0, "synthetic_single_speaker").alias("diarization_mode"), (m % 7).cast("double").alias("duration_sec"), (m % 50).cast("double").alias("wall_clock_sec"),
    )
    words = roles.words(s).withColumn("score", F.lit(0.5))
    out = quality.report({"runs": runs, "segments": seconds, "words": words, "reference": s})
    return out.select("meeting_id", "wall_clock_sec", "realtime_factor", "fallback_count", F.array_join("skipped_stages", ",").alias("skipped"), "empty_or_short_segment_ratio", "wer")
