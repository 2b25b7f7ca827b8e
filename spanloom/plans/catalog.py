"""Queries over the driver's tables, each by an operator of the library, with the DuckDB SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus, intervals, merge, quality, ranking, scoring, search, stages, windows
from ..sources import writers
from . import corpora, lifecycle, retrieval, roles, scores  # noqa: F401
from .registry import BUCKET, ORACLES, QUERIES, query  # noqa: F401
from .roles import content, norm, using

@query(f"SELECT doc_id, array_to_string({norm('text')}, ' ') AS normalized FROM documents")
def normalize_default(spark: SparkSession, d: str) -> DataFrame:
    return roles.table(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, array_to_string({norm(chr(39).join(['translate(text, ', 'ёЁ', ', ', 'еЕ', ')']))}, ' ') AS normalized FROM documents")
def normalize_ru_fold(spark: SparkSession, d: str) -> DataFrame:
    return roles.table(spark, d, "documents").select("doc_id", text.normalize(F.col("text"), "ru_fold").alias("normalized"))


@query(f"WITH t AS (SELECT doc_id, {norm('text')} AS w FROM documents) SELECT doc_id, array_to_string(list_filter(w, lambda x, i: i = 1 OR x <> w[i - 1]), ' ') AS collapsed FROM t")
def collapse_repeats(spark: SparkSession, d: str) -> DataFrame:
    return roles.table(spark, d, "documents").select("doc_id", text.normalize(F.col("text"), "ru_fold_repeats").alias("collapsed"))


@query(f"SELECT doc_id, len({content('text')})::BIGINT AS n, len(list_distinct({content('text')}))::BIGINT AS n_distinct FROM documents")
def content_tokens(spark: SparkSession, d: str) -> DataFrame:
    c = text.content_tokens(F.col("text"))
    return roles.table(spark, d, "documents").select("doc_id", F.size(c).cast("long").alias("n"), F.size(F.array_distinct(c)).cast("long").alias("n_distinct"))


_SETS = f"p AS (SELECT s.meeting_id, s.seg_idx, list_distinct({content('s.text')}) AS a, list_distinct({content(chr(39).join(['array_to_string(h.w, ', ' ', ')']))}) AS b FROM seg s JOIN whisper h USING (meeting_id, seg_idx))"


@query(using("seg", "whisper") + f""", {_SETS} SELECT meeting_id, seg_idx, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round_even(len(list_intersect(a, b))::DOUBLE / greatest(len(a), len(b)), 6) END AS overlap, CASE
  WHEN len(b) = 0 THEN 0.0 ELSE round_even(len(list_intersect(a, b))::DOUBLE / len(b), 6) END AS support, (len(b) - len(list_intersect(a, b)))::BIGINT AS unsupported FROM p""")
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = roles.segments(spark, d)
    p = s.join(roles.whisper(s).select("meeting_id", "seg_idx", F.col("text").alias("h")), ["meeting_id", "seg_idx"])
    a, b = text.content_set(F.col("text")), text.content_set(F.col("h"))
    return p.select("meeting_id", "seg_idx", F.bround(text.overlap_ratio(a, b), 6).alias("overlap"), F.bround(text.source_ratio(b, a), 6).alias("support"), text.unsupported(b, a).cast("long").alias("unsupported"))


def _windows(spark: SparkSession, d: str, width: int = 30_000) -> DataFrame:
    s = roles.segments(spark, d)
    return windows.fixed_windows(s.groupBy("meeting_id").agg(F.max("end").alias("duration")), width)


_FIXED = "fx AS (SELECT meeting_id, i AS window_id, i * 30000 AS s, least(d, (i + 1) * 30000) AS e FROM (SELECT meeting_id, max(e) AS d, unnest(range(0, CAST(ceil(max(e) / 30000.0) AS BIGINT))) AS i FROM seg GROUP BY meeting_id))"


@query(using("seg") + f", {_FIXED} SELECT meeting_id, window_id, s::DOUBLE AS start, e::DOUBLE AS \"end\" FROM fx")
def fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).select("meeting_id", F.col("window_id").cast("long").alias("window_id"), "start", "end")


@query(using("seg", "word") + f""", {_FIXED}, piece AS (SELECT x.meeting_id, x.window_id, w.seg_idx, string_agg(w.word, ' ' ORDER BY w.word_idx) AS t FROM fx x
  JOIN word w ON w.meeting_id = x.meeting_id AND w.ws < x.e AND x.s < w.we GROUP BY ALL),
txt AS (SELECT meeting_id, window_id, string_agg(t, ' ' ORDER BY seg_idx) AS t FROM piece GROUP BY ALL)
SELECT x.meeting_id, x.window_id, coalesce(t, '') AS text FROM fx x LEFT JOIN txt USING (meeting_id, window_id)""")
def window_text_join(spark: SparkSession, d: str) -> DataFrame:
    """Words of fixed windows, across the segments that overlap."""
    s = roles.segments(spark, d)
    return intervals.window_text(_windows(spark, d), s, roles.words(s), BUCKET).select("meeting_id", F.col("window_id").cast("long").alias("window_id"), "text")


_DIAR = "SELECT meeting_id, speaker, seg_idx, s + 900 AS s, e + 900 AS e FROM seg"


def _shifted(s: DataFrame) -> DataFrame:
    return s.select("meeting_id", "speaker", (F.col("start") + 900).alias("start"), (F.col("end") + 900).alias("end"))


@query(using("seg", "word") + f""", dz AS ({_DIAR}),
o AS (SELECT w.meeting_id, w.seg_idx, w.word_idx, any_value(w.we - w.ws) AS len, z.speaker, sum(least(w.we, z.e) - greatest(w.ws, z.s)) AS ov FROM word w
  JOIN dz z ON z.meeting_id = w.meeting_id AND z.s < w.we AND w.ws < z.e GROUP BY ALL EXCLUDE (len), 1, 2, 3),
b AS (SELECT meeting_id, seg_idx, word_idx, any_value(len) AS len, arg_max(speaker, struct_pack(ov := ov, sp := speaker)) AS speaker FROM o GROUP BY meeting_id, seg_idx, word_idx),
a AS (SELECT w.meeting_id, w.seg_idx, coalesce(b.speaker, 'SPEAKER_UNKNOWN') AS speaker, sum(w.we - w.ws) AS t FROM word w LEFT JOIN b USING (meeting_id, seg_idx, word_idx) GROUP BY ALL)
SELECT meeting_id, seg_idx, arg_max(speaker, struct_pack(t := t, sp := speaker)) AS speaker FROM a GROUP BY meeting_id, seg_idx""".replace("GROUP BY ALL EXCLUDE (len), 1, 2, 3", "GROUP BY w.meeting_id, w.seg_idx, w.word_idx, z.speaker"))
def assign_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Segments' speakers by their words, against intervals shifted by 0.9 s."""
    s = roles.segments(spark, d)
    return intervals.segment_speakers(s.where("size(w) > 0").drop("w"), roles.words(s), _shifted(s), BUCKET).select("meeting_id", "seg_idx", "speaker")


@query(using("seg") + f""", dz AS ({_DIAR})
SELECT q.meeting_id, q.seg_idx, coalesce(arg_min(z.speaker, struct_pack(s := z.s, e := z.e, sp := z.speaker)), 'SPEAKER_UNKNOWN') AS speaker FROM seg q LEFT
  JOIN dz z ON z.meeting_id = q.meeting_id AND q.s BETWEEN z.s AND z.e GROUP BY q.meeting_id, q.seg_idx""")
def point_speaker(spark: SparkSession, d: str) -> DataFrame:
    """Who speaks at each segment's start."""
    s = roles.segments(spark, d)
    points = s.select("meeting_id", F.col("seg_idx").alias("span_id"), "start", F.col("start").alias("end"))
    return intervals.speakers(points, _shifted(s), BUCKET).select("meeting_id", F.col("span_id").alias("seg_idx"), "speaker")


@query(using("seg") + """, q AS (SELECT meeting_id, seg_idx, s / 1000.0::DOUBLE AS s, CASE WHEN seg_idx % 2 = 0 THEN e / 1000.0::DOUBLE END AS e FROM seg),
t AS (SELECT *, lead(s) OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS nx, coalesce(avg(CASE WHEN e > s THEN e - s END) OVER (PARTITION BY meeting_id), 2.0) AS ty FROM q)
SELECT meeting_id, seg_idx, round_even(CASE WHEN e IS NOT NULL THEN e WHEN nx > s THEN nx ELSE s + ty END, 6) AS \"end\", e IS NULL AS inferred FROM t""")
def infer_ends(spark: SparkSession, d: str) -> DataFrame:
    s = roles.segments(spark, d).select("meeting_id", "seg_idx", F.col("seg_idx").alias("pos"), (F.col("start") / 1000).alias("start"), F.when(F.col("seg_idx") % 2 == 0, F.col("end") / 1000).alias("end"))
    return windows.infer_ends(s).select("meeting_id", "seg_idx", F.bround("end", 6).alias("end"), "inferred")


@query(using("seg") + """, q AS (SELECT meeting_id, seg_idx, s / 1000.0::DOUBLE AS s, lead(s / 1000.0::DOUBLE) OVER (PARTITION BY meeting_id ORDER BY s, seg_idx) AS nx FROM seg),
g AS (SELECT meeting_id, least(15.0, greatest(2.0, median(nx - s))) AS sp FROM q WHERE nx > s GROUP BY 1)
SELECT meeting_id, seg_idx, round_even(coalesce(nx, s + coalesce(sp, 5.0)), 6) AS \"end\" FROM q LEFT JOIN g USING (meeting_id)""")
def review_ends(spark: SparkSession, d: str) -> DataFrame:
    s = roles.segments(spark, d).select("meeting_id", "seg_idx", F.col("seg_idx").alias("pos"), (F.col("start") / 1000).alias("start"), F.lit(None).cast("double").alias("end"), "text")
    return windows.review_ends(s).select("meeting_id", "seg_idx", F.bround("end", 6).alias("end"))


@query(using("talk") + """, o AS (SELECT *, row_number() OVER m AS n, lag(speaker) OVER m AS p FROM talk WINDOW m AS (PARTITION BY meeting_id ORDER BY s, e, speaker, seg_idx)),
r AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM speaker THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY n) AS run FROM o),
b AS (SELECT *, CASE WHEN p IS DISTINCT FROM speaker OR s - max(e) OVER (PARTITION BY meeting_id, run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 1800 THEN 1
  ELSE 0 END AS br FROM r),
i AS (SELECT *, sum(br) OVER (PARTITION BY meeting_id ORDER BY n) AS isl FROM b)
SELECT meeting_id, any_value(speaker) AS speaker, min(s) AS start, max(e) AS \"end\", count(*) AS n_merged, string_agg('said ' || seg_idx, ' ' ORDER BY n) AS text FROM i
  GROUP BY meeting_id, isl""")
def merge_same_speaker(spark: SparkSession, d: str) -> DataFrame:
    """A user's neighbouring intervals of one kind, 30 minutes apart at most, as one."""
    t = roles.talk(spark, d).withColumn("text", F.concat(F.lit("— said "), F.col("seg_idx")))
    first = F.regexp_replace("text", "^— ", "")  # the dash that begins the first text stays
    return windows.merge_turns(t, 1800).select("meeting_id", "speaker", "start", "end", "n_merged", first.alias("text"))


@query(using("talk") + ", f AS (SELECT meeting_id, speaker, min(seg_idx) AS x FROM talk GROUP BY 1, 2) SELECT meeting_id, speaker, chr(CAST(64 + row_number() OVER (PARTITION BY meeting_id ORDER BY x) AS INTEGER)) AS label FROM f")
def alpha_labels(spark: SparkSession, d: str) -> DataFrame:
    return windows.alpha_labels(roles.talk(spark, d)).select("meeting_id", "speaker", "label").distinct()


@query(using("seg") + ", q AS (SELECT meeting_id, seg_idx, len(w) <= 60 AS ok, count(*) FILTER (len(w) <= 60) OVER (PARTITION BY meeting_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) AS c FROM seg) SELECT meeting_id, seg_idx, ok AND c <= 2 AS calls FROM q")
def budget_gate(spark: SparkSession, d: str) -> DataFrame:
    """The first two short segments of each meeting may call a model."""
    s = roles.segments(spark, d)
    return windows.within_budget(s, F.size("w") <= 60, 2, "seg_idx").select("meeting_id", "seg_idx", "calls")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    s = roles.segments(spark, d)
    c, h = roles.ctc(s), roles.whisper(s)
    blank = F.when((F.col("seg_idx") % 5 == 3), "").otherwise(F.col("text"))
    return merge.requests(s.withColumn("text", blank), c, h, bucket=BUCKET)


_J01 = "string_agg(array_to_string(x.w, ' '), ' ' ORDER BY x.s, x.e) FILTER (len(x.w) > 0)"
_REQ = f"""b AS (SELECT meeting_id, seg_idx, s, e, CASE WHEN seg_idx % 5 = 3 THEN '' ELSE array_to_string(w, ' ') END AS c FROM seg),
ct AS (SELECT b.meeting_id, b.seg_idx, {_J01} AS t FROM b JOIN ctc x ON x.meeting_id = b.meeting_id AND x.s < b.e AND b.s < x.e GROUP BY 1, 2),
wt AS (SELECT b.meeting_id, b.seg_idx, {_J01} AS t FROM b JOIN whisper x ON x.meeting_id = b.meeting_id AND x.s < b.e AND b.s < x.e GROUP BY 1, 2),
rq AS (SELECT b.*, coalesce(ct.t, '') AS t, coalesce(wt.t, '') AS h FROM b LEFT JOIN ct USING (meeting_id, seg_idx) LEFT JOIN wt USING (meeting_id, seg_idx))"""


@query(using("seg", "ctc", "whisper") + f", {_REQ} SELECT meeting_id, seg_idx, c AS canary_text, t AS ctc_text, h AS whisper_text FROM rq")
def merge_requests(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).select("meeting_id", "seg_idx", "canary_text", "ctc_text", "whisper_text")


_L = "regexp_matches({0}, '[A-Za-z]')"


@query(using("seg", "ctc", "whisper") + f""", {_REQ}, n AS (SELECT *, CASE WHEN c = '' THEN CASE WHEN {_L.format('t')} THEN 'missing_canary_ctc_anchor' WHEN {_L.format('h')} THEN 'missing_canary_whisper_fallback'
  ELSE 'missing_canary_transcript' END WHEN NOT {_L.format('c')} THEN CASE WHEN {_L.format('t')} THEN 'canary_script_guard_ctc_anchor'
  WHEN {_L.format('h')} THEN 'canary_script_guard_whisper_fallback' ELSE 'language_script_guard_drop' END WHEN t = '' THEN 'missing_ctc_canary_base'
  WHEN NOT {_L.format('t')} THEN 'unexpected_ctc_script_canary_base' WHEN t = c THEN 'canary_ctc_consensus' WHEN t = h THEN 'ctc_whisper_consensus_override'
  ELSE 'rule_based_canary_base' END AS note FROM rq),
o AS (SELECT meeting_id, seg_idx, note, CASE WHEN note LIKE '%ctc_anchor' OR note LIKE '%override' THEN t WHEN note LIKE '%whisper_fallback' THEN h
  WHEN note = 'language_script_guard_drop' THEN '' WHEN note = 'missing_canary_transcript' THEN coalesce(nullif(t, ''), h) ELSE c END AS text FROM n)
SELECT * FROM o WHERE text <> ''""")
def rule_based_merge(spark: SparkSession, d: str) -> DataFrame:
    return merge.merged(_requests(spark, d), F.lit("en")).select("meeting_id", "seg_idx", "note", "text")


_VARIED = """, v AS (
  SELECT *, (we - ws + CASE WHEN seg_idx % 3 = 0 THEN word_idx % 5 * 400 ELSE 0 END) / 1000.0::DOUBLE AS len FROM word
),
k AS (SELECT *, len BETWEEN 0.4 AND 1.2 AS ok FROM v),
f AS (
  SELECT *, count(*) FILTER (ok) OVER m = 4 AND coalesce(var_pop(len) OVER m, 1) < 0.05 AS hit
  FROM k WINDOW m AS (PARTITION BY meeting_id, seg_idx ORDER BY word_idx ROWS 3 PRECEDING)
),
flag AS (SELECT meeting_id, seg_idx, bool_or(hit) AS flagged FROM f GROUP BY 1, 2)"""


def _varied(s: DataFrame) -> DataFrame:
    """Words of 0.4 s; in every third segment lengths vary."""
    length = (F.col("end") - F.col("start") + F.when(F.col("seg_idx") % 3 == 0, F.col("word_idx") % 5 * 400).otherwise(0)) / 1000
    return roles.words(s).withColumn("end", length).withColumn("start", F.lit(0.0))


@query(using("seg", "word") + _VARIED + " SELECT * FROM flag")
def hallucination_flags(spark: SparkSession, d: str) -> DataFrame:
    """Segments with four words in a row of nearly one length."""
    return windows.uniform_words(_varied(roles.segments(spark, d)))


_REPLACED = using("seg", "word", "ctc") + _VARIED + """, x AS (
  SELECT s.meeting_id, s.seg_idx, string_agg(array_to_string(c.w, ' '), ' ' ORDER BY c.s, c.e) FILTER (len(c.w) > 0 AND c.seg_idx % 5 <> 2) AS t
  FROM seg s JOIN ctc c ON c.meeting_id = s.meeting_id AND c.s < s.e AND s.s < c.e AND c.seg_idx % 4 <> 1 GROUP BY 1, 2
),
r AS (
  SELECT s.*, coalesce(flagged, false) AS flagged, coalesce(flagged, false) AND coalesce(t, '') <> '' AS hit, t
  FROM seg s LEFT JOIN x USING (meeting_id, seg_idx) LEFT JOIN flag USING (meeting_id, seg_idx)
)"""


def _replaced(spark: SparkSession, d: str) -> DataFrame:
    """Replacement from a transcript that lacks some segments, or has them without text."""
    s = roles.segments(spark, d)
    ctc = roles.ctc(s).where("seg_idx % 4 <> 1").withColumn("text", F.when(F.col("seg_idx") % 5 == 2, "").otherwise(F.col("text")))
    return merge.replace_uniform(s.drop("w"), _varied(s), ctc, bucket=BUCKET)


@query(
    _REPLACED + """
SELECT meeting_id, seg_idx, CASE WHEN hit THEN t ELSE text END AS text, CASE WHEN flagged THEN 'low' ELSE 'high' END AS confidence, CASE WHEN hit THEN 'ctc_fallback' ELSE 'merged' END AS source FROM r"""
)
def hallucination_replace(spark: SparkSession, d: str) -> DataFrame:
    """Segments whose word times look made up, with the other transcript's text where it has any."""
    return _replaced(spark, d).select("meeting_id", "seg_idx", "text", "confidence", "source")


@query(
    _REPLACED + """
SELECT meeting_id, count(*) AS n, string_agg(s || '-' || e || ' ' || CASE WHEN hit THEN 'uniform_word_durations' ELSE 'uniform_word_durations_no_ctc_text' END, '; ' ORDER BY s, e) AS ranges
FROM r WHERE flagged GROUP BY 1"""
)
def hallucination_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Each meeting's flagged ranges, in order, with what became of them."""
    shown = F.transform("ranges", lambda r: F.concat(r.start.cast("string"), F.lit("-"), r.end.cast("string"), F.lit(" "), r.reason))
    return merge.flagged_ranges(_replaced(spark, d)).select("meeting_id", F.size("ranges").cast("long").alias("n"), F.array_join(shown, "; ").alias("ranges"))


@query(
    using("seg") + r""", q AS (
  SELECT meeting_id, CASE WHEN meeting_id % 2 = 1 THEN 'ru' ELSE 'en' END AS lang, len(w) AS n, CASE WHEN seg_idx % 2 = 0 THEN len(w) ELSE 0 END AS t,
    (meeting_id + seg_idx) % 3 = 0 AND meeting_id % 4 = 1 AS cy, regexp_matches(text, '[A-Za-z]') AS la FROM seg
),
a AS (
  SELECT meeting_id, any_value(lang) AS lang, count(*) AS segment_count, sum(n + cy::BIGINT)::BIGINT AS total_words, sum(t)::BIGINT AS timed_words, count(*) FILTER (t > 0) AS timed_segment_count,
    count(*) FILTER (cy) AS cyrillic_segment_count, count(*) FILTER (la AND NOT cy) AS latin_only_segment_count FROM q GROUP BY 1
),
b AS (SELECT *, CASE WHEN total_words = 0 THEN 0.0 ELSE timed_words::DOUBLE / total_words END AS ratio FROM a),
c AS (
  SELECT *, concat_ws('; ', CASE WHEN lang = 'ru' AND latin_only_segment_count = segment_count THEN 'latin_only_transcript'
      WHEN lang = 'ru' AND latin_only_segment_count >= greatest(2, segment_count // 2) THEN 'predominantly_latin_transcript' END,
    CASE WHEN lang = 'ru' AND cyrillic_segment_count = 0 AND latin_only_segment_count > 0 AND ratio < 0.2 THEN 'alignment_coverage_incompatible_with_transcript' END) AS reasons FROM b
)
SELECT meeting_id, segment_count, total_words, timed_words, timed_segment_count, cyrillic_segment_count, latin_only_segment_count, round_even(ratio, 3) AS timed_word_ratio, reasons,
  CASE WHEN reasons = '' THEN 'accepted_canary' ELSE 'accepted_with_warnings' END AS runtime_decision FROM c
UNION ALL SELECT DISTINCT -1 - meeting_id, 0, 0, 0, 0, 0, 0, 0.0::DOUBLE, 'missing_canary_segments', 'missing_canary' FROM seg WHERE meeting_id % 10 = 0"""
)
def canary_validation(spark: SparkSession, d: str) -> DataFrame:
    """Odd meetings are Russian, every other one of those with some Cyrillic; every tenth has a twin without segments."""
    m, k = F.col("meeting_id"), F.col("seg_idx")
    s = roles.segments(spark, d)
    w = roles.words(s).where("seg_idx % 2 = 0")
    text_ = F.when(((m + k) % 3 == 0) & (m % 4 == 1), F.concat(F.lit("да "), F.col("text"))).otherwise(F.col("text"))
    meetings = s.select("meeting_id").distinct()
    out = merge.validate_base(s.withColumn("text", text_), w, F.when(m % 2 == 1, "ru").otherwise("en"), meetings.union(meetings.where(m % 10 == 0).select(-1 - m)))
    return out.select(
        "meeting_id", "segment_count", "total_words", "timed_words", "timed_segment_count", "cyrillic_segment_count", "latin_only_segment_count", "timed_word_ratio", F.coalesce("fallback_reason", F.lit("")).alias("reasons"), "runtime_decision",
    )


_OV = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({0}, {1}))::DOUBLE / greatest(len({0}), len({1})) END"
_SETS3 = f"st AS (SELECT *, list_distinct({content('c')}) AS a, list_distinct({content('t')}) AS b, list_distinct({content('h')}) AS x FROM rq)"


@query(using("seg", "ctc", "whisper") + f""", {_REQ}, {_SETS3}, v AS (SELECT *, 1.0 - greatest({_OV.format('a', 'b')}, {_OV.format('a', 'x')}) AS gap FROM st
  WHERE c <> '' AND t <> '' AND len(a) >= 3 AND len(b) >= 3 AND greatest(len(a), len(b), len(x)) <= 120),
n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY round_even(gap, 3) DESC, s, seg_idx) AS k FROM v WHERE gap > 0)
SELECT meeting_id, seg_idx, round_even(gap, 3) AS divergence, greatest(len(a), len(b), len(x))::BIGINT AS max_token_count FROM n WHERE k <= 3""")
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return merge.divergent(_requests(spark, d), 120, 3, 3).select("meeting_id", "seg_idx", "divergence", "max_token_count")


@query(
    using("seg", "ctc", "whisper") + f""", {_REQ},
rd AS (SELECT *, CASE seg_idx % 3 WHEN 0 THEN t || ' extra wording' WHEN 1 THEN h ELSE c END AS y FROM rq),
st AS (SELECT *, list_distinct({content('c')}) AS a, list_distinct({content('t')}) AS b, list_distinct({content('h')}) AS x, list_distinct({content('y')}) AS z FROM rd),
su AS (SELECT *, len(list_intersect(z, list_distinct(list_concat(a, list_concat(b, x))))) AS held FROM st)
SELECT meeting_id, seg_idx, round_even(
    2.0 * (CASE WHEN len(z) = 0 THEN 0.0::DOUBLE ELSE held::DOUBLE / len(z) END) + 0.75 * {_OV.format('z', 'a')} + 0.75 * {_OV.format('z', 'b')} + 0.5 * {_OV.format('z', 'x')}
    + (CASE WHEN regexp_matches(y, '[A-Za-z]') THEN 0.5 ELSE -1.0 END) + 0.75 * (CASE WHEN {_OV.format('b', 'x')} >= 0.6 THEN greatest(0.0, {_OV.format('z', 'b')} - {_OV.format('z', 'a')}) ELSE 0.0 END)
    - 0.5 * (len(z) - held), 4) AS score
FROM su"""
)
def decision_score(spark: SparkSession, d: str) -> DataFrame:
    """The scores of decisions for the second text with words of its own, for the third, and for the base text."""
    c, t, h = (F.col(f"{x}_text") for x in ("canary", "ctc", "whisper"))
    k = F.col("seg_idx") % 3
    decided = F.when(k == 0, F.concat(t, F.lit(" extra wording"))).when(k == 1, h).otherwise(c)
    return _requests(spark, d).select("meeting_id", "seg_idx", merge.decision_score(decided, c, t, h, F.lit("en")).alias("score"))


@query(using("seg") + f""", z AS (SELECT meeting_id, seg_idx, e - s AS len, speaker, {norm('text')} AS t, len(w) AS nw FROM seg),
a AS (SELECT meeting_id, count(*) AS n, count(*) FILTER (speaker IN ('user', 'assistant')) AS named, count(*) FILTER (len(t) = 0 OR len < 350) AS sh, sum(nw) AS m FROM z GROUP BY 1),
u AS (SELECT meeting_id, x, count(*) AS c FROM (SELECT meeting_id, unnest(t) AS x FROM z) GROUP BY 1, 2),
r AS (SELECT meeting_id, sum(c) AS al, sum(c - 1) AS ag FROM u GROUP BY 1),
i AS (SELECT meeting_id, count(*) FILTER (i % 4 <> 3) AS timed, sum(i % 3) * 0.25::DOUBLE AS score FROM (SELECT meeting_id, unnest(range(0, nw)) AS i FROM z) GROUP BY 1),
p AS (SELECT a.meeting_id, CASE WHEN m > 0 THEN round_even(timed::DOUBLE / m, 6) ELSE 0.0 END AS tw, CASE WHEN m > 0 THEN round_even(score / m, 6)
  ELSE 0.0 END AS ms, round_even(named::DOUBLE / n, 6) AS ls, round_even(sh::DOUBLE / n, 6) AS es, coalesce(round_even(ag::DOUBLE / al, 6), 0.0) AS rr FROM a LEFT JOIN r USING (meeting_id) LEFT JOIN i USING (meeting_id))
SELECT meeting_id, tw AS timed_word_ratio, ms AS mean_word_score, ls AS labeled_speaker_ratio, es AS empty_or_short_segment_ratio, rr AS repetition_ratio, round_even(tw * 0.35::DOUBLE + ms * 0.25::DOUBLE + ls * 0.20::DOUBLE + (1 - es) * 0.10::DOUBLE + (1 - rr) * 0.10::DOUBLE, 6) AS proxy_quality_score FROM p""")
def proxy_quality(spark: SparkSession, d: str) -> DataFrame:
    s = roles.segments(spark, d)
    k = F.col("word_idx")
    w = roles.words(s).withColumn("score", F.when(k % 3 > 0, k % 3 * 0.25)).withColumn("start", F.when(k % 4 != 3, F.col("start")))
    named = F.when(F.col("speaker").isin("user", "assistant"), F.col("speaker")).otherwise("SPEAKER_UNKNOWN")
    out = quality.proxy_quality(s.withColumn("speaker", named).withColumn("start", F.col("start") / 1000).withColumn("end", F.col("end") / 1000), w)
    return out.select("meeting_id", "timed_word_ratio", "mean_word_score", "labeled_speaker_ratio", "empty_or_short_segment_ratio", "repetition_ratio", "proxy_quality_score")


_LB = "a AS (SELECT variant, count(*) AS n_items, count(*) FILTER (status = 'completed') AS n_completed, round_even(avg(wer) FILTER (status = 'completed'), 6) AS macro_wer, round_even(avg(cer) FILTER (status = 'completed'), 6) AS macro_cer, round_even(avg(realtime_factor) FILTER (status = 'completed'), 6) AS mean_rtf, sum(fallback_count)::BIGINT AS fallbacks FROM runs GROUP BY 1)"


@query(using("runs") + f", {_LB} SELECT *, row_number() OVER (ORDER BY (n_completed <> n_items)::INT, coalesce(macro_wer, 1e9), coalesce(macro_cer, 1e9), coalesce(mean_rtf, 1e9), variant) AS rank FROM a")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return ranking.leaderboard(roles.runs(spark, d)).select("variant", "n_items", "n_completed", "macro_wer", "macro_cer", "mean_rtf", "fallbacks", "rank")


_RK = "SELECT experiment_id, preset_id, row_number() OVER (PARTITION BY experiment_id ORDER BY {0}, preset_id) AS rank FROM (SELECT variant AS experiment_id, lpad(CAST(item_id AS VARCHAR), 12, '0') AS preset_id, * FROM runs)"


def _presets(spark: SparkSession, d: str) -> DataFrame:
    return roles.runs(spark, d).withColumn("experiment_id", F.col("variant")).withColumn("preset_id", F.lpad(F.col("item_id").cast("string"), 12, "0"))


@query(using("runs") + " " + _RK.format("(status <> 'completed')::INT, wer, cer, realtime_factor, fallback_count, skipped_stage_count, wall_clock_sec, -proxy_quality_score"))
def rank_runs_ref(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_runs(_presets(spark, d), True).select("experiment_id", "preset_id", "rank")


@query(using("runs") + " " + _RK.format("(status <> 'completed')::INT, -proxy_quality_score, fallback_count, skipped_stage_count, wall_clock_sec"))
def rank_runs_noref(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_runs(_presets(spark, d), False).select("experiment_id", "preset_id", "rank")


@query(using("runs") + """, a AS (SELECT variant || '_' || (item_id % 40) AS candidate_id, bool_and(status = 'completed') AS ok, avg(wer) AS w, avg(cer) AS c, avg(realtime_factor) AS r, sum(wall_clock_sec) AS wall FROM runs GROUP BY 1),
b AS (SELECT candidate_id, CASE WHEN ok THEN 'completed' ELSE 'failed' END AS status, CASE WHEN ok THEN round_even(w, 6) ELSE 1.0 END AS wer, CASE WHEN ok THEN round_even(c, 6)
  ELSE 1.0 END AS cer, CASE WHEN ok THEN round_even(r, 6) ELSE 1e9 END AS realtime_factor, round_even(wall, 6) AS wall_clock_sec FROM a)
SELECT *, row_number() OVER (ORDER BY (status <> 'completed')::INT, wer, cer, realtime_factor, candidate_id) AS rank FROM b""")
def tuning_rank(spark: SparkSession, d: str) -> DataFrame:
    cases = roles.runs(spark, d).withColumn("candidate_id", F.concat("variant", F.lit("_"), (F.col("item_id") % 40).cast("string")))
    return ranking.tuning_results(cases)


@query("""WITH w AS (SELECT unnest([8, 16, 32]) AS bw),
a AS (SELECT unnest([0.3, 0.5]) AS a),
b AS (SELECT unnest([1.0, 1.5]) AS b)
SELECT 'greedy' AS candidate_id, 'greedy' AS family UNION ALL SELECT 'beam_no_lm_bw' || bw, 'beam_no_lm' FROM w UNION ALL
  SELECT format('beam_{}_bw{}_a{:.2f}_b{:.2f}', k, bw, a::DOUBLE, b::DOUBLE), 'beam_' || k || '_lm' FROM w, a, b, (SELECT unnest(['external', 'self']) AS k)""")
def tuning_grid(spark: SparkSession, d: str) -> DataFrame:
    return ranking.tuning_grid(spark, [8, 16, 32], [0.3, 0.5], [1.0, 1.5]).select("candidate_id", "family")


@query("SELECT doc_id AS item_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    items = roles.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"))
    return ranking.with_hypotheses(items, roles.table(spark, d, "labels").select(F.col("doc_id").alias("item_id")))[1]


_MARKS = r"regexp_replace(regexp_replace(regexp_replace(text, '=+\s*(.*?)\s*=+', ' \1. ', 'g'), '''''+', '', 'g'), '<[^>]+>', ' ', 'g')"
_SENT = rf"trim(regexp_replace(regexp_replace({_MARKS}, '([,.;:!?()«»\"“”„])', ' \1 ', 'g'), '\s+', ' ', 'g'))"
_SPLIT = rf"list_filter(string_split(regexp_replace({_SENT}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) >= 3)"
_PLAIN = rf"pl AS (SELECT source AS label, 1 + (length(source) % 3) AS weight, doc_id, unnest({_SPLIT}) AS sentence FROM documents)"


def _plain(spark: SparkSession, d: str) -> DataFrame:
    docs = roles.table(spark, d, "documents")
    return corpus.corpus_sentences(docs.select(F.col("source").alias("label"), (F.length("source") % 3 + 1).alias("weight"), "doc_id", "text"))


@query(f"WITH {_PLAIN} SELECT label, max(weight)::BIGINT AS weight, count(*) AS raw_sentences, sum(weight)::BIGINT AS weighted_sentences FROM pl GROUP BY 1")
def weighted_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.group_stats(_plain(spark, d)).withColumn("weight", F.col("weight").cast("long"))


@query(f"WITH {_PLAIN}, t AS (SELECT weight, unnest(regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}_\\-]+|[.,;:!?()«»\"“”„]')) AS token FROM pl) SELECT token, sum(weight)::BIGINT AS n FROM t GROUP BY 1 ORDER BY n DESC, token LIMIT 500")
def vocab_topk(spark: SparkSession, d: str) -> DataFrame:
    return corpus.vocabulary(_plain(spark, d), 500)


@query(f"WITH {_PLAIN.replace('unnest(' + _SPLIT + ') AS sentence', 'unnest(' + _SPLIT + ') AS sentence, generate_subscripts(' + _SPLIT + ', 1) - 1 AS pos')} SELECT label, doc_id, pos::INTEGER AS pos, sentence FROM pl ORDER BY label, doc_id, pos LIMIT 120")
def first_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The first 120 sentences over all groups, in their order."""
    docs = roles.table(spark, d, "documents")
    texts = docs.select(F.col("source").alias("label"), (F.length("source") % 3 + 1).alias("weight"), "doc_id", "text")
    return corpus.corpus_sentences(texts, 120).select("label", "doc_id", "pos", "sentence")


@query(f"WITH {_PLAIN} SELECT doc_id, count(*) AS n, sum(length(sentence))::BIGINT AS chars FROM pl GROUP BY 1")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return _plain(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"))


@query(using("seg", "ctc", "whisper") + f", {_FIXED}, " + ", ".join(f"""t_{n} AS (SELECT f.meeting_id, f.window_id, string_agg(array_to_string(x.w, ' '), ' ' ORDER BY x.s, x.e) FILTER (len(x.w) > 0) AS t FROM fx f
  JOIN {n} x ON x.meeting_id = f.meeting_id AND x.s < f.e AND f.s < x.e GROUP BY 1, 2)""" for n in ("seg", "ctc", "whisper")) + """ SELECT meeting_id, window_id, w.t AS whisper, c.t AS ctc, g.t AS clean FROM t_whisper w JOIN t_ctc c USING (meeting_id, window_id) JOIN t_seg g USING (meeting_id, window_id)
  WHERE w.t <> '' AND c.t <> '' AND g.t <> ''""")
def training_pairs_fixed(spark: SparkSession, d: str) -> DataFrame:
    s = roles.segments(spark, d)
    meetings = s.groupBy("meeting_id").agg(F.max("end").alias("duration"))
    return corpus.fixed_pairs(meetings, roles.whisper(s), roles.ctc(s), s, 30_000, BUCKET).select("meeting_id", F.col("window_id").cast("long").alias("window_id"), "whisper", "ctc", "clean")


@query(f"""WITH q AS (SELECT item_id AS query_id, {content('text')} AS terms FROM benchmark),
t AS (SELECT conv_id, turn, {content('text')} AS w FROM conversations),
n AS (SELECT count(*)::DOUBLE AS n, avg(len(w))::DOUBLE AS a FROM t),
u AS (SELECT conv_id, turn, len(w) AS l, unnest(w) AS term FROM t),
tf AS (SELECT conv_id, turn, any_value(l) AS l, term, count(*) AS f FROM u GROUP BY conv_id, turn, term),
df AS (SELECT term, count(*)::DOUBLE AS d FROM tf GROUP BY 1),
qt AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM q),
s AS (SELECT query_id, conv_id, turn, round_even(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM qt JOIN tf USING (term)
  JOIN df USING (term), n GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, conv_id, turn) AS rank FROM s)
SELECT query_id, conv_id AS meeting_id, turn AS seg_idx, score, rank FROM r WHERE rank <= 5""")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """Documented only: keyword search over segments, by all words of each benchmark text."""
    queries = roles.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.content_tokens(F.col("text")).alias("terms"))
    return search.bm25(roles.turns(spark, d).select("meeting_id", "seg_idx", "text"), queries, 5)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, v.vec_id, round_even(list_cosine_similarity(v.embedding::DOUBLE[], q.e::DOUBLE[]), 4) AS score FROM embeddings v, q WHERE v.vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Documented only: nearest vectors of a few."""
    v = roles.table(spark, d, "embeddings")
    return search.cosine(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe")), 5)


@query("SELECT conv_id AS meeting_id, turn AS seg_idx, role AS speaker FROM conversations WHERE role = 'user' ORDER BY conv_id, turn LIMIT 50 OFFSET 20")
def segment_page(spark: SparkSession, d: str) -> DataFrame:
    """Documented only: a page of a speaker's segments."""
    return search.page(roles.turns(spark, d).select("meeting_id", "seg_idx", "speaker"), 50, 20, "user")


@query(using("seg") + """, q AS (SELECT *, s / 1000.0::DOUBLE AS a, e / 1000.0::DOUBLE AS b FROM seg)
SELECT meeting_id, seg_idx, printf('[%02d:%02d:%05.2f -> %02d:%02d:%05.2f] %s: %s', CAST(floor(a / 3600) AS BIGINT), CAST(floor((a % 3600) / 60) AS BIGINT), a % 60, CAST(floor(b / 3600) AS BIGINT), CAST(floor((b % 3600) / 60) AS BIGINT), b % 60, speaker, text) AS line FROM q""")
def transcript_lines(spark: SparkSession, d: str) -> DataFrame:
    s = roles.segments(spark, d).withColumn("start", F.col("start") / 1000).withColumn("end", F.col("end") / 1000)
    return writers.transcript_lines(s)


@query(using("seg") + " SELECT meeting_id, speaker, string_agg(trim(text), ' ' ORDER BY seg_idx) AS text FROM seg WHERE trim(text) <> '' GROUP BY 1, 2")
def text_by_speaker(spark: SparkSession, d: str) -> DataFrame:
    return scoring.by_speaker(roles.segments(spark, d)).select("meeting_id", "speaker", "text")


@query(using("seg") + " SELECT meeting_id, string_agg(trim(text), ' ' ORDER BY seg_idx) AS text FROM seg WHERE trim(text) <> '' GROUP BY 1")
def flat_text(spark: SparkSession, d: str) -> DataFrame:
    return scoring.flat_text(roles.segments(spark, d))


@query(using("seg", "word") + """, b AS (SELECT meeting_id, seg_idx, s + 1000 AS s, e - 1000 AS e FROM seg)
SELECT b.meeting_id, b.seg_idx, coalesce(string_agg(w.word, ' ' ORDER BY w.ws, w.seg_idx, w.word_idx), '') AS text FROM b LEFT
  JOIN word w ON w.meeting_id = b.meeting_id AND w.ws >= b.s AND w.we <= b.e GROUP BY 1, 2""")
def contained_words(spark: SparkSession, d: str) -> DataFrame:
    """Words wholly inside segments that are narrowed by a second on either side."""
    s = roles.segments(spark, d)
    narrow = s.select("meeting_id", "seg_idx", (F.col("start") + 1000).alias("start"), (F.col("end") - 1000).alias("end"), F.lit("").alias("text"))
    return intervals.contained(narrow, roles.words(s), BUCKET).select("meeting_id", "seg_idx", "text")


@query(using("seg") + " SELECT meeting_id, seg_idx, round_even(s / 1000.0::DOUBLE + 12.3456::DOUBLE, 3) AS start, round_even(e / 1000.0::DOUBLE + 12.3456::DOUBLE, 3) AS \"end\" FROM seg")
def shifted_segments(spark: SparkSession, d: str) -> DataFrame:
    s = roles.segments(spark, d).select("meeting_id", "seg_idx", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"))
    return stages.shifted(s, F.lit(12.3456))


@query("SELECT user_id AS run_id, max(event_id) AS seq, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS stage FROM events GROUP BY 1")
def latest_events(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user as a run's state; ids grow with time."""
    e = roles.table(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("seq"), F.lit("run").alias("status"), F.col("value").alias("percent"), F.col("event_type").alias("stage"), F.col("event_id").alias("details"))
    return writers.latest_events(e).select("run_id", F.col("details").alias("seq"), "stage")


@query("WITH a AS (SELECT item_id AS k, text FROM benchmark) SELECT k AS item_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g')))::BIGINT AS n, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed FROM a")
def squeezed(spark: SparkSession, d: str) -> DataFrame:
    s = text.squeeze(F.col("text"))
    return roles.table(spark, d, "benchmark").select("item_id", F.length(s).cast("long").alias("n"), s.alias("squeezed"))


@query(f"""WITH p AS (SELECT item_id % 4 AS v, item_id, {content('text')} AS w FROM benchmark),
q AS (SELECT 'v' || v AS variant, round_even(len(w) / 7.0::DOUBLE, 4) AS score, len(w) / 100.0::DOUBLE AS anchor_overlap, len(w) % 3 AS unsupported, item_id % 2 = 0 AS merged, item_id % 3 = 0 AS changed, item_id FROM p),
a AS (SELECT variant, count(*) AS candidate_count, round_even(avg(score), 4) AS avg_score, sum(unsupported)::BIGINT AS unsupported_token_total, count(*) FILTER (merged) AS llm_accepted_count, count(*) FILTER (changed) AS changed_from_canary_count, min(item_id) AS position FROM q GROUP BY 1)
SELECT * EXCLUDE (position), row_number() OVER (ORDER BY avg_score DESC, unsupported_token_total, llm_accepted_count DESC, position) AS rank FROM a""")
def prompt_summary(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(text.content_tokens(F.col("text")))
    q = roles.table(spark, d, "benchmark").select(F.concat(F.lit("v"), F.col("item_id") % 4).alias("variant"), F.bround(n / 7.0, 4).alias("score"), (n / 100.0).alias("anchor_overlap"), (n % 3).alias("unsupported"), F.when(F.col("item_id") % 2 == 0, "merged").otherwise("canary_base").alias("source"), (F.col("item_id") % 3 == 0).alias("changed"), F.col("item_id").alias("position"))
    return ranking.prompt_summary(q).drop("avg_anchor_overlap")


from . import files, runs, wording  # noqa: E402, F401  their queries build on those above
