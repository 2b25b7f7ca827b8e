"""Queries of text functions, guards of model replies, prompts, and audio samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import merge, prompts, stages, windows
from ..sources import readers, writers
from . import roles
from .catalog import _OV, _REQ, _requests
from .registry import query
from .roles import content, using

# ---- text functions


@query(
    r"""WITH t AS (SELECT doc_id, '▁' || replace(text, ' ', '▁') || ' ⁇ <unk> ( x ) , y !' AS t FROM documents),
s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '⁇|<unk>|▁', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM t)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '\s+([,.;:!?%)\]}»])', '\1', 'g'), '([(\[{«])\s+', '\1', 'g'), '\s+', ' ', 'g')) AS cleaned FROM s"""
)
def decoded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a decoder would give them, cleaned up."""
    raw = F.concat(F.lit("▁"), F.replace("text", F.lit(" "), F.lit("▁")), F.lit(" ⁇ <unk> ( x ) , y !"))
    return roles.table(spark, d, "documents").select("doc_id", text.clean_decoded(raw).alias("cleaned"))


@query(r"WITH s AS (SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._\-]+', '_', 'g'), '^[._\-]+|[._\-]+$', '', 'g') AS s FROM pages) SELECT page_id, CASE WHEN s = '' THEN 'case' ELSE s END AS slug FROM s")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return roles.table(spark, d, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query(
    r"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ru' WHEN 1 THEN 'UK' ELSE 'en' END AS lang, CASE WHEN doc_id % 5 = 0 THEN text || ' да' WHEN doc_id % 7 = 0 THEN regexp_replace(text, '[A-Za-z]', '', 'g') ELSE text END AS t FROM documents)
SELECT doc_id, lang <> 'en' AND NOT regexp_matches(t, '[А-Яа-яЁёІіЇїЄєҐґ]') AND len(regexp_extract_all(t, '[A-Za-z]')) >= 6 AS looks_foreign,
  CASE WHEN trim(t) = '' THEN false WHEN lang = 'en' THEN regexp_matches(t, '[A-Za-z]') ELSE regexp_matches(t, '[А-Яа-яЁёІіЇїЄєҐґ]') END AS has_script FROM t"""
)
def script_flags(spark: SparkSession, d: str) -> DataFrame:
    """Which texts look foreign for their language, and which have a letter of its script."""
    k = F.col("doc_id")
    lang = F.when(k % 3 == 0, "ru").when(k % 3 == 1, "UK").otherwise("en")
    t = F.when(k % 5 == 0, F.concat("text", F.lit(" да"))).when(k % 7 == 0, F.regexp_replace("text", "[A-Za-z]", "")).otherwise(F.col("text"))
    return roles.table(spark, d, "documents").select("doc_id", text.looks_foreign(t, lang).alias("looks_foreign"), text.has_script(t, lang).alias("has_script"))


@query(f"WITH t AS (SELECT doc_id, {content('text')} AS w FROM documents) SELECT doc_id, len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) > 0 AS repeats FROM t")
def adjacent_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which a content word comes twice in a row."""
    return roles.table(spark, d, "documents").select("doc_id", text.has_adjacent_repeat(F.col("text")).alias("repeats"))


_FEW = ", ".join(f"'{w}'" for w in text.LOW_INFORMATION)


@query(f"""WITH t AS (SELECT item_id, 'ну ' || replace(text, ' ', ' не ') AS text FROM benchmark),
u AS (SELECT item_id, {content('text')} AS w FROM t)
SELECT item_id, array_to_string(list_filter(w, lambda x: x NOT IN ({_FEW})), ' ') AS kept, len(w)::BIGINT AS n FROM u""")
def meaningful_words(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts with little words put in between, and these taken out again."""
    mixed = F.concat(F.lit("ну "), F.replace("text", F.lit(" "), F.lit(" не ")))
    t = roles.table(spark, d, "benchmark").select("item_id", mixed.alias("t"))
    return t.select("item_id", F.array_join(text.meaningful_tokens(F.col("t")), " ").alias("kept"), F.size(text.content_tokens(F.col("t"))).cast("long").alias("n"))


@query("WITH t AS (SELECT item_id, list_filter(list_transform(string_split(CASE WHEN item_id % 5 <> 4 THEN replace(text, ' ', ' , ') || ',,' ELSE '' END, ','), lambda w: trim(w)), lambda w: w <> '') AS w FROM benchmark) SELECT item_id, len(w)::BIGINT AS n, array_to_string(w, '|') AS words FROM t")
def hot_word_lists(spark: SparkSession, d: str) -> DataFrame:
    """Words for a decoder from comma-separated lists, some of which are missing."""
    raw = F.when(F.col("item_id") % 5 != 4, F.concat(F.replace("text", F.lit(" "), F.lit(" , ")), F.lit(",,")))
    return roles.table(spark, d, "benchmark").select("item_id", F.size(text.hot_words(raw)).cast("long").alias("n"), F.array_join(text.hot_words(raw), "|").alias("words"))


@query(
    """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN trim(text) WHEN 1 THEN trim(text) WHEN 2 THEN trim(text) || ' end' WHEN 3 THEN trim(text) ELSE '' END AS text FROM conversations"""
)
def model_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Texts from five shapes of a model's output: an object, its second key, chunks, a list, and none."""
    k, t = F.col("turn") % 5, F.col("text")
    shape = (
        F.when(k == 0, F.to_json(F.struct(F.concat(F.lit(" "), t, F.lit(" ")).alias("text"))))
        .when(k == 1, F.to_json(F.struct(F.lit("").alias("text"), t.alias("prediction"))))
        .when(k == 2, F.to_json(F.struct(F.array(F.struct(t.alias("text")), F.struct(F.lit("end").alias("text"))).alias("chunks"))))
        .when(k == 3, F.to_json(F.array(F.struct(t.alias("text")))))
    )
    return roles.table(spark, d, "conversations").select("conv_id", "turn", stages.output_text(shape).alias("text"))


@query(
    f"""WITH t AS (SELECT item_id, list_sort(list_distinct({content('text')})) AS w FROM benchmark),
p AS (SELECT item_id, list_concat(list_concat(['<unk>', ' '], w), CASE WHEN item_id % 2 = 0 THEN ['<blank>'] ELSE [] END) AS p FROM t),
l AS (SELECT item_id, list_transform(p, lambda x: CASE x WHEN '<unk>' THEN '▁⁇▁' WHEN '<blank>' THEN '' WHEN ' ' THEN '▁' ELSE x END) AS l FROM p)
SELECT item_id, array_to_string(CASE WHEN item_id % 2 = 0 THEN l ELSE list_concat(l, ['']) END, '|') AS labels FROM l"""
)
def decoder_labels(spark: SparkSession, d: str) -> DataFrame:
    """Decoder labels of vocabularies with a blank of their own, and of those that get one."""
    words, even = F.array_sort(text.content_set(F.col("text"))), F.col("item_id") % 2 == 0
    pieces = F.concat(F.array(F.lit("<unk>"), F.lit(" ")), words, F.when(even, F.array(F.lit("<blank>"))).otherwise(F.array().cast("array<string>")))
    t = roles.table(spark, d, "benchmark").select("item_id", pieces.alias("p"), F.size(words).alias("n"))
    return t.select("item_id", F.array_join(stages.decoder_labels(F.col("p"), F.col("n") + 3), "|").alias("labels"))


@query(
    r"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?…]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM conversations)
SELECT conv_id AS meeting_id, turn AS chunk, coalesce(right(regexp_replace(lag(s[-1]) OVER (PARTITION BY conv_id ORDER BY turn), '^[\p{P}\s]+', ''), 40), '-') AS prompt FROM s"""
)
def carried_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The end of the sentence before, for each turn."""
    t = roles.table(spark, d, "conversations").select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("chunk"), "text")
    return windows.carried_prompt(t, 40).select("meeting_id", "chunk", F.coalesce("prompt", F.lit("-")).alias("prompt"))


# ---- guards, prompts and the ladder of a model's merge decisions

_SETS = f"st AS (SELECT *, list_distinct({content('c')}) AS a, list_distinct({content('t')}) AS b, list_distinct({content('h')}) AS x FROM rq)"
_REPLY = "CASE seg_idx % 6 WHEN 0 THEN '' WHEN 1 THEN 'plainly unrelated wording here' WHEN 2 THEN c || ' one two three four five six' WHEN 3 THEN t WHEN 4 THEN 'ctc: ' || h ELSE h END"
_LANG = "CASE WHEN meeting_id % 2 = 0 THEN 'en' ELSE 'ru' END"


def _replied(spark: SparkSession, d: str) -> DataFrame:
    c, t, h, k = F.col("canary_text"), F.col("ctc_text"), F.col("whisper_text"), F.col("seg_idx") % 6
    reply = F.when(k == 0, "").when(k == 1, "plainly unrelated wording here").when(k == 2, F.concat(c, F.lit(" one two three four five six"))).when(k == 3, t).when(k == 4, F.concat(F.lit("ctc: "), h)).otherwise(h)
    return _requests(spark, d).withColumn("reply", reply).withColumn("language", F.when(F.col("meeting_id") % 2 == 0, "en").otherwise("ru"))


_GUARD = f"""CASE WHEN trim(y) = '' THEN 'empty_ollama_response' WHEN lang = 'ru' AND len(regexp_extract_all(y, '[A-Za-z]')) >= 6 THEN 'language_script_guard_ollama'
  WHEN len(z) >= 3 AND len(list_intersect(z, list_concat(a, list_concat(b, x))))::DOUBLE / len(z) < 0.5 THEN 'low_anchor_overlap_ollama' WHEN len(z) > greatest(len(a), len(b), len(x)) + 3 THEN 'candidate_too_long_ollama' ELSE '' END"""


@query(using("seg", "ctc", "whisper") + f", {_REQ}, {_SETS}, q AS (SELECT *, {_REPLY} AS y, {_LANG} AS lang FROM st), r AS (SELECT *, list_distinct({content('y')}) AS z FROM q) SELECT meeting_id, seg_idx, {_GUARD} AS why FROM r")
def reply_guards(spark: SparkSession, d: str) -> DataFrame:
    """Why replies of a merge model can't be taken."""
    why = merge.guard_reply(F.col("reply"), F.col("canary_text"), F.col("ctc_text"), F.col("whisper_text"), F.col("language"))
    return _replied(spark, d).select("meeting_id", "seg_idx", F.coalesce(why, F.lit("")).alias("why"))


@query(
    using("seg", "ctc", "whisper") + f""", {_REQ}, q AS (SELECT *, {_REPLY} AS y, {_LANG} AS lang FROM rq),
r AS (SELECT *, {content('y')} AS z, {content('c')} AS k, {content('t')} AS a, {content('h')} AS b, y <> c AND y <> t AND y <> h AS new FROM q)
SELECT meeting_id, seg_idx, concat_ws(',', CASE WHEN trim(y) = '' THEN 'empty_candidate' END, CASE WHEN trim(y) <> '' AND lang = 'ru' THEN 'unexpected_script' END, CASE WHEN regexp_matches(y, '(?i)\\b(ctc|whisper)\\b') THEN 'prompt_leak' END,
  CASE WHEN new AND len(z) >= 3 AND len(list_intersect(list_distinct(z), list_concat(a, b)))::DOUBLE / len(list_distinct(z)) < 0.5 THEN 'low_anchor_overlap' END,
  CASE WHEN new AND len(z) > greatest(len(k), len(a), len(b), 1) + 3 THEN 'candidate_too_long' END) AS reasons FROM r"""
)
def candidate_checks(spark: SparkSession, d: str) -> DataFrame:
    """Reasons against a corrector's candidates."""
    why = merge.candidate_problems(F.col("reply"), F.col("canary_text"), F.col("ctc_text"), F.col("whisper_text"), F.col("language"))
    return _replied(spark, d).select("meeting_id", "seg_idx", F.array_join(why, ",").alias("reasons"))


@query(
    using("seg") + f""", k AS (SELECT *, seg_idx % 5 + 2 AS n FROM seg), i AS (SELECT *, unnest(range(0, (len(w) + n - 1) // n)) AS piece FROM k),
p AS (SELECT meeting_id, seg_idx, piece, array_to_string(w[piece * n + 1:piece * n + n], ' ') AS t,
  CASE WHEN piece % 3 = 0 THEN array_to_string(w[piece * n + 1:piece * n + n], ' ') || '!' ELSE array_to_string(w[piece * n + 1:piece * n + n + 1], ' ') END AS h FROM i),
q AS (SELECT *, {content('t')} AS a, {content('h')} AS b FROM p)
SELECT meeting_id, seg_idx, piece, t <> '' AND h <> '' AND t <> h AND {_OV.format('list_distinct(a)', 'list_distinct(b)')} >= 0.8 AND abs(len(a) - len(b)) <= 2 AND greatest(len(a), len(b)) <= 5 AS tried, 'ctc: ' || t || ' whisper: ' || h AS asked FROM q"""
)
def corrections_tried(spark: SparkSession, d: str) -> DataFrame:
    """All turns in pieces of a few words, heard twice: those that nearly agree, for which a corrector is asked, and what it is asked."""
    n = (F.col("seg_idx") % 5 + 2).cast("int")
    s = roles.segments(spark, d).withColumn("n", n).where("size(w) > 0")
    s = s.select("meeting_id", "seg_idx", "w", "n", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / F.col("n")).cast("int"))).alias("piece"))
    words = lambda more: F.array_join(F.slice("w", F.col("piece") * F.col("n") + 1, F.col("n") + more), " ")
    s = s.select("meeting_id", "seg_idx", F.col("piece").cast("long").alias("piece"), words(0).alias("t"), F.when(F.col("piece") % 3 == 0, F.concat(words(0), F.lit("!"))).otherwise(words(1)).alias("h"))
    return s.select("meeting_id", "seg_idx", "piece", merge.worth_correcting(F.col("t"), F.col("h"), F.lit("en")).alias("tried"), merge.corrector_input(F.col("t"), F.col("h")).alias("asked"))


_LADDER = f"""n AS (SELECT *, CASE WHEN c = '' THEN CASE WHEN regexp_matches(t, '[A-Za-z]') THEN 'missing_canary_ctc_anchor' WHEN regexp_matches(h, '[A-Za-z]') THEN 'missing_canary_whisper_fallback' ELSE 'missing_canary_transcript' END
  WHEN NOT regexp_matches(c, '[A-Za-z]') THEN 'guard' WHEN t = '' THEN 'missing_ctc_canary_base' WHEN NOT regexp_matches(t, '[A-Za-z]') THEN 'unexpected_ctc_script_canary_base'
  WHEN t = c THEN 'canary_ctc_consensus' WHEN t = h THEN 'ctc_whisper_consensus_override' ELSE 'rule_based_canary_base' END AS rule, CASE WHEN seg_idx % 4 = 3 THEN NULL ELSE {_REPLY} END AS y, 'en' AS lang FROM st),
m AS (SELECT *, list_distinct({content("coalesce(y, '')")}) AS z, rule = 'rule_based_canary_base' AND greatest(len(a), len(b), len(x)) <= 40 AS fits FROM n),
f AS (SELECT *, fits AND count(*) FILTER (fits) OVER (PARTITION BY meeting_id ORDER BY s, e, seg_idx ROWS UNBOUNDED PRECEDING) <= 2 AS calls FROM m),
g AS (SELECT *, CASE WHEN c = '' AND t = '' AND h = '' THEN 'empty_inputs' WHEN rule <> 'rule_based_canary_base' THEN rule WHEN NOT fits THEN 'ollama_segment_budget_canary_base' WHEN NOT calls THEN 'ollama_call_budget_canary_base'
  WHEN y IS NULL THEN 'ollama_fallback' ELSE {_GUARD} END AS note FROM f)"""


@query(using("seg", "ctc", "whisper") + f""", {_REQ}, {_SETS}, {_LADDER} SELECT meeting_id, seg_idx, calls, note, CASE WHEN note = '' THEN trim(y) WHEN rule LIKE '%ctc_anchor' OR rule LIKE '%override' THEN t
  WHEN rule LIKE '%whisper_fallback' THEN h WHEN rule = 'missing_canary_transcript' THEN '' ELSE c END AS text FROM g""")
def llm_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Merge decisions with a model's replies for the first two requests of up to 40 words of each meeting."""
    asked = _replied(spark, d)
    replies = asked.where("seg_idx % 4 <> 3").select("meeting_id", "seg_idx", "reply", F.lit(False).alias("failed"))
    out = merge.with_replies(asked.drop("reply", "language"), F.lit("en"), most_tokens=40, budget=2, replies=replies)
    return out.select("meeting_id", "seg_idx", "calls", F.coalesce("note", F.lit("")).alias("note"), "text")


def _prompt_sql(name: str, rules: str) -> str:
    shown = lambda c: f"CASE WHEN {c} = '' THEN '[empty]' ELSE {c} END"
    said = rules.replace("'", "''")
    return f"""'You are correcting one ' || l || ' transcript segment.' || chr(10) || 'Goal: produce the final transcript text for exactly this segment.' || chr(10) || 'Base transcript [Canary]: ' || {shown('c')} || chr(10) || 'Truth anchor [CTC]: ' || {shown('t')}
  || chr(10) || 'Auxiliary transcript [Whisper]: ' || {shown('h')} || chr(10) || 'Instruction profile [{name}]:' || chr(10) || '{said}' || chr(10) || 'Output corrected ' || l || ' only. No commentary.'"""


@query(using("seg", "ctc", "whisper") + f", {_REQ}, q AS (SELECT *, CASE meeting_id % 3 WHEN 0 THEN 'English' WHEN 1 THEN 'Russian' ELSE 'fr' END AS l FROM rq) " + " UNION ALL ".join(f"SELECT meeting_id, seg_idx, '{n}' AS variant, {_prompt_sql(n, r)} AS prompt, 'm|0|1|96|false|false|true' AS call FROM q" for n, r in [*prompts.INSTRUCTIONS.items(), ("custom", "Keep it as it is.")]))
def merge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """All requests under each named variant, and under instructions of one's own."""
    asked = _requests(spark, d)
    lang = F.when(F.col("meeting_id") % 3 == 0, "en").when(F.col("meeting_id") % 3 == 1, "RU").otherwise("fr")
    out = None
    for name in [*prompts.INSTRUCTIONS, "custom"]:
        made = prompts.prompts(asked, lang, "m", None if name == "custom" else name.upper(), " Keep it\n as it is. " if name == "custom" else None)
        said = lambda key: F.get_json_object("payload", f"$.{key}")
        call = F.concat_ws("|", *(said(k) for k in ("model", "options.temperature", "options.top_k", "options.num_predict", "stream", "think")), (said("prompt") == F.col("prompt")).cast("string"))
        one = made.select("meeting_id", "seg_idx", F.lit(name).alias("variant"), "prompt", call.alias("call"))
        out = one if out is None else out.unionByName(one)
    return out


# ---- audio: sample i of a turn is made from its character i, exactly a multiple of 1/128

_WAVE = "w AS (SELECT conv_id * 1000 + turn AS id, turn, list_transform(string_split(text, ''), lambda c: CASE WHEN turn % 6 = 5 THEN 0.0 ELSE (ascii(c) * 37 % 300 - 150) / 128.0::DOUBLE END) AS x FROM conversations)"


def _audio(spark: SparkSession, d: str) -> DataFrame:
    sample = lambda c: F.when(F.col("turn") % 6 == 5, 0.0).otherwise((F.ascii(c) * 37 % 300 - 150) / 128.0).cast("float")
    t = roles.table(spark, d, "conversations")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("path"), F.transform(F.filter(F.split("text", ""), lambda c: c != ""), sample).alias("samples"))


@query(f"""WITH {_WAVE}, y AS (SELECT id, list_transform(x, lambda v: round_even(greatest(-1.0, least(1.0, v)) * 32767, 0) / 32768) AS y FROM w)
SELECT id::VARCHAR AS path, len(y)::BIGINT AS n, round_even(list_sum(y)::DOUBLE, 6) AS total, round_even(len(y) / 16000.0::DOUBLE, 6) AS duration FROM y""")
def wav_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Samples written as WAV files and read again: clipped, and quantized with both scales."""
    back = readers.decoded_wav(writers.wav_bytes(_audio(spark, d)))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return back.select("path", F.size("samples").cast("long").alias("n"), F.bround(total, 6).alias("total"), F.bround("duration", 6).alias("duration"))


@query(
    f"""WITH {_WAVE}, c AS (SELECT id, x[1:100] AS x FROM w)
SELECT id::VARCHAR AS path, len(x)::BIGINT AS n, len(x) / 16000.0::DOUBLE AS duration, len(list_filter(x, lambda v: abs(v) > 0.00001)) > 0 AS voiced, round_even(sqrt(list_sum(list_transform(x, lambda v: v * v))::DOUBLE / len(x) + 1e-8::DOUBLE), 9) AS rms FROM c"""
)
def audio_measures(spark: SparkSession, d: str) -> DataFrame:
    """Audio cut to its first 100 samples: length, whether it is silent, and its loudness."""
    a = readers.clipped(_audio(spark, d), 100 / 16000)
    return a.select("path", F.size("samples").cast("long").alias("n"), "duration", readers.voiced(F.col("samples")).alias("voiced"), F.bround(readers.rms(F.col("samples").cast("array<double>")), 9).alias("rms"))


@query(
    f"""WITH {_WAVE} SELECT id::VARCHAR AS path, len(x)::BIGINT AS n, len(list_filter(x, lambda v: abs(v) > 0.00001)) > 0 AS voiced, round_even(sqrt(list_sum(list_transform(x, lambda v: v * v))::DOUBLE / len(x) + 1e-8::DOUBLE), 9) AS rms FROM w"""
)
def audio_levels(spark: SparkSession, d: str) -> DataFrame:
    """Whether whole recordings are silent, and their loudness."""
    a = _audio(spark, d)
    return a.select("path", F.size("samples").cast("long").alias("n"), readers.voiced(F.col("samples")).alias("voiced"), F.bround(readers.rms(F.col("samples").cast("array<double>")), 9).alias("rms"))


@query(
    f"""WITH {_WAVE}, k AS (SELECT id, x, unnest(range(0, (len(x) + 79) // 80)) AS k FROM w)
SELECT id::VARCHAR AS path, k AS chunk, round_even(k * 80 / 16000.0::DOUBLE, 3) AS start, round_even(least(len(x), (k + 1) * 80) / 16000.0::DOUBLE, 3) AS "end", list_sum(x[k * 80 + 1:(k + 1) * 80])::DOUBLE AS total FROM k"""
)
def audio_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 80 samples, the last one short."""
    c = readers.audio_chunks(_audio(spark, d), 80 / 16000)
    return c.select("path", F.col("chunk").cast("long").alias("chunk"), "start", "end", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(
    f"""WITH {_WAVE}, r AS (SELECT id, x, unnest([2, 1]) AS source, unnest([1, 4]) AS target FROM w),
g AS (SELECT *, unnest(range(0, CASE WHEN len(x) = 0 THEN 0 ELSE greatest(1, CAST(round_even(len(x) * target / source::DOUBLE, 0) AS BIGINT)) END)) * source / target::DOUBLE AS t FROM r),
v AS (SELECT *, CAST(floor(t) AS BIGINT) AS i FROM g)
SELECT id::VARCHAR AS path, target, count(*) AS n, sum(CASE WHEN i + 2 > len(x) THEN x[len(x)] ELSE x[i + 1] + (x[i + 2] - x[i + 1]) * (t - i) END)::DOUBLE AS total FROM v GROUP BY 1, 2"""
)
def resampled_audio(spark: SparkSession, d: str) -> DataFrame:
    """Half and four times the rate, by linear interpolation; the last value holds."""
    out = None
    for source, target in ((2, 1), (1, 4)):
        a = stages.resampled(_audio(spark, d), source, target).where("size(samples) > 0").withColumn("target", F.lit(target))
        out = a if out is None else out.unionByName(a)
    return out.select("path", "target", F.size("samples").cast("long").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total"))
