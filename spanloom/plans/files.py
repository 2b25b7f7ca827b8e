"""Queries that write files in each format and read them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..operators import corpus, ranking, scoring
from ..sources import readers, reviews, writers
from ..sources.scratch import scratch
from . import roles
from .catalog import _PLAIN, _RK, _SPLIT
from .registry import BUCKET, query
from .roles import using
from .wording import _WAVE, _audio

def _id() -> Column:
    return F.col("meeting_id").cast("string")


def _seconds(s: DataFrame) -> DataFrame:
    return s.withColumn("start", F.col("start") / 1000).withColumn("end", F.col("end") / 1000)


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    s = _seconds(roles.segments(spark, d)).withColumn("confidence", F.when(F.col("seg_idx") % 2 == 0, "low")).withColumn("source", F.lit(None).cast("string"))
    w = _seconds(roles.words(roles.segments(spark, d))).withColumn("score", F.when(F.col("word_idx") % 2 == 0, 0.25)).withColumn("speaker", F.lit(None).cast("string"))
    meetings = s.groupBy("meeting_id").agg(F.max("end").alias("duration")).withColumn("language", F.lit("en"))
    return writers.nested(s.drop("w"), w, meetings)


def _as_files(rows: DataFrame, content: Column, suffix: str = ".json") -> DataFrame:
    return rows.select(F.concat(_id(), F.lit(suffix)).alias("path"), content.alias("content"))


@query(
    using("seg") + """ SELECT meeting_id::VARCHAR AS meeting_id, seg_idx::INTEGER AS seg_idx, speaker, s / 1000.0::DOUBLE AS start, e / 1000.0::DOUBLE AS "end", text, CASE WHEN seg_idx % 2 = 0 THEN 'low' ELSE '-' END AS confidence, len(w)::INTEGER AS n_words,
  ((len(w) + 1) // 2) * 0.25::DOUBLE AS score FROM seg"""
)
def transcript_files(spark: SparkSession, d: str) -> DataFrame:
    """A JSON file for each meeting, written and read: absent optional fields are null again, absent scores 0."""
    t, folder = _transcripts(spark, d), scratch(spark, "transcripts")
    writers.write_files(_as_files(t, F.to_json(F.struct("language", "duration", "segments"))), folder)
    back = readers.read_transcripts(spark, folder)
    words = readers.words_of(back).groupBy("meeting_id", "seg_idx").agg(F.count("*").cast("int").alias("n_words"), F.sum("score").alias("score"))
    out = readers.segments_of(back).join(words, ["meeting_id", "seg_idx"], "left")
    return out.select("meeting_id", "seg_idx", "speaker", "start", "end", "text", F.coalesce("confidence", F.lit("-")).alias("confidence"), F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("score", F.lit(0.0)).alias("score"))


_REFS = using("seg") + """, r AS (
  SELECT meeting_id::VARCHAR AS meeting_id, (row_number() OVER (PARTITION BY meeting_id ORDER BY seg_idx) - 1)::INTEGER AS pos, speaker, CASE meeting_id % 3 WHEN 2 THEN -1.0 ELSE s / 1000.0::DOUBLE END AS start,
    CASE meeting_id % 3 WHEN 0 THEN e / 1000.0::DOUBLE ELSE -1.0 END AS "end", trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, CASE meeting_id % 3 WHEN 0 THEN 'transcript' WHEN 1 THEN 'list' ELSE 'text' END AS kind FROM seg
)"""


def _references(spark: SparkSession, d: str) -> DataFrame:
    t, folder = _transcripts(spark, d), scratch(spark, "references")
    t = t.withColumn("segments", F.transform("segments", lambda s: s.withField("text", squeeze(s.text))))
    k = F.col("meeting_id") % 3
    writers.write_files(_as_files(t.where(k == 0), F.to_json(F.struct("language", "duration", "segments"))), folder)
    items = F.to_json(F.transform("segments", lambda s: F.struct(s.speaker.alias("speaker"), s.start.cast("string").alias("start_sec"), s.text.alias("text"))))
    writers.write_files(_as_files(t.where(k == 1), items), folder)
    lines = writers.transcript_texts(_seconds(roles.segments(spark, d)).where(k == 2).withColumn("text", squeeze(F.col("text"))))
    writers.write_files(_as_files(lines, F.concat("text", F.lit("\n\n")), ".txt"), folder)
    return readers.read_references(spark, folder)


@query(_REFS + " SELECT * FROM r")
def reference_files(spark: SparkSession, d: str) -> DataFrame:
    """References in three shapes: transcripts, bare lists without ends, lines of text."""
    known = lambda c: F.coalesce(c, F.lit(-1.0)).alias(c)
    return _references(spark, d).select("meeting_id", "pos", "speaker", known("start"), known("end"), F.trim("text").alias("text"), "kind")


@query(_REFS + " SELECT meeting_id, string_agg(text, ' ' ORDER BY pos) AS text FROM r WHERE text <> '' GROUP BY 1")
def reference_texts(spark: SparkSession, d: str) -> DataFrame:
    """The flat texts of reference files."""
    return scoring.flat_text(_references(spark, d).withColumnRenamed("pos", "seg_idx"))


@query(
    using("seg", "ctc", "whisper") + """, f AS (SELECT meeting_id, i, i * 30000 AS s, least(d, (i + 1) * 30000) AS e FROM (SELECT meeting_id, max(e) AS d, unnest(range(0, CAST(ceil(max(e) / 30000.0) AS BIGINT))) AS i FROM seg GROUP BY 1)), """
    + ", ".join(f"t_{n} AS (SELECT f.meeting_id, f.i, string_agg(array_to_string(x.w, ' '), ' ' ORDER BY x.s, x.e) FILTER (len(x.w) > 0) AS t FROM f JOIN {n} x ON x.meeting_id = f.meeting_id AND x.s < f.e AND f.s < x.e GROUP BY 1, 2)" for n in ("seg", "ctc", "whisper"))
    + " SELECT c.t AS ctc, w.t AS whisper, g.t AS clean, s::DOUBLE AS start_sec, e::DOUBLE AS end_sec, CASE WHEN i % 2 = 0 THEN 'chunk_' || i ELSE '-' END AS chunk_id FROM f JOIN t_whisper w USING (meeting_id, i) JOIN t_ctc c USING (meeting_id, i) JOIN t_seg g USING (meeting_id, i) WHERE w.t <> '' AND c.t <> '' AND g.t <> ''"
)
def pair_files(spark: SparkSession, d: str) -> DataFrame:
    """Training pairs as JSON lines, where a null id vanishes, and back."""
    s, folder = roles.segments(spark, d), scratch(spark, "pairs")
    pairs = corpus.fixed_pairs(s.groupBy("meeting_id").agg(F.max("end").alias("duration")), roles.whisper(s), roles.ctc(s), s, 30_000, BUCKET)
    writers.write_pairs(pairs.withColumn("chunk_id", F.when(F.col("window_id") % 2 == 0, F.concat(F.lit("chunk_"), F.col("window_id")))), folder)
    return readers.read_jsonl(spark, folder, "ctc string, whisper string, clean string, start_sec double, end_sec double, chunk_id string").withColumn("chunk_id", F.coalesce("chunk_id", F.lit("-")))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'case-' || doc_id ELSE 'a_' || doc_id END AS case_id, 'audio/a ' || doc_id || '.wav' AS audio_path, 'ref/' || doc_id || '.json' AS reference_path, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 90)::DOUBLE ELSE -1.0 END AS duration_limit FROM documents")
def tuning_files(spark: SparkSession, d: str) -> DataFrame:
    """Tuning cases as JSON lines; a missing id comes from the audio file's name."""
    k, folder = F.col("doc_id"), scratch(spark, "tuning")
    case = F.struct(F.when(k % 2 == 0, F.concat(F.lit("case-"), k)).alias("case_id"), F.concat(F.lit("audio/a "), k, F.lit(".wav")).alias("audio_path"), F.concat(F.lit(" ref/"), k, F.lit(".json ")).alias("reference_path"), F.when(k % 3 == 0, (k % 90).cast("double")).alias("duration_limit"))
    roles.table(spark, d, "documents").select(F.to_json(case).alias("value")).write.text(f"{folder}/cases.jsonl")
    return readers.read_tuning_cases(spark, f"{folder}/cases.jsonl").withColumn("duration_limit", F.coalesce("duration_limit", F.lit(-1.0)))


@query(
    """WITH c AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS i, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations)
SELECT conv_id::VARCHAR AS meeting_id, i AS seg_idx, round_even(i * 10.0::DOUBLE + CASE WHEN turn % 2 = 0 THEN 1.25::DOUBLE ELSE 0.0::DOUBLE END, 3) AS start, round_even(i * 10.0::DOUBLE + CASE WHEN turn % 2 = 0 THEN 4.5::DOUBLE ELSE 10.0::DOUBLE END, 3) AS "end", text
FROM c WHERE text <> '' AND turn % 5 <> 4"""
)
def chunked_files(spark: SparkSession, d: str) -> DataFrame:
    """Chunked recognizer output: chunks narrowed to their first timestamps' words, blank ones dropped."""
    t, folder = roles.table(spark, d, "conversations").withColumnRenamed("conv_id", "meeting_id"), scratch(spark, "chunks")
    k = F.col("turn")
    word = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    name = F.concat(F.lit("c"), k)
    listed = F.array_sort(F.collect_list(F.struct(k, F.struct(name.alias("chunk"), F.when(k % 5 == 4, " ").otherwise(F.col("text")).alias("text")).alias("c"))))
    times = F.filter(F.flatten(F.collect_list(F.when(k % 2 == 0, F.array(F.struct(name.alias("chunk"), F.struct(F.array(word(1.25, 2.0), word(3.0, 4.5)).alias("word")).alias("timestamp"))).cast("array<struct<chunk:string,timestamp:struct<word:array<struct<start:double,end:double>>>>>")))), lambda x: x.isNotNull())
    files = t.groupBy("meeting_id").agg(listed.alias("l"), times.alias("timestamps"))
    writers.write_files(_as_files(files, F.to_json(F.struct(F.struct(F.lit(10.0).alias("chunk_seconds")).alias("meta"), F.transform("l", lambda x: x.c).alias("chunks"), "timestamps"))), folder)
    return readers.read_chunked(spark, folder)


@query("SELECT 'T' || doc_id AS title, length(trim(text))::BIGINT AS n FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0 AND trim(text) <> ''")
def wiki_files(spark: SparkSession, d: str) -> DataFrame:
    """Articles of a wiki dump: the main namespace without redirects."""
    k, folder = F.col("doc_id"), scratch(spark, "wiki")
    page = roles.table(spark, d, "documents").select(
        F.concat(F.lit("T"), k).alias("title"), F.when(k % 3 == 0, "0").otherwise("1").alias("ns"), F.when(k % 5 == 0, F.struct(F.lit("x").alias("_title"))).alias("redirect"), F.struct(F.trim("text").alias("text")).alias("revision"),
    )
    page.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(folder)
    return readers.read_wiki(spark, folder).select("title", F.length(F.trim("text")).cast("long").alias("n"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    docs, folder = roles.table(spark, d, "documents"), scratch(spark, "groups")
    docs.select("source", F.col("text").alias("value")).write.partitionBy("source").option("lineSep", "\n\n").text(folder)
    names = sorted(r.source for r in docs.select("source").distinct().collect())  # a config's worth of groups
    listed = [(n, 1 + len(n) % 3, f"{folder}/source={n}") for n in names[1:]]
    return readers.read_groups(spark, listed, [f"{folder}/source={names[0]}"], blocks=True)


_PER_FILE = f"""WITH b AS (SELECT CASE WHEN source = (SELECT min(source) FROM documents) THEN 'extra' ELSE source END AS label, CASE WHEN source = (SELECT min(source) FROM documents) THEN 1 ELSE 1 + length(source) % 3 END AS weight,
  unnest(string_split(text, chr(10) || chr(10))) AS text FROM documents),
t AS (SELECT label, weight, unnest({_SPLIT}) AS sentence FROM b)
SELECT label, max(weight)::BIGINT AS weight, count(*) AS raw_sentences, sum(weight)::BIGINT AS weighted_sentences, sum(length(sentence))::BIGINT AS chars FROM t GROUP BY 1"""


@query(_PER_FILE)
def group_files(spark: SparkSession, d: str) -> DataFrame:
    """Text folders as weighted groups, and one as an extra of weight 1, read block by block."""
    s = _groups(spark, d)
    chars = s.groupBy("label").agg(F.sum(F.length("sentence")).alias("chars"))
    return corpus.group_stats(s).withColumn("weight", F.col("weight").cast("long")).join(chars, "label")


@query(f"""WITH {_PLAIN}, t AS (SELECT weight, unnest(regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}_\\-]+|[.,;:!?()«»\"“”„]')) AS token FROM pl),
c AS (SELECT token, sum(weight) AS n FROM t GROUP BY 1 ORDER BY n DESC, token LIMIT 300),
s AS (SELECT sum(weight)::BIGINT AS lines, sum(weight * length(sentence))::BIGINT AS chars, count(DISTINCT sentence) AS different FROM pl)
SELECT token, lines, chars, different FROM c, s""")
def language_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary file of a language corpus, beside the number of lines, characters and different lines of its corpus file."""
    docs, folder = roles.table(spark, d, "documents"), scratch(spark, "corpus")
    s = corpus.corpus_sentences(docs.select(F.col("source").alias("label"), (F.length("source") % 3 + 1).alias("weight"), "doc_id", "text"))
    writers.write_language_corpus(s, folder, 300)
    lines = spark.read.text(f"{folder}/corpus").agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("chars"), F.count_distinct("value").alias("different"))  # one row
    return spark.read.text(f"{folder}/vocab").select(F.col("value").alias("token")).crossJoin(F.broadcast(lines))


@query("""SELECT 'p' || doc_id AS preset_id, CASE WHEN doc_id % 2 = 0 THEN 'about ' || doc_id ELSE '-' END AS description, 'b' || (doc_id % 4) AS backend_id, CASE
  WHEN doc_id % 3 = 0 THEN '{\"k\":' || doc_id || '}' ELSE '{}' END AS options FROM documents""")
def preset_files(spark: SparkSession, d: str) -> DataFrame:
    """Presets, one to a file."""
    k, folder = F.col("doc_id"), scratch(spark, "presets")
    docs = roles.table(spark, d, "documents")
    backend = F.struct(F.concat(F.lit("b"), k % 4).alias("id"), F.when(k % 3 == 0, F.struct(k.alias("k"))).alias("options"))
    one = F.to_json(F.struct(F.concat(F.lit("p"), k).alias("id"), F.when(k % 2 == 0, F.concat(F.lit("about "), k)).alias("description"), F.struct(F.lit("single-speaker").alias("content_mode")).alias("pipeline"), backend.alias("backend")))
    writers.write_files(docs.select(F.concat(F.lit("p"), k, F.lit(".json")).alias("path"), one.alias("content")), folder)
    return readers.read_presets(spark, folder).select("preset_id", F.coalesce("description", F.lit("-")).alias("description"), "backend_id", "options")


_HELD = "WITH i AS (SELECT conv_id AS m, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1)"


@query(_HELD + " SELECT m::VARCHAR AS item_id, CASE WHEN m % 3 = 0 THEN 'folder' WHEN m % 3 = 1 THEN 'own path' ELSE 'missing' END AS found, CASE WHEN m % 2 = 0 THEN 'ru' ELSE 'en' END AS language, CASE WHEN m % 3 < 2 THEN n ELSE 0 END AS n_segments, CASE WHEN m % 3 < 2 THEN chars ELSE 0 END AS n_chars FROM i")
def hypothesis_files(spark: SparkSession, d: str) -> DataFrame:
    """A corpus manifest's items with their transcripts: by id in a folder, else by a path of their own, else missing."""
    folder = scratch(spark, "corpus")
    t = _transcripts(spark, d)
    k = F.col("meeting_id") % 3
    content = F.to_json(F.struct(F.when(k == 0, "folder").otherwise("own path").alias("language"), "duration", "segments"))
    writers.write_files(_as_files(t.where(k == 0), content), f"{folder}/hypotheses")
    writers.write_files(_as_files(t.where(k == 1), content), f"{folder}/own")
    one = F.struct(_id().alias("id"), F.lit("r.json").alias("reference"), F.when(k != 0, F.concat(F.lit("own/"), _id(), F.lit(".json"))).alias("hypothesis"), F.when(F.col("meeting_id") % 2 == 0, "ru").alias("language"))
    # a manifest for each hundred meetings
    whole = t.groupBy(F.floor(F.col("meeting_id") / 100).alias("part")).agg(F.concat(F.lit('{"name":"n","defaults":{"language":"en"},"items":['), F.array_join(F.array_sort(F.collect_list(F.to_json(one))), ","), F.lit("]}")).alias("content"))
    writers.write_files(whole.select(F.concat(F.lit("corpus-"), "part", F.lit(".json")).alias("path"), "content"), folder)
    items = readers.read_corpora(spark, folder)
    heard = reviews.read_hypotheses(spark, items.select("item_id", "hypothesis"), f"{folder}/hypotheses")
    heard = heard.select("item_id", F.col("language").alias("found"), F.size("segments").cast("long").alias("n_segments"), F.aggregate("segments", F.lit(0), lambda a, s: a + F.length(s.text)).cast("long").alias("n_chars"))
    return items.join(heard, "item_id", "left").fillna(0, ["n_segments", "n_chars"]).select("item_id", F.coalesce("found", F.lit("missing")).alias("found"), "language", "n_segments", "n_chars")


@query(
    """WITH c AS (SELECT conv_id, turn, text, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id::VARCHAR AS meeting_id, turn * 10.0::DOUBLE AS start, CASE WHEN n = 1 THEN turn * 10.0::DOUBLE + 3 WHEN nx IS NOT NULL THEN nx * 10.0::DOUBLE WHEN conv_id % 2 = 0 THEN 999.0::DOUBLE ELSE turn * 10.0::DOUBLE + CASE WHEN n = 1 THEN 5 ELSE 10 END END AS "end",
  CASE WHEN conv_id % 4 = 3 THEN 'SPEAKER_UNKNOWN' ELSE 'S' || (turn % 2) END AS speaker FROM c"""
)
def review_files(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed templates, lists and objects, with ends filled in."""
    t, folder = roles.table(spark, d, "conversations").withColumnRenamed("conv_id", "meeting_id"), scratch(spark, "reviews")
    n = F.row_number().over(_by_turn())
    seg = F.struct(F.when(F.col("meeting_id") % 4 != 3, F.concat(F.lit("S"), F.col("turn") % 2)).alias("speaker"), (F.col("turn") * 10.0).alias("start_sec"), F.when(F.col("n") == 1, F.col("turn") * 10.0 + 3).alias("end"), "text")
    listed = t.withColumn("n", n).groupBy("meeting_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", seg.alias("s"))), False), lambda x: x.s).alias("segments"))
    whole = F.when(F.col("meeting_id") % 2 == 0, F.to_json(F.struct(F.lit(999.0).alias("end_sec"), "segments"))).otherwise(F.to_json("segments"))
    writers.write_files(_as_files(listed, whole), folder)
    return reviews.reviewed(reviews.read_reviews(spark, folder)).select("meeting_id", "start", "end", "speaker")


def _by_turn():
    return Window.partitionBy("meeting_id").orderBy("turn")


@query(
    """WITH i AS (SELECT conv_id AS m, count(*) AS n, min(turn) AS lo FROM conversations GROUP BY 1)
SELECT m::VARCHAR AS chunk_id, CASE m % 6 WHEN 0 THEN 'Review template JSON is invalid' WHEN 1 THEN 'Review template must be a JSON object with a `segments` list.' WHEN 2 THEN 'Review template must contain a `segments` list.'
  WHEN 3 THEN 'Review template `segments` list is empty.' WHEN 4 THEN 'Review template segments are invalid: no text' ELSE '-' END AS problem, CASE WHEN m % 6 >= 4 THEN n ELSE 0 END AS n_segments FROM i"""
)
def template_files(spark: SparkSession, d: str) -> DataFrame:
    """Templates in every state of being filled in, and what is wrong with each."""
    t, folder = roles.table(spark, d, "conversations").withColumnRenamed("conv_id", "meeting_id"), scratch(spark, "templates")
    k = F.col("meeting_id") % 6
    seg = F.struct((F.col("turn") * 10.0).alias("start_sec"), F.when(k == 4, " ").otherwise("said").alias("text"))
    whole = (
        F.when(k == 0, '{"segments": [').when(k == 1, '[{"text": "x"}]').when(k == 2, '{"segments": {"text": "x"}}').when(k == 3, '{"segments": []}').otherwise(F.to_json(F.struct(F.col("segments").alias("segments"))))
    )
    listed = t.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", seg.alias("s")))), lambda x: x.s).alias("segments"))
    writers.write_files(_as_files(listed, whole), folder)
    out = reviews.checked_templates(spark, folder)
    return out.select("chunk_id", F.coalesce("problem", F.lit("-")).alias("problem"), F.col("n_segments").cast("long").alias("n_segments"))


@query(
    """WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos FROM conversations)
SELECT conv_id::VARCHAR AS chunk_id, pos, 'S' || (turn % 2) AS speaker, turn * 10.0::DOUBLE AS start, turn * 10.0::DOUBLE + 5 AS "end", text, '{"a":[1,"x"]}' AS note FROM c WHERE conv_id % 3 < 2
UNION ALL SELECT DISTINCT conv_id::VARCHAR, -1, '-', 0.0, 0.0, '-', '-' FROM c WHERE conv_id % 3 = 2"""
)
def accepted_files(spark: SparkSession, d: str) -> DataFrame:
    """Templates filled in backwards, written back in canonical form; those that can't be accepted stay as they were."""
    t, folder = roles.table(spark, d, "conversations").withColumnRenamed("conv_id", "meeting_id"), scratch(spark, "accepted")
    k = F.col("meeting_id") % 3
    seg = F.struct((F.col("turn") * 10.0).cast("string").alias("start"), (F.col("turn") * 10 + 5).alias("end_sec"), "text", F.concat(F.lit("S"), F.col("turn") % 2).alias("speaker"))
    listed = t.groupBy("meeting_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("turn", seg.alias("s"))), False), lambda x: x.s)).alias("segments"))
    whole = F.when(k < 2, F.concat(F.lit('{"note": {"a": [1, "x"]}, "segments": '), "segments", F.lit("}"))).otherwise(F.lit('{"segments": []}'))
    writers.write_files(_as_files(listed, whole), folder)
    reviews.accept(spark, folder)
    back = spark.read.text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"(.*)\.json", 1).alias("chunk_id"), "value")
    item = "array<struct<speaker:string,start_sec:double,end_sec:double,text:string>>"
    each = back.select("chunk_id", F.get_json_object("value", "$.note").alias("note"), F.posexplode_outer(F.from_json(F.get_json_object("value", "$.segments"), item)).alias("pos", "s"))
    none = F.col("s").isNull()
    return each.select("chunk_id", F.when(none, -1).otherwise(F.col("pos")).alias("pos"), F.coalesce("s.speaker", F.lit("-")).alias("speaker"), F.coalesce("s.start_sec", F.lit(0.0)).alias("start"), F.coalesce("s.end_sec", F.lit(0.0)).alias("end"), F.coalesce("s.text", F.lit("-")).alias("text"), F.when(none, "-").otherwise(F.col("note")).alias("note"))


@query(
    """WITH c AS (SELECT conv_id, turn, trim(text) AS text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos FROM conversations)
SELECT conv_id::VARCHAR AS name, pos, turn * 2.5::DOUBLE AS start, text FROM c"""
)
def payload_files(spark: SparkSession, d: str) -> DataFrame:
    """Segment payloads as bare lists, under segments, and under chunks; entries that aren't objects are skipped."""
    t, folder = roles.table(spark, d, "conversations").withColumnRenamed("conv_id", "meeting_id"), scratch(spark, "payloads")
    k = F.col("meeting_id") % 3
    listed = t.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct((F.col("turn") * 2.5).alias("start"), F.trim("text").alias("text")).alias("s")))), lambda x: x.s).alias("segments"))
    items = F.concat(F.lit('["no object", 7, '), F.substring(F.to_json("segments"), 2, 1 << 30))
    whole = F.when(k == 0, items).when(k == 1, F.concat(F.lit('{"segments": '), items, F.lit("}"))).otherwise(F.concat(F.lit('{"chunks": '), items, F.lit("}")))
    writers.write_files(_as_files(listed, whole), folder)
    return reviews.read_segment_payloads(spark, folder).select("name", "pos", "start", "text")


@query(using("seg", "ctc") + """ SELECT meeting_id::VARCHAR AS run, 'base' AS stage, (row_number() OVER (PARTITION BY meeting_id ORDER BY seg_idx) - 1)::INTEGER AS seg_idx, text, CASE meeting_id % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'uk' ELSE 'ru' END AS language FROM seg
UNION ALL SELECT meeting_id::VARCHAR, 'ctc', (row_number() OVER (PARTITION BY meeting_id ORDER BY seg_idx) - 1)::INTEGER, array_to_string(w, ' '), CASE meeting_id % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'uk' ELSE 'ru' END FROM ctc WHERE meeting_id % 2 = 0""")
def saved_run(spark: SparkSession, d: str) -> DataFrame:
    """All meetings as saved runs, half of them with a second stage, a third without a record of their language."""
    s, folder = roles.segments(spark, d), scratch(spark, "run")
    m = F.col("meeting_id")
    as_json = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.struct("start", "end", "text").alias("s")))), lambda x: x.s))
    place = lambda file: F.concat(_id(), F.lit(f"/{file}")).alias("path")
    for name, rows in (("base", s), ("ctc", roles.ctc(s).where(m % 2 == 0))):
        writers.write_files(rows.groupBy("meeting_id").agg(as_json.alias("content")).select(place(reviews.SAVED[name]), "content"), folder)
    said = F.to_json(F.struct(F.when(m % 3 == 1, "uk").alias("requested_language"), F.lit("de").alias("detected_language")))
    writers.write_files(s.select("meeting_id").distinct().where(m % 3 != 2).select(place(reviews.RUN_META), said.alias("content")), folder)
    return reviews.read_saved_runs(spark, folder).select("run", "stage", "seg_idx", "text", "language")


@query(using("seg") + " SELECT meeting_id, seg_idx, speaker, 'whole' AS state FROM seg")
def stage_files(spark: SparkSession, d: str) -> DataFrame:
    """A stage's table as an artifact; a partial one that comes later doesn't replace it, and a missing one has no rows."""
    s, folder = roles.segments(spark, d).select("meeting_id", "seg_idx", "speaker"), scratch(spark, "stages")
    writers.write_stage(s.withColumn("state", F.lit("whole")), folder, "01_raw_segments.json")
    writers.write_stage(s.limit(1).withColumn("state", F.lit("partial")), folder, "01_raw_segments.json", partial=True)
    writers.write_stage(s, None, "02_never.json")
    kind = "meeting_id long, seg_idx long, speaker string, state string"
    back = spark.read.schema(kind).json(f"{folder}/01_raw_segments.json")
    return back.unionByName(reviews.read_artifact(spark, f"{folder}/02_never.json", kind))


@query(f"""WITH {_WAVE}, k AS (SELECT id, len(x) AS n, unnest(range(0, (len(x) + 79) // 80)) AS k, x FROM w)
SELECT id::VARCHAR AS path, round_even(coalesce(list_sum(list_transform(x[k * 80 + 1:(k + 1) * 80], lambda v: round_even(greatest(-1.0, least(1.0, v)) * 32767, 0) / 32768)), 0)::DOUBLE, 6) AS total, 'chunk_' || lpad(k::VARCHAR, 3, '0') AS chunk_id, round_even(k * 80 / 16000.0::DOUBLE, 3) AS start_sec, round_even(least(n, (k + 1) * 80) / 16000.0::DOUBLE, 3) AS end_sec, (44 + 2 * least(80, n - k * 80))::BIGINT AS n_bytes, 0 AS n_segments FROM k""")
def review_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Review chunks of 80 samples as WAV files with blank templates."""
    c = writers.review_chunks(_audio(spark, d), 80 / 16000)
    blank = F.from_json("template", "struct<segments:array<string>>")
    heard = readers.decoded_wav(c.select(F.concat_ws("/", "path", "chunk_id").alias("path"), "content")).select(F.col("path").alias("key"), F.bround(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
    return c.join(heard, F.concat_ws("/", c["path"], c["chunk_id"]) == F.col("key")).select("path", "total", "chunk_id", "start_sec", "end_sec", F.octet_length("content").cast("long").alias("n_bytes"), F.size(blank.segments).alias("n_segments"))


@query(f"WITH {_WAVE} SELECT id::VARCHAR AS path, len(x)::BIGINT AS n, list_sum(x)::DOUBLE AS total FROM w")
def audio_cache(spark: SparkSession, d: str) -> DataFrame:
    """Audio written once; what comes later is read from what is there."""
    a, folder = _audio(spark, d), scratch(spark, "audio")
    readers.cached_audio(a, folder)
    again = readers.cached_audio(a.limit(1), folder)
    return again.select("path", F.size("samples").cast("long").alias("n"), F.aggregate("samples", F.lit(0.0), lambda x, y: x + y).alias("total"))


@query(using("runs") + ", k AS (" + _RK.format("(status <> 'completed')::INT, -proxy_quality_score, fallback_count, skipped_stage_count, wall_clock_sec") + ") SELECT experiment_id, count(*) AS n_runs, arg_min(preset_id, rank) AS best_preset_id, sum(rank)::BIGINT AS ranks, count(DISTINCT preset_id) AS n_presets FROM k GROUP BY 1")
def experiment_files(spark: SparkSession, d: str) -> DataFrame:
    """An experiment's snapshots, runs and summary as files, all read again."""
    r, folder = roles.runs(spark, d).withColumn("experiment_id", F.col("variant")).withColumn("preset_id", F.lpad(F.col("item_id").cast("string"), 12, "0")), scratch(spark, "experiment")
    writers.write_experiment(r.select("preset_id").distinct(), ranking.rank_runs(r, False), folder)
    summary = spark.read.schema("experiment_id string, n_runs long, best_preset_id string").json(f"{folder}/summary")
    presets = spark.read.schema("preset_id string").json(f"{folder}/presets")
    ran = spark.read.schema("experiment_id string, preset_id string, rank long").json(f"{folder}/runs").join(presets, "preset_id")
    return summary.join(ran.groupBy("experiment_id").agg(F.sum("rank").alias("ranks"), F.count_distinct("preset_id").alias("n_presets")), "experiment_id")


@query("SELECT doc_id AS run_id, CASE WHEN doc_id % 3 = 0 THEN 'align' ELSE 'asr' END AS stage, CASE WHEN doc_id % 3 = 0 THEN 50.0::DOUBLE ELSE 10.0::DOUBLE END AS percent, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'running' END AS status FROM documents")
def run_progress(spark: SparkSession, d: str) -> DataFrame:
    """The last event of runs whose stages append events; some fail, with an error record."""
    runs = roles.table(spark, d, "documents").select(F.col("doc_id").alias("run_id"), F.lit("").alias("details"))
    later = runs.where("run_id % 3 = 0")
    events = writers.run_events(runs, "asr", 10).unionByName(writers.run_events(later, "align", 50, "failed"))
    errors = writers.error_records(later.select("run_id", F.lit("align").alias("stage"), F.lit("went wrong").alias("error"), F.lit("").alias("traceback")))
    out = writers.latest_events(events).join(errors.select("run_id", F.col("stage").alias("failed_at")), "run_id", "left")
    return out.select("run_id", F.coalesce("failed_at", "stage").alias("stage"), "percent", "status")


@query(using("seg") + """, m AS (SELECT meeting_id, max(e) / 1000.0::DOUBLE AS d FROM seg GROUP BY 1 HAVING max(e) > 0), n AS (SELECT meeting_id, CAST(ceil(d / 20) AS BIGINT) AS n FROM m)
SELECT meeting_id, n, 'chunk_' || lpad((meeting_id % 2)::VARCHAR, 3, '0') AS first FROM n WHERE meeting_id % 2 < n""")
def blank_templates(spark: SparkSession, d: str) -> DataFrame:
    """Blank templates of 20 s of each meeting, and the first one left to fill in; every other meeting's first is filled in."""
    m = roles.segments(spark, d).groupBy("meeting_id").agg((F.max("end") / 1000).alias("duration")).where("duration > 0")
    blank = writers.review_manifest(m, 20.0)
    filled = blank.withColumn("segments", F.when((F.col("meeting_id") % 2 == 1) & (F.col("chunk_id") == "chunk_000"), F.array(F.lit("x"))).otherwise(F.col("segments")))
    return writers.first_blank(filled).withColumnRenamed("chunk_id", "first").join(blank.groupBy("meeting_id").agg(F.count("*").alias("n")), "meeting_id")
