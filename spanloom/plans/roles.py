"""The driver's tables in the roles of a transcript engine; times are whole milliseconds, so engines agree exactly.

A conversation is a meeting, a turn a segment, a role a speaker; word i of a turn lasts 400 ms. The other transcripts are
edited copies, shifted by 150 ms: ``ctc`` lacks every seventh word, ``whisper`` has every fifth one replaced. Each role has
its DuckDB twin among ``SQL``'s common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEP, SHIFT = 400, 150


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting_id, seg_idx, speaker, text, w)."""
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker"), "text", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting_id, seg_idx, speaker, start, end, text, w)."""
    t = turns(spark, sf_dir)
    upto = F.sum(F.size("w")).over(Window.partitionBy("meeting_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0)) * STEP
    return t.select("meeting_id", "seg_idx", "speaker", (upto - F.size("w") * STEP).cast("long").alias("start"), upto.cast("long").alias("end"), "text", "w")


def words(segs: DataFrame) -> DataFrame:
    """(meeting_id, seg_idx, word_idx, start, end, word)."""
    w = segs.select("meeting_id", "seg_idx", F.col("start").alias("s"), F.posexplode("w").alias("word_idx", "word"))
    start = F.col("s") + F.col("word_idx") * STEP
    return w.select("meeting_id", "seg_idx", "word_idx", start.alias("start"), (start + STEP).alias("end"), "word")


def ctc(segs: DataFrame) -> DataFrame:
    w = F.filter("w", lambda x, k: k % 7 != 6)
    return segs.select("meeting_id", "seg_idx", "speaker", (F.col("start") + SHIFT).alias("start"), (F.col("end") + SHIFT).alias("end"), F.array_join(w, " ").alias("text"), w.alias("w"))


def whisper(segs: DataFrame) -> DataFrame:
    w = F.transform("w", lambda x, k: F.when(k % 5 == 4, F.lit("um")).otherwise(x))
    return segs.select("meeting_id", "seg_idx", "speaker", (F.col("start") + SHIFT).alias("start"), (F.col("end") + SHIFT).alias("end"), F.array_join(w, " ").alias("text"), w.alias("w"))


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker intervals (meeting_id, start, end, speaker, seg_idx) from events: a user's day, 2 to 61 minutes long, in seconds of the month."""
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.date_trunc("second", "ts")) / 1_000_000 - 1704067200
    start = F.floor(start).cast("long")
    return e.select(F.col("user_id").alias("meeting_id"), start.alias("start"), (start + 120 + F.col("event_id") % 60 * 60).alias("end"), F.col("event_type").alias("speaker"), F.col("event_id").alias("seg_idx"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of an experiment: a document is an item, its source the variant, its quality label the status."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("q"))
    j = d.join(labels, "doc_id", "left")
    n = F.col("n_chars")
    return j.select(
        F.col("source").alias("variant"), F.col("doc_id").alias("item_id"), F.when(F.coalesce("q", F.lit(1)) == 1, "completed").otherwise("failed").alias("status"), (n % 97 / 100.0).alias("wer"), (n % 53 / 100.0).alias("cer"),
        (n % 31 / 10.0).alias("realtime_factor"), (n % 89 / 100.0).alias("proxy_quality_score"), (n % 3).alias("fallback_count"), (n % 2).alias("skipped_stage_count"), (n % 71 / 1.0).alias("wall_clock_sec"),
    )


SQL = {
    "tok": r"tok AS (SELECT conv_id AS meeting_id, turn AS seg_idx, role AS speaker, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations)",
    "seg": 'seg AS (SELECT *, CAST(400 * (sum(len(w)) OVER m - len(w)) AS BIGINT) AS s, CAST(400 * sum(len(w)) OVER m AS BIGINT) AS e FROM tok WINDOW m AS (PARTITION BY meeting_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING))',
    "word": "word AS (SELECT meeting_id, seg_idx, i - 1 AS word_idx, s + 400 * (i - 1) AS ws, s + 400 * i AS we, w[i] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM seg))",
    "ctc": "ctc AS (SELECT meeting_id, seg_idx, speaker, s + 150 AS s, e + 150 AS e, list_transform(list_filter(range(1, len(w) + 1), lambda i: (i - 1) % 7 <> 6), lambda i: w[i]) AS w FROM seg)",
    "whisper": "whisper AS (SELECT meeting_id, seg_idx, speaker, s + 150 AS s, e + 150 AS e, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN (i - 1) % 5 = 4 THEN 'um' ELSE w[i] END) AS w FROM seg)",
    "talk": "talk AS (SELECT user_id AS meeting_id, event_type AS speaker, event_id AS seg_idx, CAST(epoch_us(date_trunc('second', ts)) // 1000000 - 1704067200 AS BIGINT) AS s, CAST(epoch_us(date_trunc('second', ts)) // 1000000 - 1704067200 + 120 + event_id % 60 * 60 AS BIGINT) AS e FROM events)",
    "runs": "runs AS (SELECT source AS variant, d.doc_id AS item_id, CASE WHEN coalesce(quality, 1) = 1 THEN 'completed' ELSE 'failed' END AS status, n_chars % 97 / 100.0::DOUBLE AS wer, n_chars % 53 / 100.0::DOUBLE AS cer, n_chars % 31 / 10.0::DOUBLE AS realtime_factor, n_chars % 89 / 100.0::DOUBLE AS proxy_quality_score, n_chars % 3 AS fallback_count, n_chars % 2 AS skipped_stage_count, (n_chars % 71)::DOUBLE AS wall_clock_sec FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)",
}


def norm(x: str) -> str:
    """SQL of a text's normalized words."""
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower(replace({x}, 'ß', 'ss')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"


def content(x: str) -> str:
    """SQL of a text's content words."""
    return f"list_filter(list_transform(regexp_extract_all({x}, '[0-9A-Za-zА-Яа-яЁёІіЇїЄєҐґ]+'), lambda x: lower(x)), lambda x: length(x) > 1)"


def using(*names: str, recursive: bool = False) -> str:
    need = []
    for n in names:
        for k in {"seg": ("tok", "seg"), "word": ("tok", "seg", "word"), "ctc": ("tok", "seg", "ctc"), "whisper": ("tok", "seg", "whisper")}.get(n, (n,)):
            if k not in need:
                need.append(k)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[n] for n in need)
