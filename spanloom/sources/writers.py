"""Writers: transcripts as text and JSON, stage tables, events, training pairs, corpora, audio, reports."""

from __future__ import annotations

import io
import json
import time
import wave
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clock
from ..operators.corpus import repeated
from .scratch import scratch
from .single_files import write_files  # noqa: F401


def transcript_lines(segments: DataFrame) -> DataFrame:
    """(meeting_id, seg_idx, line): ``[HH:MM:SS.ss -> HH:MM:SS.ss] SPEAKER: text``."""
    line = F.concat(F.lit("["), clock(F.col("start")), F.lit(" -> "), clock(F.col("end")), F.lit("] "), F.col("speaker"), F.lit(": "), F.col("text"))
    return segments.select("meeting_id", "seg_idx", line.alias("line"))


def transcript_texts(segments: DataFrame) -> DataFrame:
    """(meeting_id, text): a meeting's lines in order."""
    return transcript_lines(segments).groupBy("meeting_id").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY seg_idx)").alias("text"))


def nested(segments: DataFrame, words: DataFrame, meetings: DataFrame) -> DataFrame:
    """Transcripts (meeting_id, language, duration, segments); null optional fields vanish when written as JSON."""
    w = words.groupBy("meeting_id", "seg_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", F.struct("word", "start", "end", "score", "speaker").alias("w")))), lambda x: x.w).alias("words"))
    s = segments.join(w, ["meeting_id", "seg_idx"], "left")
    empty = F.array().cast(s.schema["words"].dataType)
    s = s.withColumn("s", F.struct("speaker", "start", "end", "text", F.coalesce("words", empty).alias("words"), "confidence", "source"))
    all_ = s.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "s"))), lambda x: x.s).alias("segments"))
    return meetings.select("meeting_id", "language", "duration").join(all_, "meeting_id", "left").withColumn("segments", F.coalesce("segments", F.array().cast(all_.schema["segments"].dataType)))


def write_transcripts(transcripts: DataFrame, path: str) -> None:
    transcripts.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_stage(df: DataFrame, folder: str | None, name: str, partial: bool = False) -> None:
    """A numbered stage table, if a folder is set; partial ones never replace what is there."""
    if folder:
        df.write.mode("ignore" if partial else "overwrite").json(f"{folder}/{name}")


def write_recorded(df: DataFrame, folder: str, name: str, run_id: str, percent: float, status: str = "running") -> DataFrame:
    """A stage table as JSON, and its progress event (run_id, ts, seq, status, percent, stage, details), as ``run_events``.

    details is JSON: rows, bytes and seconds. Rows and bytes are observed while the stage is written, not read again.
    """
    from pyspark.sql import Observation

    seen, began = Observation(), time.perf_counter()
    lines = df.select(F.to_json(F.struct("*")).alias("value"))
    size = F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes")
    lines.observe(seen, F.count("*").alias("rows"), size).write.mode("overwrite").text(f"{folder}/{name}")
    details = {**seen.get, "seconds": round(time.perf_counter() - began, 6)}
    run = df.sparkSession.createDataFrame([(run_id, json.dumps(details))], "run_id string, details string")
    return run_events(run, name, int(percent), status)


def latest_events(events: DataFrame) -> DataFrame:
    """The last progress event of each run (run_id, ts, seq, status, percent, stage, details)."""
    last = F.max(F.struct("ts", "seq", "status", "percent", "stage", "details")).alias("e")
    return events.groupBy("run_id").agg(last).select("run_id", "e.ts", "e.status", "e.percent", "e.stage", "e.details")


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Training pairs as JSON lines; a null chunk_id vanishes."""
    cols = ["ctc", "whisper", "clean", F.col("start").alias("start_sec"), F.col("end").alias("end_sec"), *(["chunk_id"] if "chunk_id" in pairs.columns else [])]
    pairs.select(*cols).write.mode("overwrite").json(path)


def write_corpus(sentences: DataFrame, path: str) -> None:
    """Sentences, each as often as its weight, one to a line, in (label, doc_id, pos) order over the files."""
    repeated(sentences).sort("label", "doc_id", "pos", "copy").select("sentence").write.mode("overwrite").text(path)


def wav_bytes(audio: DataFrame, rate: int = 16000) -> DataFrame:
    """(path, content): samples clipped to [-1, 1] as mono 16-bit WAV files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("samples").to_pylist():
                buffer = io.BytesIO()
                with wave.open(buffer, "wb") as w:
                    w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
                    w.writeframes(np.round(np.clip(np.array(x, np.float32), -1, 1) * 32767).astype("<i2").tobytes())
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], names=["path", "content"])

    return audio.select("path", "samples").mapInArrow(run, "path string, content binary")


#: Fixed value: what a blank review template tells its reader.
INSTRUCTIONS = "Upload the WAV file to Gemini, then fill this JSON template's `segments` list with the timestamped speaker-attributed transcript."


def review_manifest(meetings: DataFrame, seconds: float = 600.0) -> DataFrame:
    """(meeting_id, chunk_id, start_sec, end_sec, segments): blank review templates for fixed chunks."""
    from ..operators.windows import fixed_windows

    w = fixed_windows(meetings, seconds)
    return w.select("meeting_id", F.format_string("chunk_%03d", "window_id").alias("chunk_id"), F.col("start").alias("start_sec"), F.col("end").alias("end_sec"), F.array().cast("array<string>").alias("segments"))


def review_chunks(audio: DataFrame, seconds: float = 600.0, rate: int = 16000) -> DataFrame:
    """(path, chunk_id, start_sec, end_sec, content, template) of audio (path, samples): WAV chunks and blank templates.

    template is JSON; its audio_path is the chunk's name below audio_chunks.
    """
    from .readers import audio_chunks

    if seconds <= 0:
        raise ValueError(f"a chunk's length must be positive, not {seconds}")
    name = F.format_string("chunk_%03d", "chunk")
    cut = audio_chunks(audio, seconds, rate).withColumn("chunk_id", name).withColumn("key", F.concat_ws("/", "path", "chunk_id"))
    wav = wav_bytes(cut.select(F.col("key").alias("path"), "samples"), rate).withColumnRenamed("path", "key")
    blank = F.struct("chunk_id", F.concat(F.lit("audio_chunks/"), F.col("chunk_id"), F.lit(".wav")).alias("audio_path"), F.col("start").alias("start_sec"), F.col("end").alias("end_sec"), F.lit(INSTRUCTIONS).alias("instructions"), F.array().cast("array<string>").alias("segments"))
    return cut.join(wav, "key").select("path", "chunk_id", F.col("start").alias("start_sec"), F.col("end").alias("end_sec"), "content", F.to_json(blank).alias("template"))


def run_events(runs: DataFrame, stage: str, percent: int, status: str = "running") -> DataFrame:
    """Progress events (run_id, ts, seq, status, percent, stage, details) of runs (run_id, details) that reach a stage now."""
    return runs.select("run_id", F.current_timestamp().alias("ts"), F.lit(percent).cast("long").alias("seq"), F.lit(status).alias("status"), F.lit(percent).cast("double").alias("percent"), F.lit(stage).alias("stage"), "details")


def error_records(failed: DataFrame) -> DataFrame:
    """(run_id, timestamp_utc, stage, error, traceback) of failed runs (run_id, stage, error, traceback)."""
    from ..operators.experiments import iso

    return failed.select("run_id", iso(F.current_timestamp()).alias("timestamp_utc"), "stage", "error", "traceback")


def write_experiment(presets: DataFrame, ranked: DataFrame, folder: str) -> None:
    """An experiment's preset snapshots, ranked runs and summary, as JSON lines below ``folder``."""
    from ..operators.experiments import summaries

    presets.write.mode("overwrite").json(f"{folder}/presets")
    ranked.orderBy("experiment_id", "rank").write.mode("overwrite").json(f"{folder}/runs")
    summaries(ranked).write.mode("overwrite").json(f"{folder}/summary")


def write_language_corpus(sentences: DataFrame, folder: str, size: int = 100_000) -> None:
    """corpus (sentences by weight), vocab (the ``size`` most frequent tokens, one a line, in order) and meta (group counts)."""
    from ..operators.corpus import group_stats, vocabulary

    kept = scratch(sentences.sparkSession, "sentences")  # each text is cut into sentences once
    sentences.write.parquet(kept)
    sentences = sentences.sparkSession.read.schema(sentences.schema).parquet(kept)
    write_corpus(sentences, f"{folder}/corpus")
    vocabulary(sentences, size).orderBy(F.desc("n"), "token").coalesce(1).select("token").write.mode("overwrite").text(f"{folder}/vocab")
    group_stats(sentences).coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def first_blank(templates: DataFrame) -> DataFrame:
    """Each meeting's first template, by name, that has no segments yet."""
    return templates.where(F.size("segments") == 0).groupBy("meeting_id").agg(F.min("chunk_id").alias("chunk_id"))


def markdown(headers: list[str], rows: Iterable[Iterable]) -> str:
    """A padded table; floats with four digits, null as a dash."""
    shown = [[_shown(c) for c in r] for r in rows]
    if not shown:
        return "_(no rows)_"
    width = [max(len(x) for x in column) for column in zip(headers, *shown, strict=True)]
    line = lambda cells: "| " + " | ".join(c.ljust(n) for c, n in zip(cells, width, strict=True)) + " |"
    return "\n".join([line(headers), "| " + " | ".join("-" * n for n in width) + " |", *map(line, shown)])


def report(df: DataFrame, order: list[str], title: str | None = None) -> str:
    """A small result as Markdown."""
    body = markdown(df.columns, (list(r) for r in df.orderBy(*order).collect()))
    return f"# {title}\n\n{body}" if title else body


def markdown_lines(rows: DataFrame, by: list[str], order: list[Column | str], columns: dict[str, str]) -> DataFrame:
    """(``by``, place, line): ``markdown`` of every group of ``rows`` at once, lines numbered from 0.

    columns: headers by column. A group's widths are maxima over the group; its lines stay rows, wherever they are.
    """
    kinds = dict(rows.dtypes)
    shaped = lambda c: F.format_string("%.4f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string")
    cell = {c: F.when(F.col(c).isNull(), "-").otherwise(shaped(c)) for c in columns}
    shown = rows.select(*by, *(x.alias(f"__{k}") for k, x in enumerate(cell.values())), F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("place"))
    names = list(columns.values())
    widths = shown.groupBy(*by).agg(*(F.greatest(F.max(F.length(f"__{k}")), F.lit(len(h))).alias(f"w{k}") for k, h in enumerate(names)))
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *(F.rpad(c, F.col(f"w{k}"), " ") for k, c in enumerate(cells))), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.repeat(F.lit("-"), F.col(f"w{k}")) for k in range(len(names)))), F.lit(" |"))
    head = widths.select(*by, F.posexplode(F.array(line([F.lit(h) for h in names]), rule)).alias("place", "line"))
    body = shown.join(widths, by).select(*by, (F.col("place") + 1).alias("place"), line([F.col(f"__{k}") for k in range(len(names))]).alias("line"))
    return head.unionByName(body)


def _shown(x: object) -> str:
    return "-" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)


def score_report(score: dict, title: str | None = None, diff: str | None = None) -> str:
    """One transcript's scores (a row of ``scoring.score_transcripts``, split or not) as Markdown."""
    names = [("WER", "wer"), ("CER", "cer"), *((n, k) for n, k in (("cpWER", "cp_wer"), ("DER", "der")) if score.get(k) is not None)]
    lines = [f"## {title}"] if title else []
    lines.append(markdown([n for n, _ in names], [[score.get(k) for _, k in names]]))
    if score.get("word_substitutions") is not None:
        lines.append(f"\nWER breakdown: {score['word_substitutions']} sub, {score['word_deletions']} del, {score['word_insertions']} ins over {score['ref_words']} ref words (profile `{score.get('profile', 'default')}`).")
    if score.get("skipped"):
        lines.append("\nSkipped: " + ", ".join(f"{k} ({why})" for k, why in (x.split(": ", 1) for x in score["skipped"])))
    if score.get("inferred_ends"):
        lines.append("\n> Note: reference segment end-times were inferred from neighboring starts (DER is approximate).")
    return "\n".join([*lines, *(["\n### Diff (reference | hypothesis)\n", f"```\n{diff}\n```"] if diff else [])])


def corpus_report(corpus: str, items: DataFrame, missing: DataFrame, aggregate: DataFrame, profile: str = "default") -> str:
    """A corpus: items (item_id, wer, cer, cp_wer, der, ref_words), missing (item_id), one row of ``scoring.corpus_scores``."""
    rows = [list(r) for r in items.select("item_id", "wer", "cer", "cp_wer", "der", "ref_words").orderBy("item_id").collect()]
    gone = [str(r[0]) for r in missing.select("item_id").orderBy("item_id").collect()]
    lines = [f"# Corpus `{corpus}` (profile `{profile}`)", f"\nScored {len(rows)}/{len(rows) + len(gone)} items.", *(["Missing hypotheses: " + ", ".join(gone)] if gone else [])]
    lines.append("\n" + markdown(["item", "WER", "CER", "cpWER", "DER", "ref_words"], rows))
    found = aggregate.select("macro_wer", "macro_cer", "micro_wer", "micro_cer", "macro_cp_wer", "mean_der").first()
    if found is not None:
        kept = [(v, k) for k, v in found.asDict().items() if v is not None or k.startswith("mi")]
        lines += ["\n## Aggregate\n", markdown(["value", "metric"], kept)]
    return "\n".join(lines)


def leaderboard_report(board: DataFrame, title: str = "Leaderboard") -> str:
    """``ranking.leaderboard`` as Markdown, best first."""
    rows = [[r["rank"], r.variant, f"{r.n_completed}/{r.n_items}", r.macro_wer, r.macro_cer, r.macro_cp_wer, r.mean_der, r.mean_rtf, r.proxy, r.fallbacks] for r in board.orderBy("rank").collect()]
    return f"## {title}\n\n" + markdown(["#", "variant", "done", "WER", "CER", "cpWER", "DER", "RTF", "proxy", "fallbacks"], rows)
