"""Readers: transcripts, references in three shapes, manifests, artifacts, wiki dumps, audio."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import slug, squeeze
from ..model import REFERENCE_ITEM, TRANSCRIPT
from .scratch import scratch
from .single_files import read_files


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_transcripts(spark: SparkSession, path: str | list[str], *more: Column) -> DataFrame:
    """(meeting_id, language, duration, segments, ``more``) of transcript files, by file name; missing words are none, scores 0."""
    raw = spark.read.schema(TRANSCRIPT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    words = lambda s: F.coalesce(F.transform(s.words, lambda w: w.withField("score", F.coalesce(w.score, F.lit(0.0)))), F.array().cast(raw.schema["segments"].dataType.elementType["words"].dataType))
    return raw.select(_stem(F.col("_metadata.file_path")).alias("meeting_id"), "language", "duration", F.transform("segments", lambda s: s.withField("words", words(s))).alias("segments"), *more)


def segments_of(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("meeting_id", F.posexplode("segments").alias("seg_idx", "s")).select("meeting_id", "seg_idx", "s.speaker", "s.start", "s.end", "s.text", "s.confidence", "s.source")


def words_of(transcripts: DataFrame) -> DataFrame:
    each = transcripts.select("meeting_id", F.posexplode("segments").alias("seg_idx", "s"))
    return each.select("meeting_id", "seg_idx", F.posexplode("s.words").alias("word_idx", "w")).select("meeting_id", "seg_idx", "word_idx", "w.*")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """Reference segments (meeting_id, pos, speaker, start, end, text, kind) of .json and text files.

    kind: transcript (an object with segments), list (a bare list; its ends may be missing, see ``windows.infer_ends``) or
    text (lines ``[..] SPEAKER: text``, or text alone). Anything else in a .json file raises.
    """
    files = spark.read.text(path, wholetext=True).select(_stem(F.col("_metadata.file_path")).alias("meeting_id"), F.lower("_metadata.file_path").endswith(".json").alias("js"), "value")
    listed = F.from_json("value", f"array<{REFERENCE_ITEM}>")
    nested = F.from_json("value", f"struct<segments:array<{REFERENCE_ITEM}>>").segments
    first = F.substring(F.ltrim("value"), 1, 1)
    kind = F.when(~F.col("js"), "text").when(first == "[", "list").when(nested.isNotNull(), "transcript").otherwise(F.raise_error(F.concat(F.lit("neither an object with segments nor a list: "), F.col("meeting_id"))))
    js = files.withColumn("kind", kind).where("js").select("meeting_id", "kind", F.posexplode(F.when(F.col("kind") == "list", listed).otherwise(nested)).alias("pos", "s"))
    number = lambda *c: F.coalesce(*(F.col(x).try_cast("double") for x in c))
    timed = js.select("meeting_id", "pos", "s.speaker", number("s.start", "s.start_sec").alias("start"), number("s.end", "s.end_sec").alias("end"), F.coalesce("s.text", F.lit("")).alias("text"), "kind")
    lines = files.where("not js").select("meeting_id", F.posexplode(F.filter(F.transform(F.split("value", r"\R"), lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "line"))
    pattern = r"^\[[^\]]*\]\s+([^:]+):\s*(.*)$"
    hit = F.col("line").rlike(pattern)
    flat = lines.select("meeting_id", "pos", F.when(hit, F.trim(F.regexp_extract("line", pattern, 1))).alias("speaker"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.when(hit, F.trim(F.regexp_extract("line", pattern, 2))).otherwise(F.col("line")).alias("text"), F.lit("text").alias("kind"))
    return timed.unionByName(flat)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines and values that aren't objects are skipped, broken JSON raises."""
    lines = spark.read.text(path).where("trim(value) <> ''").where(F.substring(F.ltrim("value"), 1, 1) == "{")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_tuning_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, audio_path, reference_path, duration_limit) from a list, an object with entries, or JSON lines."""
    kind = "struct<case_id:string,audio_path:string,reference_path:string,duration_limit:double>"
    whole = spark.read.text(path, wholetext=not path.endswith(".jsonl")).where("trim(value) <> ''")
    first = F.substring(F.ltrim("value"), 1, 1)
    items = F.when(first == "[", F.from_json("value", f"array<{kind}>")).when(F.lit(path.endswith(".jsonl")), F.array(F.from_json("value", kind))).otherwise(F.from_json("value", f"struct<entries:array<{kind}>>").entries)
    rows = whole.select(F.explode(items).alias("r")).select("r.*")
    need = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c)).otherwise(F.raise_error(F.lit(f"a case lacks {c}")))
    return rows.select(F.coalesce("case_id", slug(_stem(F.col("audio_path")))).alias("case_id"), need("audio_path").alias("audio_path"), need("reference_path").alias("reference_path"), "duration_limit")


def read_chunked(spark: SparkSession, path: str) -> DataFrame:
    """Segments (meeting_id, seg_idx, start, end, text) of chunked artifacts: chunk i spans i to i + 1 chunk lengths,
    narrowed to the times of its words as of the first timestamps under its name; empty texts go."""
    times = "array<struct<chunk:string,timestamp:struct<word:array<struct<start:double,end:double>>>>>"
    raw = spark.read.schema(f"meta struct<chunk_seconds:double>, chunks array<struct<chunk:string,text:string>>, timestamps {times}").option("multiLine", True).json(path)
    each = raw.select(_stem(F.col("_metadata.file_path")).alias("meeting_id"), F.coalesce(F.nullif("meta.chunk_seconds", F.lit(0.0)), F.lit(30.0)).alias("len"), F.coalesce("timestamps", F.array().cast(times)).alias("t"), F.posexplode("chunks").alias("seg_idx", "c"))
    name = F.coalesce(F.nullif("c.chunk", F.lit("")), F.format_string("chunk_%03d.wav", "seg_idx"))
    found = each.withColumn("name", name).withColumn("w", F.filter(F.get(F.filter("t", lambda x: x.chunk == F.col("name")), F.lit(0)).timestamp.word, lambda w: w.start.isNotNull() & w.end.isNotNull()))
    at = F.col("seg_idx") * F.col("len")
    start = F.bround(at + F.coalesce(F.array_min(F.transform("w", lambda w: w.start)), F.lit(0.0)), 3)
    end = F.bround(at + F.coalesce(F.array_max(F.transform("w", lambda w: w.end)), F.col("len")), 3)
    return found.select("meeting_id", "seg_idx", start.alias("start"), end.alias("end"), squeeze(F.col("c.text")).alias("text")).where("text <> ''")


def read_wiki(spark: SparkSession, path: str, pages: int | None = None) -> DataFrame:
    """(title, text) of articles in a wiki dump, packed or not: main namespace, no redirects, no empty pages."""
    schema = "title string, ns string, redirect struct<_title:string>, revision struct<text:struct<_VALUE:string>>"
    raw = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", True).schema(schema).load(path)
    out = raw.where("ns = '0' and redirect is null").select("title", F.col("revision.text._VALUE").alias("text")).where("text <> ''")
    return out if pages is None else out.limit(pages)


def read_texts(spark: SparkSession, path: str, label: str, weight: int = 1, blocks: bool = False) -> DataFrame:
    """(label, weight, doc_id, text) of all files of a folder or of one file; ``blocks``: a row from each blank line to the next."""
    if weight <= 0:
        raise ValueError(f"the weight of {label} must be positive, not {weight}")
    read = spark.read.option("recursiveFileLookup", True)
    files = read.option("lineSep", "\n\n").text(path) if blocks else read.text(path, wholetext=True)
    return files.select(F.lit(label).alias("label"), F.lit(weight).alias("weight"), F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def read_groups(spark: SparkSession, groups: list[tuple[str, int, str]], extra: list[str] | None = None, limit: int | None = None, blocks: bool = False) -> DataFrame:
    """Sentences (label, weight, doc_id, pos, sentence) of groups (label, weight, path), and of ``extra`` paths at weight 1.

    ``blocks``: a file is read in pieces, from one blank line to the next, so that one of any size is many rows in many tasks;
    a sentence then ends at a blank line at the latest, and pieces of a file are in no order. Else a file is one row.

    A blank label is group_1, group_2, ...; limit: the first sentences over all groups, in their order, then by file name.
    """
    from ..operators.corpus import corpus_sentences

    listed = [((label.strip() or f"group_{k}"), weight, path) for k, (label, weight, path) in enumerate(groups, 1)] + [("extra", 1, path) for path in extra or []]
    texts = None
    for k, (label, weight, path) in enumerate(listed):
        part = read_texts(spark, path, label, weight, blocks).withColumn("doc_id", F.struct(F.lit(k).alias("group"), "doc_id"))
        texts = part if texts is None else texts.unionByName(part)
    if texts is None:
        raise ValueError("a corpus needs a group or an extra text")
    out = corpus_sentences(texts)
    out = out if limit is None else out.orderBy("doc_id", "pos").limit(limit)
    return out.withColumn("doc_id", F.col("doc_id.doc_id"))


#: Kinds of audio files that are known; only the first is decoded here, others by a registered audio stage.
AUDIO = (".wav", ".mp3", ".mp4", ".m4a", ".ogg", ".flac", ".webm")


def read_audio(spark: SparkSession, path: str, rate: int = 16000) -> DataFrame:
    """(path, samples, duration) of one audio file or a folder of WAV files; a missing or unknown file raises at once."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(path)
    suffix = PurePosixPath(path).suffix.lower()
    if not fs.getFileStatus(where).isDirectory() and suffix not in AUDIO:
        raise ValueError(f"{path} isn't one of {', '.join(AUDIO)}")
    if suffix in AUDIO[1:]:
        raise ValueError(f"{suffix} files need a registered audio stage that decodes them")
    return read_wav(spark, path, rate)


def cached_audio(audio: DataFrame, path: str) -> DataFrame:
    """``audio`` written once to ``path`` and read from there, by later runs, too."""
    audio.write.mode("ignore").parquet(path)
    return audio.sparkSession.read.schema(audio.schema).parquet(path)


def read_wav(spark: SparkSession, path: str, rate: int = 16000) -> DataFrame:
    """(path, samples, duration) of mono 16-bit WAV files; other kinds raise."""
    return decoded_wav(spark.read.format("binaryFile").load(path).select("path", "content"), rate)


def decoded_wav(files: DataFrame, rate: int = 16000) -> DataFrame:
    """``read_wav`` of files (path, content) that are a table already, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with wave.open(io.BytesIO(data)) as w:
                    if (w.getnchannels(), w.getsampwidth(), w.getframerate()) != (1, 2, rate):
                        raise ValueError(f"{name} isn't mono 16-bit at {rate} Hz")
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([x], pa.list_(pa.float32())), pa.array([len(x) / rate])], names=["path", "samples", "duration"])

    return files.select("path", "content").mapInArrow(run, "path string, samples array<float>, duration double")


def clipped(audio: DataFrame, seconds: float, rate: int = 16000) -> DataFrame:
    """Audio cut to its first seconds, with the duration that is left."""
    out = audio.withColumn("samples", F.slice("samples", 1, int(seconds * rate)))
    return out.withColumn("duration", F.size("samples") / float(rate))


def voiced(samples: Column) -> Column:
    """Whether any sample is louder than 1e-5."""
    return F.exists(samples, lambda x: F.abs(x) > 1e-5)


def rms(samples: Column) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / F.size(samples) + 1e-8)


def audio_chunks(audio: DataFrame, seconds: float, rate: int = 16000) -> DataFrame:
    """(path, chunk, start, end, samples): consecutive chunks, the last one short."""
    n = int(seconds * rate)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("samples") / n) - 1, F.lit(0)).cast("int"))
    each = audio.where("size(samples) > 0").select("path", "samples", F.explode(starts).alias("chunk"))
    total = F.size("samples")
    return each.select("path", "chunk", F.bround(F.col("chunk") * n / rate, 3).alias("start"), F.bround(F.least(total, (F.col("chunk") + 1) * n) / rate, 3).alias("end"), F.slice("samples", F.col("chunk") * n + 1, n).alias("samples"))


# ---- manifests: small files of configuration, from wherever Spark reads

CORPUS_KEYS, ITEM_KEYS = {"name", "profile", "defaults", "items"}, {"id", "audio", "reference", "hypothesis", "language", "duration_limit", "notes"}
EXPERIMENT_KEYS = {"id", "description", "audio", "corpus", "reference", "profile", "max_workers", "output_dir", "defaults", "variants"}
VARIANT_KEYS = {"id", "description", "extends", "pipeline", "backend"}


def _load(spark: SparkSession, path: str) -> dict:
    text = spark.read.text(path, wholetext=True).first().value
    if path.endswith((".yaml", ".yml")):
        import yaml

        out = yaml.safe_load(text)
    else:
        out = json.loads(text)
    if not isinstance(out, dict):
        raise ValueError(f"{path} isn't an object")
    return out


def _closed(found: dict, allowed: set[str], where: str) -> None:
    if extra := sorted(set(found) - allowed):
        raise ValueError(f"unknown keys in {where}: {', '.join(extra)}")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(corpus, profile, item_id, reference, audio, hypothesis, language, duration_limit, notes) of a corpus manifest."""
    found = _load(spark, path)
    _closed(found, CORPUS_KEYS, path)
    if not isinstance(found.get("items"), list) or not found["items"]:
        raise ValueError(f"{path} has no items")
    base, rows, seen = PurePosixPath(path).parent, [], set()
    at = lambda x: None if x is None else str(base / x)
    for raw in found["items"]:
        item = {**(found.get("defaults") or {}), **raw}
        _closed(item, ITEM_KEYS, f"an item of {path}")
        if not item.get("id") or not item.get("reference"):
            raise ValueError(f"an item of {path} lacks id or reference")
        if item["id"] in seen:
            raise ValueError(f"{path} has two items {item['id']!r}")
        seen.add(item["id"])
        limit = item.get("duration_limit")
        rows.append((str(found.get("name") or PurePosixPath(path).stem), str(found.get("profile") or "default"), str(item["id"]), at(item["reference"]), at(item.get("audio")), at(item.get("hypothesis")), item.get("language"), None if limit is None else float(limit), item.get("notes")))
    return spark.createDataFrame(rows, "corpus string, profile string, item_id string, reference string, audio string, hypothesis string, language string, duration_limit double, notes string")


def decoded(path: Column) -> Column:
    """A row's file path as the file system has it."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_corpora(spark: SparkSession, folder: str, checked: bool = True) -> DataFrame:
    """``read_corpus`` of every .json manifest of a folder, in one scan, with its ``path`` and a ``problem``.

    A manifest with unknown keys, without items, with an item that lacks an id or reference or has unknown keys, or with two
    items of one id has a problem on each of its rows, of which there is at least one; ``checked`` raises it.
    """
    kind = "name string, profile string, defaults map<string,string>, items array<map<string,string>>"
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(decoded(F.col("_metadata.file_path")).alias("path"), "value")
    read = files.select("path", F.from_json("value", kind).alias("m"), F.from_json("value", "map<string,string>").alias("top"))
    unknown = lambda found, keys: F.array_sort(F.array_except(F.map_keys(found), F.array(*map(F.lit, sorted(keys)))))
    named = lambda what, keys: F.when(F.size(keys) > 0, F.concat(F.lit(f"unknown keys {what}: "), F.array_join(keys, ", ")))
    items = F.coalesce("m.items", F.array().cast("array<map<string,string>>"))
    ids = F.transform(items, lambda i: F.try_element_at(i, F.lit("id")))
    whole = F.coalesce(
        F.when(F.col("m").isNull() | F.col("top").isNull(), "no JSON object"), named("of the manifest", unknown(F.col("top"), CORPUS_KEYS)),
        F.when(F.size(items) == 0, "no items"), F.when(F.size(F.array_distinct(ids)) < F.size(ids), "two items of one id"),
    )
    each = read.select("path", "m", whole.alias("whole"), F.explode_outer(items).alias("own"))
    none = F.create_map().cast("map<string,string>")
    given = F.map_filter(F.coalesce("m.defaults", none), lambda k, v: ~F.map_contains_key(F.coalesce("own", none), k))
    each = each.withColumn("item", F.map_concat(given, F.coalesce("own", none)))
    of = lambda key: F.try_element_at("item", F.lit(key))
    missing = F.when((F.coalesce(of("id"), F.lit("")) == "") | (F.coalesce(of("reference"), F.lit("")) == ""), "an item lacks id or reference")
    problem = F.coalesce("whole", missing, named("of an item", unknown(F.col("item"), ITEM_KEYS)))
    first = F.min("problem").over(Window.partitionBy("path"))
    each = each.withColumn("problem", problem).withColumn("problem", first)
    if checked:
        each = each.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "problem"))).cast("string"))
    base = F.regexp_replace("path", "/[^/]*$", "")
    at = lambda key: F.when(of(key).startswith("/"), of(key)).otherwise(F.concat(base, F.lit("/"), of(key))).alias(key)
    filled = lambda x, other: F.coalesce(F.nullif(x, F.lit("")), other)
    stem = _stem(F.col("path"))
    return each.select(
        "path", filled(F.col("m.name"), stem).alias("corpus"), filled(F.col("m.profile"), F.lit("default")).alias("profile"), of("id").alias("item_id"), at("reference"), at("audio"), at("hypothesis"),
        of("language").alias("language"), of("duration_limit").try_cast("double").alias("duration_limit"), of("notes").alias("notes"), "problem",
    )


def deep_merge(under: dict, over: dict) -> dict:
    """Nested keys of ``over`` win; lists are replaced."""
    out = dict(under)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_experiment(spark: SparkSession, path: str) -> DataFrame:
    """(experiment_id, preset_id, description, pipeline, backend) of a manifest's variants, options as JSON.

    A variant is merged over the one it extends, that over the defaults; unknown parents and cycles are errors, as are
    both or neither of audio and corpus.
    """
    found = _load(spark, path)
    _closed(found, EXPERIMENT_KEYS, path)
    if bool(found.get("audio")) == bool(found.get("corpus")):
        raise ValueError(f"{path} needs one of audio and corpus")
    variants = {}
    for v in found.get("variants") or []:
        _closed(v, VARIANT_KEYS, f"a variant of {path}")
        if not v.get("id") or v["id"] in variants:
            raise ValueError(f"{path} has a variant without an id of its own: {v.get('id')!r}")
        variants[v["id"]] = v
    if not variants:
        raise ValueError(f"{path} has no variants")

    def resolved(name: str, under: tuple[str, ...] = ()) -> dict:
        if name in under or name not in variants:
            raise ValueError(f"{path}: variant {name!r} is {'its own parent' if name in under else 'unknown'}")
        own, parent = variants[name], variants[name].get("extends")
        base = resolved(parent, (*under, name)) if parent else found.get("defaults") or {}
        return deep_merge(base, {k: own[k] for k in ("pipeline", "backend") if k in own})

    rows = [(str(found["id"]), k, v.get("description"), json.dumps(r.get("pipeline") or {}, sort_keys=True), json.dumps(r.get("backend") or {}, sort_keys=True)) for k, v in variants.items() for r in [resolved(k)]]
    return spark.createDataFrame(rows, "experiment_id string, preset_id string, description string, pipeline string, backend string")


#: What a preset may say of the pipeline, and its modes.
PIPELINE_KEYS = {"language", "min_speakers", "max_speakers", "content_mode", "duration_limit", "parallel_post_asr", "skip_alignment", "skip_diarization"}
CONTENT_MODES = ("single-speaker", "multi-speaker")


def read_presets(spark: SparkSession, folder: str) -> DataFrame:
    """(preset_id, description, pipeline, backend_id, options) of the .json files of a folder, options as JSON.

    A missing or repeated id, an unknown pipeline key or mode, and a backend without an id are errors.
    """
    files = read_files(spark, folder, "*.json").where(~F.col("path").contains("/") & ~F.substring("path", 1, 1).isin("_", "."))
    text = F.ltrim(F.col("content").cast("string"), F.lit("\ufeff"))
    kind = "struct<id:string,description:string,pipeline:string,backend:string>"
    one = F.coalesce(F.from_json(text, f"array<{kind}>"), F.array(F.lit(None).cast(kind)))  # what isn't JSON lacks its id
    kept = scratch(spark, "presets")  # each file is opened once, not for each check
    files.where(F.trim(text) != "").select(F.explode(one).alias("p")).select("p.*").write.parquet(kept)
    raw = spark.read.schema("id string, description string, pipeline string, backend string").parquet(kept)
    keys = F.json_object_keys(F.coalesce("pipeline", F.lit("{}")))
    unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, sorted(PIPELINE_KEYS)))))
    mode = F.coalesce(F.nullif(F.get_json_object("pipeline", "$.content_mode"), F.lit("")), F.lit(CONTENT_MODES[1]))
    problem = (
        F.when(F.coalesce("id", F.lit("")) == "", "a preset lacks its id")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown pipeline keys in "), F.col("id"), F.lit(": "), F.array_join(unknown, ", ")))
        .when(~mode.isin(*CONTENT_MODES), F.concat(F.lit("no content mode "), mode, F.lit(" in "), F.col("id")))
        .when(F.coalesce(F.get_json_object("backend", "$.id"), F.lit("")) == "", F.concat(F.lit("no backend id in "), F.col("id")))
    )
    wrong = raw.select(problem.alias("p")).where("p is not null").limit(1).collect()
    if wrong:
        raise ValueError(wrong[0].p)
    twice = raw.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two presets have the id {twice[0].id!r}")
    return raw.select(F.col("id").alias("preset_id"), "description", "pipeline", F.get_json_object("backend", "$.id").alias("backend_id"), F.coalesce(F.get_json_object("backend", "$.options"), F.lit("{}")).alias("options"))
