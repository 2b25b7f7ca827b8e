"""Review templates, saved runs, segment payloads and hypotheses, as tables; problems as texts in a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..model import UNKNOWN
from ..operators.windows import review_ends
from .readers import _stem, decoded, read_transcripts

# Fields of review templates, and the names of a run's saved stages.
SEGMENT = "struct<speaker:string,start_sec:string,start:string,end_sec:string,end:string,text:string>"
SAVED = {"base": "01c_therapy_canary_segments.json", "ctc": "01b_therapy_ctc_segments.json", "whisper": "01d_therapy_hallucination_segments.json"}
RUN_META, LANGUAGE = "00_run_meta.json", "ru"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A run's JSON artifact, an object or a list of objects; no rows where the file is missing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(name, value): whole files by name, .json ones of a folder."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return files.select(_stem(F.col("_metadata.file_path")).alias("name"), "value")


def _kind(value: Column) -> Column:
    return F.substring(F.ltrim(value), 1, 1)


def _listed(value: Column, *keys: str) -> Column:
    """The objects of a JSON list, or of the first list among an object's ``keys``, as texts; null where there is no list."""
    raw = F.when(_kind(value) == "[", value).otherwise(F.coalesce(*(F.get_json_object(value, f"$.{k}") for k in keys)))
    return F.when(_kind(raw) == "[", F.filter(F.from_json(raw, "array<string>"), lambda x: _kind(x) == "{"))


def read_segment_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(name, pos, start, end, text) of files with a list of segments, or an object with segments or else chunks.

    Entries that aren't objects are skipped; a file without a list raises.
    """
    value = F.col("value")
    items = F.coalesce(_listed(value, "segments", "chunks"), F.raise_error(F.concat(F.lit("no segment list in "), F.col("name"))).cast("array<string>"))
    each = _whole(spark, path).select("name", F.posexplode(items).alias("pos", "item"))
    number = lambda key: F.get_json_object("item", f"$.{key}").cast("double").alias(key)
    return each.select("name", "pos", number("start"), number("end"), F.coalesce(F.get_json_object("item", "$.text"), F.lit("")).alias("text"))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """(meeting_id, pos, speaker, start, end, text, end_sec) of reviewed templates: a file, or the .json files of a folder.

    meeting_id is the template's name; end_sec its own end: end_sec, duration_sec or duration.
    """
    value = F.col("value")
    top = F.coalesce(*(F.when(F.get_json_object(value, f"$.{k}").cast("double") != 0, F.get_json_object(value, f"$.{k}").cast("double")) for k in ("end_sec", "duration_sec", "duration")))
    items = F.coalesce(_listed(value, "segments"), F.raise_error(F.concat(F.lit("no segments in "), F.col("name"))).cast("array<string>"))
    each = _whole(spark, path).select(F.col("name").alias("meeting_id"), F.when(_kind(value) == "{", top).alias("end_sec"), F.posexplode(items).alias("pos", "item")).withColumn("s", F.from_json("item", SEGMENT))
    number = lambda a, b: F.coalesce(F.col(f"s.{a}"), F.col(f"s.{b}")).cast("double")
    return each.select("meeting_id", "pos", F.coalesce(F.nullif("s.speaker", F.lit("")), F.lit(UNKNOWN)).alias("speaker"), number("start_sec", "start").alias("start"), number("end_sec", "end").alias("end"), squeeze(F.col("s.text")).alias("text"), "end_sec")


def reviewed(reviews: DataFrame) -> DataFrame:
    """``read_reviews`` with missing ends filled and a ``problem`` where a segment has no start or text."""
    ends = reviews.groupBy("meeting_id").agg(F.max("end_sec").alias("end_sec"))
    return review_ends(reviews.drop("end_sec"), ends)


def checked_templates(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, problem, n_segments, canonical) of a folder's templates.

    problem tells why a template can't be accepted yet; canonical is an accepted one's JSON, its segments sorted by (start,
    end, speaker), with typed times.
    """
    value = F.col("value")
    files = _whole(spark, folder).withColumn("ok", F.coalesce(F.try_parse_json(value).isNotNull(), F.lit(False)))
    shape = (
        F.when(~F.col("ok"), "Review template JSON is invalid")
        .when(_kind(value) != "{", "Review template must be a JSON object with a `segments` list.")
        .when(F.coalesce(_kind(F.get_json_object(value, "$.segments")), F.lit("")) != "[", "Review template must contain a `segments` list.")
        .when(F.size(F.from_json(F.get_json_object(value, "$.segments"), "array<string>")) == 0, "Review template `segments` list is empty.")
    )
    marked = files.withColumn("shape", shape)
    good = marked.where("shape is null")
    items = F.filter(F.from_json(F.get_json_object("value", "$.segments"), "array<string>"), lambda x: _kind(x) == "{")
    each = good.select(F.col("name").alias("meeting_id"), F.coalesce(*(F.get_json_object(value, f"$.{k}").cast("double") for k in ("end_sec", "duration_sec", "duration"))).alias("end_sec"), F.posexplode(items).alias("pos", "item")).withColumn("s", F.from_json("item", SEGMENT))
    number = lambda a, b: F.coalesce(F.col(f"s.{a}"), F.col(f"s.{b}")).try_cast("double")
    rows = each.select("meeting_id", "pos", F.coalesce(F.nullif("s.speaker", F.lit("")), F.lit(UNKNOWN)).alias("speaker"), number("start_sec", "start").alias("start"), number("end_sec", "end").alias("end"), squeeze(F.col("s.text")).alias("text"), "end_sec")
    one = F.struct("start", "end", "speaker", "pos", "text")
    shown = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x.speaker.alias("speaker"), x.start.alias("start_sec"), x.end.alias("end_sec"), x.text.alias("text")))
    found = reviewed(rows).groupBy("meeting_id").agg(F.min("problem").alias("wrong"), F.count("*").alias("n"), F.to_json(shown).alias("segments"))
    out = marked.join(found, marked["name"] == found["meeting_id"], "left")
    problem = F.coalesce("shape", F.when(F.col("wrong").isNotNull(), F.concat(F.lit("Review template segments are invalid: "), F.col("wrong"))))
    return out.select(F.col("name").alias("chunk_id"), problem.alias("problem"), F.coalesce("n", F.lit(0)).alias("n_segments"), F.when(problem.isNull(), F.col("segments")).alias("canonical"))


def accepted(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content): a folder's templates that can be accepted, rewritten: segments in canonical form, all else as it was."""
    checked = checked_templates(spark, folder).where("canonical is not null").select("chunk_id", "canonical")
    own = _whole(spark, folder).join(checked, F.col("name") == F.col("chunk_id"))
    quoted = lambda key: F.expr(f"substring(to_json(array({key})), 2, length(to_json(array({key}))) - 2)")
    each = own.select("name", "canonical", F.posexplode(F.map_entries(F.from_json("value", "map<string,variant>"))).alias("pos", "e")).select("name", "pos", F.col("e.key").alias("key"), F.when(F.col("e.key") == "segments", F.col("canonical")).otherwise(F.to_json("e.value")).alias("json"))
    line = F.concat(quoted("key"), F.lit(": "), F.coalesce("json", F.lit("null")))
    listed = each.withColumn("line", line).groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), ", ").alias("all"))
    return listed.select(F.concat("name", F.lit(".json")).alias("path"), F.concat(F.lit("{"), "all", F.lit("}\n")).alias("content"))


def accept(spark: SparkSession, folder: str) -> None:
    """Writes the templates that can be accepted in canonical form over what they were; the others stay as they are."""
    from .single_files import write_files

    write_files(accepted(spark, folder), folder)


def read_saved_run(spark: SparkSession, folder: str) -> tuple[str, dict[str, DataFrame]]:
    """A saved run's language, and its base, ctc and whisper segments (meeting_id, seg_idx, start, end, text).

    The language is the requested one, else the detected one; missing stages are empty tables.
    """
    meta = read_artifact(spark, f"{folder}/{RUN_META}", "requested_language string, detected_language string").first()
    language = (meta and (meta.requested_language or meta.detected_language)) or LANGUAGE
    stages = {}
    for name, file in SAVED.items():
        if _exists(spark, f"{folder}/{file}"):
            rows = read_segment_payloads(spark, f"{folder}/{file}")
        else:
            rows = spark.createDataFrame([], "name string, pos int, start double, end double, text string")
        stages[name] = rows.select(F.lit(folder.rstrip("/").rsplit("/", 1)[-1]).alias("meeting_id"), F.col("pos").alias("seg_idx"), F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce("end", "start", F.lit(0.0)).alias("end"), "text")
    return language, stages


def read_saved_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run, language, stage, seg_idx, start, end, text) of all saved runs, one to a folder below ``root``, in one scan.

    A run without a stage has no rows of it; one without its record has the default language.
    """
    files = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(root, wholetext=True)
    path = decoded(F.col("_metadata.file_path"))
    files = files.select(F.element_at(F.split(path, "/"), -2).alias("run"), F.element_at(F.split(path, "/"), -1).alias("file"), "value")
    said = lambda key: F.nullif(F.get_json_object("value", f"$.{key}"), F.lit(""))
    meta = files.where(F.col("file") == RUN_META).select(F.col("run").alias("r"), F.coalesce(said("requested_language"), said("detected_language")).alias("said"))
    stage = F.coalesce(*(F.when(F.col("file") == file, name) for name, file in SAVED.items()))
    held = files.withColumn("stage", stage).where("stage is not null")
    items = F.coalesce(_listed(F.col("value"), "segments", "chunks"), F.raise_error(F.concat(F.lit("no segment list in "), F.col("run"))).cast("array<string>"))
    each = held.select("run", "stage", F.posexplode(items).alias("seg_idx", "item"))
    number = lambda key: F.get_json_object("item", f"$.{key}").cast("double")
    rows = each.select("run", "stage", "seg_idx", F.coalesce(number("start"), F.lit(0.0)).alias("start"), F.coalesce(number("end"), number("start"), F.lit(0.0)).alias("end"), F.coalesce(F.get_json_object("item", "$.text"), F.lit("")).alias("text"))
    return rows.join(meta, F.col("run") == F.col("r"), "left").select("run", F.coalesce("said", F.lit(LANGUAGE)).alias("language"), "stage", "seg_idx", "start", "end", "text")


def read_hypotheses(spark: SparkSession, items: DataFrame, folder: str | None) -> DataFrame:
    """Transcripts (item_id, language, duration, segments) of ``items`` (item_id, hypothesis): ``folder``'s <id>.json, else the item's own path.

    The folder is one scan, and so are all paths of the items' own, joined by the path that each row was read from. Paths are
    configuration, a manifest's worth of them: the folders that they name are listed, not each path asked for. Items with
    neither file have no row.
    """
    none = spark.createDataFrame([], "item_id string, language string, duration double, segments array<string>")
    held = None
    if folder is not None and _exists(spark, folder):
        held = read_transcripts(spark, folder).withColumnRenamed("meeting_id", "item_id").join(items.select("item_id"), "item_id", "left_semi")
    own = items.where("hypothesis is not null").withColumn("key", _bare(F.col("hypothesis")))
    own = own if held is None else own.join(held.select("item_id"), "item_id", "left_anti")
    there = _existing(spark, [r.hypothesis for r in own.select("hypothesis").distinct().collect()])
    if not there:
        return none if held is None else held
    read = read_transcripts(spark, there, _bare(decoded(F.col("_metadata.file_path"))).alias("key")).drop("meeting_id")
    out = own.select("item_id", "key").join(read, "key").select("item_id", "language", "duration", "segments")
    return out if held is None else held.select(*out.columns).unionByName(out)


def _bare(path: Column) -> Column:
    """A path without scheme and host."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of ``paths`` that are files, by one listing of each folder among them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    by: dict[str, list[str]] = {}
    for path in paths:
        by.setdefault(path.rpartition("/")[0], []).append(path)
    out = []
    for folder, of in by.items():
        where = jvm.org.apache.hadoop.fs.Path(folder or "/")
        fs = where.getFileSystem(conf)
        names = {x.getPath().getName() for x in fs.listStatus(where)} if fs.exists(where) else set()
        out += [p for p in of if p.rpartition("/")[2] in names]
    return sorted(out)
