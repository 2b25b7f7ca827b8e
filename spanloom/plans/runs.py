"""Queries of functions in SQL, variants that extend each other, recorded stages, and runs as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql, text
from ..operators import manifests, stages
from ..sources import canary, writers
from ..sources.scratch import scratch
from ..streaming import runs
from . import roles
from .registry import query
from .roles import using
from .scores import DP, PAIR, pairs


@query(using("seg", "ctc", recursive=True) + PAIR + DP + " SELECT k // 1000 AS meeting_id, k % 1000 AS seg_idx, edits, n AS ref_words, m AS hyp_words FROM edit WHERE n + m > 0")
def align_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """``align_ops`` as a table function of the session's SQL, each operation a row."""
    name = "turn_pairs"
    pairs(spark, d).select("meeting_id", "seg_idx", text.tokens(F.col("ref_text")).alias("r"), text.tokens(F.col("hyp_text")).alias("h")).createOrReplaceTempView(name)
    return sql.register(spark).sql(
        f"""SELECT p.meeting_id, p.seg_idx, count_if(a.tag <> 'equal') AS edits, count(a.reference) AS ref_words, count(a.hypothesis) AS hyp_words
        FROM {name} p, LATERAL align(p.r, p.h) a GROUP BY ALL"""
    )


_PARENT = "CASE WHEN p_partkey % 5 = 0 OR p_partkey <= 13 AND p_partkey % 97 <> 0 THEN NULL WHEN p_partkey % 101 = 0 THEN 'none' WHEN p_partkey % 97 = 0 THEN 'v' || (p_partkey + 13) ELSE 'v' || (p_partkey - 13) END"


@query(f"""WITH RECURSIVE v AS (SELECT 'm' || (p_partkey % 13) AS manifest, p_partkey AS k, 'v' || p_partkey AS id, {_PARENT} AS parent FROM part),
chain AS (
  SELECT manifest, id, k, parent, 0 AS depth, [id] AS path FROM v
  UNION ALL SELECT c.manifest, c.id, v.k, v.parent, c.depth + 1, list_append(c.path, v.id) FROM chain c JOIN v ON v.manifest = c.manifest AND v.id = c.parent WHERE NOT list_contains(c.path, v.id)
),
top AS (SELECT manifest, id, first(path ORDER BY depth DESC) AS path, first(parent ORDER BY depth DESC) AS parent FROM chain GROUP BY ALL),
opt AS (
  SELECT manifest, id, depth, 'backend.id' AS key, 'b' || (k % 4) AS value FROM chain WHERE k % 2 = 0
  UNION ALL SELECT manifest, id, depth, 'backend.options.o' || (k % 3), k::VARCHAR FROM chain
  UNION ALL SELECT manifest, id, 1000000, 'backend.id', 'base' FROM v UNION ALL SELECT manifest, id, 1000000, 'pipeline.mode', manifest FROM v
),
near AS (SELECT manifest, id, key, arg_min(value, depth) AS value FROM opt GROUP BY ALL),
merged AS (SELECT manifest, id, string_agg(key || '=' || value, ',' ORDER BY key) AS options FROM near GROUP BY ALL),
wrong AS (SELECT t.*, CASE WHEN t.parent IS NULL THEN '' WHEN v.id IS NULL THEN t.path[-1] || ' extends unknown ' || t.parent ELSE 'cycle at ' || t.parent END AS problem FROM top t LEFT JOIN v ON v.manifest = t.manifest AND v.id = t.parent)
SELECT w.manifest, w.id, CASE WHEN problem = '' THEN options ELSE '-' END AS options, array_to_string(path, ' ') AS lineage, problem FROM wrong w JOIN merged USING (manifest, id)""")
def extended_variants(spark: SparkSession, d: str) -> DataFrame:
    """Thirteen manifests of variants that extend each other: options of each, and the cycles and unknown parents among them."""
    k = F.col("p_partkey")
    own = F.map_filter(F.create_map(F.lit("backend.id"), F.when(k % 2 == 0, F.concat(F.lit("b"), (k % 4).cast("string"))), F.concat(F.lit("backend.options.o"), (k % 3).cast("string")), k.cast("string")), lambda _, v: v.isNotNull())
    v = roles.table(spark, d, "part").select(F.concat(F.lit("m"), (k % 13).cast("string")).alias("manifest"), F.concat(F.lit("v"), k.cast("string")).alias("id"), F.expr(_PARENT).alias("extends"), own.alias("options"))
    base = v.select("manifest").distinct().withColumn("options", F.create_map(F.lit("backend.id"), F.lit("base"), F.lit("pipeline.mode"), F.col("manifest")))
    out = manifests.resolved(v, base)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.select("manifest", "id", F.coalesce(shown, F.lit("-")).alias("options"), F.array_join("lineage", " ").alias("lineage"), F.coalesce("problem", F.lit("")).alias("problem"))


@query("SELECT 'turns' AS stage, 10.0::DOUBLE AS percent, count(*) AS n_rows, true AS sized FROM conversations UNION ALL SELECT 'users', 20.0, count(*), true FROM conversations WHERE role = 'user'")
def recorded_stages(spark: SparkSession, d: str) -> DataFrame:
    """Stages that are written, with the rows that were observed meanwhile."""
    t, folder = roles.turns(spark, d).select("meeting_id", "seg_idx", "speaker", "text"), scratch(spark, "recorded")
    events = writers.write_recorded(t, folder, "turns", "r", 10).unionByName(writers.write_recorded(t.where("speaker = 'user'"), folder, "users", "r", 20))
    of = lambda key: F.get_json_object("details", f"$.{key}").cast("double")
    return events.select("stage", "percent", of("rows").cast("long").alias("n_rows"), ((of("bytes") > of("rows")) & (of("seconds") > 0)).alias("sized"))


@query("""WITH e AS (SELECT user_id::VARCHAR AS run_id, date_trunc('milliseconds', ts) AS ts, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'running' END AS status, event_type AS stage FROM events),
w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM e),
l AS (SELECT run_id, arg_max(status, (ts, seq)) AS status, arg_max(stage, (ts, seq)) AS stage, max(ts) AS ts, count(DISTINCT (ts, seq)) AS events FROM e GROUP BY 1)
SELECT run_id, CASE WHEN status = 'running' AND ts + INTERVAL 15 MINUTE < mark THEN 'stalled' ELSE status END AS status, stage, events FROM l, w""")
def streamed_runs(spark: SparkSession, d: str) -> DataFrame:
    """All events as a stream of runs' states, repeated ones among them; runs that fall silent stall."""
    folder = scratch(spark, "stream")
    e = roles.table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "purchase", "completed").otherwise("running").alias("status"), F.lit(1.0).alias("percent"), F.col("event_type").alias("stage"))
    e.unionByName(e.where("seq % 3 = 0")).write.json(f"{folder}/events")
    changes = runs.states(runs.read_arrivals(spark, f"{folder}/events"))
    runs.write_states(changes, f"{folder}/states", f"{folder}/checkpoint").awaitTermination()
    return runs.latest_states(spark, f"{folder}/states").select("run_id", "status", "stage", "events")


@query(using("seg") + """, c AS (SELECT meeting_id, text, (row_number() OVER (PARTITION BY meeting_id ORDER BY seg_idx) - 1)::INTEGER AS i, s / 1000.0::DOUBLE AS a, e / 1000.0::DOUBLE AS b, seg_idx FROM seg),
g AS (
  SELECT meeting_id, seg_idx, a AS start, b AS "end", text FROM c WHERE meeting_id % 3 = 1
  UNION ALL SELECT meeting_id, i, i * 30.0::DOUBLE, i * 30.0::DOUBLE + 30, trim(regexp_replace(text, '\\s+', ' ', 'g')) FROM c WHERE meeting_id % 3 = 2 AND trim(text) <> ''
),
n AS (SELECT meeting_id, count(*) AS n FROM g GROUP BY 1)
SELECT g.meeting_id::VARCHAR AS meeting_id, CASE g.meeting_id % 3 WHEN 1 THEN 'backend' ELSE 'artifact' END AS provider, seg_idx::INTEGER AS seg_idx, start, "end", text, n AS n_segments, true AS available FROM g JOIN n USING (meeting_id)
UNION ALL SELECT DISTINCT meeting_id::VARCHAR, 'none', -1, 0.0, 0.0, '', 0, false FROM seg WHERE meeting_id % 3 = 0""")
def provided_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Base transcripts of meetings from a recognizer, from artifacts, or from nowhere."""
    s, folder = roles.segments(spark, d).select("meeting_id", "seg_idx", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"), "text"), scratch(spark, "artifacts")
    m = F.col("meeting_id") % 3
    chunks = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: F.struct(x.text.alias("text")))
    whole = s.where(m == 2).groupBy("meeting_id").agg(F.to_json(F.struct(chunks.alias("chunks"))).alias("content"))
    writers.write_files(whole.select(F.concat(F.col("meeting_id").cast("string"), F.lit(".json")).alias("path"), "content"), folder)
    stages.register("transcribe", "canary", lambda recordings: s.join(recordings.select("meeting_id"), "meeting_id", "left_semi"), canary.SEGMENTS)
    recordings = s.select("meeting_id").distinct().withColumn("provider", F.when(m == 0, "none").when(m == 1, "backend").otherwise("artifact"))
    segments, meta = canary.provided(recordings, folder)
    out = meta.join(segments, "meeting_id", "left")
    return out.select("meeting_id", "provider", F.coalesce("seg_idx", F.lit(-1)).alias("seg_idx"), F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce("end", F.lit(0.0)).alias("end"), F.coalesce("text", F.lit("")).alias("text"), "n_segments", "available")


@query(using("runs") + """, c AS (SELECT variant, item_id, item_id::VARCHAR AS a, status AS b, CASE WHEN item_id % 5 = 0 THEN '-' ELSE printf('%.4f', wer) END AS c, row_number() OVER (PARTITION BY variant ORDER BY item_id) AS n FROM runs),
w AS (SELECT variant, greatest(max(len(a)), 4) AS wa, greatest(max(len(b)), 6) AS wb, greatest(max(len(c)), 3) AS wc FROM c GROUP BY 1)
SELECT variant, n::INTEGER + 1 AS place, '| ' || rpad(a, wa::INT, ' ') || ' | ' || rpad(b, wb::INT, ' ') || ' | ' || rpad(c, wc::INT, ' ') || ' |' AS line FROM c JOIN w USING (variant)
UNION ALL SELECT variant, 0, '| ' || rpad('item', wa::INT, ' ') || ' | ' || rpad('status', wb::INT, ' ') || ' | ' || rpad('WER', wc::INT, ' ') || ' |' FROM w
UNION ALL SELECT variant, 1, '| ' || repeat('-', wa) || ' | ' || repeat('-', wb) || ' | ' || repeat('-', wc) || ' |' FROM w""")
def markdown_reports(spark: SparkSession, d: str) -> DataFrame:
    """The runs of every variant as a Markdown table."""
    r = roles.runs(spark, d).withColumn("wer", F.when(F.col("item_id") % 5 != 0, F.col("wer")))
    return writers.markdown_lines(r, ["variant"], ["item_id"], {"item_id": "item", "status": "status", "wer": "WER"})
