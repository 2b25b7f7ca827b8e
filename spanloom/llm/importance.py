"""Importance resampling towards a target: hashed n-gram gains, and a draw by Gumbel keys.

After data selection by importance resampling (Xie et al., 2023). Words are exploded with their positions; for each order a
window's ``lead`` over a text's words adds the words that follow, so every run of 1 to ``orders`` words is a feature. A
feature falls into one of ``buckets`` by its hash. Counts of all documents and of all target texts give each bucket a gain,
the log ratio of the smoothed shares in thousandths; a document's weight is the sum of the gains of its features, joined by
bucket. Weight plus a Gumbel key from the document's id is its score, and the ``percent`` highest scores of documents of
``least`` words or more are a draw without replacement in proportion to the exponentials of the weights.

All of it is DataFrame functions. Counts are summed within each task before they are shuffled, so a word that makes up a
third of all words costs one row a task, as does a text in the sum of its gains: exploded words are shuffled nowhere. Orders
above 1 shuffle the texts once, before the explosion, by a number of each row; the windows then find their words in place.
Gains have ``buckets`` rows and are broadcast. Ranks come from ranges of the scores, each numbered by itself.

Each row counts as a document of its own, repeated or not; among rows equal in score and id the ranks are given in any
order. A null text has no words; a null id has an empty one's key and comes first among ties; weights of texts without
features are 0. Columns other than doc_id and text are not read. Empty tables of either kind only leave counts at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stages, parts_for

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of anything beyond ASCII, with A-Z in lower case."""
    return F.filter(F.split(F.translate(text, _CAPITALS, _CAPITALS.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def features(texts: DataFrame, orders: int, *keep: str) -> DataFrame:
    """(row, ``keep``, feature, pos): each run of 1 to ``orders`` words; a text without words has one null feature.

    ``row`` numbers the rows of ``texts``, which has to give the same rows in the same order when a task is run again, as
    files do.
    """
    numbered = texts.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    if orders > 1:
        numbered = numbered.repartition(parts_for(texts, 32), "row")
    placed = numbered.select("row", *keep, F.posexplode_outer(words(F.col("text"))).alias("pos", "feature"))
    if orders < 2:
        return placed
    after = Window.partitionBy("row").orderBy("pos")
    # a run is null where the text ends before it does; concat keeps the null
    longer = [F.concat("feature", *(x for k in range(1, order) for x in (F.lit(" "), F.lead("feature", k).over(after)))) for order in range(2, orders + 1)]
    runs = placed.withColumn("runs", F.array("feature", *longer))
    each = runs.select("row", *keep, "pos", F.posexplode("runs").alias("order", "feature"))
    return each.where("feature IS NOT NULL OR order = 0").select("row", *keep, "feature", F.when(F.col("order") == 0, F.col("pos")).alias("pos"))


def _bucket(buckets: int) -> Column:
    return (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int").alias("bucket")


def gains(docs: DataFrame, target: DataFrame, orders: int, buckets: int) -> DataFrame:
    """(bucket, gain) of all buckets, ``gain`` in thousandths."""
    counted = [features(x.select("text"), orders).where("feature IS NOT NULL").groupBy(_bucket(buckets)).agg(F.count("*").alias(n)) for x, n in ((docs, "s"), (target, "t"))]
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    joined = every.join(counted[0], "bucket", "left").join(counted[1], "bucket", "left").fillna(0, ["s", "t"])
    totals = joined.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = F.expr(f"CAST((t + 1) AS DOUBLE) * (all_s + {buckets}) / (CAST((s + 1) AS DOUBLE) * (all_t + {buckets}))")
    return joined.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))  # totals: one row


def _numbered(rows: DataFrame, stages: Stages, *order: Column) -> DataFrame:
    """``rows`` with ``at``, each row's number by ``order``, from 1: ranges are numbered apart and the counts before added."""
    ranged = rows.repartitionByRange(parts_for(rows, 32), *order).withColumn("part", F.spark_partition_id())
    ranged = stages.write(ranged, "ranges")
    ends = ranged.groupBy("part").agg(F.count("*").alias("n"))
    starts = ends.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    near = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("near", near).join(F.broadcast(starts), "part").withColumn("at", F.col("near") + F.col("before")).drop("part", "near", "before")


def resampled(docs: DataFrame, target: DataFrame, orders: int = 2, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of ``docs`` (doc_id, text), towards the texts of ``target``.

    rank numbers the drawn rows from 1 and is null for the others; of the rows of ``least`` words or more ``percent`` in a
    hundred, rounded down, are drawn.
    """
    stages = Stages(docs.sparkSession, "importance")
    table = stages.write(gains(docs, target, orders, buckets), "gains")
    read = features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), orders, "doc_id").withColumn("bucket", _bucket(buckets))
    valued = read.join(F.broadcast(table), "bucket", "left")
    sums = valued.groupBy("row", "doc_id").agg(F.count("feature").alias("n_features"), F.count("pos").alias("n_words"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    key = F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = stages.write(sums.select("row", "doc_id", "n_features", "weight", (F.col("weight") + key).alias("score"), (F.col("n_words") >= least).alias("long")), "scored")
    drawn = scored.where("long").count() * percent // 100
    placed = _numbered(scored, stages, F.desc("long"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row"))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("at") <= drawn, F.col("at")).cast("long").alias("rank"))


def op13(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resampled(docs, target, orders=1)


#: DuckDB's account of ``op13``; the CRC's table of 256 comes from its polynomial.
SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS crc FROM steps WHERE k = 8),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS f FROM benchmark),
e AS (SELECT doc_id, unnest(w) AS f FROM d),
f AS (SELECT DISTINCT f, hex(encode(f)) AS x FROM (SELECT f FROM e UNION ALL SELECT f FROM b)),
h AS (
  SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda c, y: xor(crc[xor(c, y) % 256 + 1], c // 256)), CAST(4294967295 AS BIGINT)) % 10000 AS bucket FROM f, crc
),
s AS (SELECT bucket, count(*) AS s FROM e JOIN h USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (f) GROUP BY 1),
n AS (SELECT CAST((SELECT count(*) FROM e) AS DOUBLE) AS all_s, CAST((SELECT count(*) FROM b) AS DOUBLE) AS all_t),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (all_s + 10000) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * (all_t + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket), n),
w AS (SELECT e.doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM e JOIN h USING (f) JOIN g USING (bucket) GROUP BY 1),
x AS (
  SELECT d.doc_id, coalesce(len(d.w), 0) AS n_features, coalesce(w.weight, 0) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS key
  FROM d LEFT JOIN w USING (doc_id)
),
r AS (SELECT doc_id, n_features, weight, weight + key AS score, n_features >= 20 AS enough, row_number() OVER (ORDER BY n_features >= 20 DESC, weight + key DESC, doc_id) AS nth FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= (SELECT count(*) FROM r WHERE enough) * 10 // 100 THEN nth END AS rank FROM r
"""
