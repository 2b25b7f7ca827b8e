"""Benchmark decontamination: which test items stand in which documents, by size-partitioned MinHash containment search.

Words are runs of letters and digits, lower-cased; an item's set is its distinct 5-word shingles, with fewer words the
whole sequence as one. A document contains an item if ``percent`` or more of the item's set is in it.

Search (after LSH Ensemble, Zhu et al., 2016): items are partitioned by set size, and each partition has the MinHash
signature length that its largest sets need: the k least hashes, with k one more than the shingles that may be missing,
so an item that is contained has a signature hash in the document and none is lost. Documents of any length are probed
with all their shingle hashes, so long ones need no signature that would drown a short item. Candidates that are too
short are left out, and the rest verified: the item's shingles, as words, are looked up among the document's.

All of it is DataFrame functions. Benchmark signatures and candidate pairs are broadcast up to ``shared.BROADCAST_ROWS`` rows,
which is counted first, and joined by a shuffle beyond that. Null texts and texts without words contain nothing and are
contained in nothing. Rows with equal (doc_id, text) are one document, null ids included, as are equal items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Stages, bounded, unused

SIZE = 5


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(w: str, length: int) -> Column:
    parts = ", ".join(f"{w}[i + {k}]" for k in range(length))
    return F.expr(f"CASE WHEN size({w}) >= {length} THEN transform(sequence(0, size({w}) - {length}), i -> xxhash64({parts})) ELSE array() END")


def _strings(w: str, length: int) -> Column:
    parts = ", ".join(f"{w}[i + {k}]" for k in range(length))
    return F.expr(f"CASE WHEN size({w}) >= {length} THEN transform(sequence(0, size({w}) - {length}), i -> concat_ws(' ', {parts})) ELSE array() END")


def contained(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, th, item_id, n_shared, n_item): pairs of documents (doc_id, text) and items (item_id, text); th: text's hash."""
    stages = Stages(docs.sparkSession, "containment")
    listed = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string")).alias("w")).where("size(w) > 0").withColumn("length", F.least(F.size("w"), F.lit(SIZE)))
    lengths = sorted(r[0] for r in listed.select("length").distinct().collect())  # five at most
    if not lengths:
        lengths = [SIZE]
    own = F.coalesce(*(F.when(F.col("length") == k, _strings("w", k)) for k in lengths))
    listed = listed.select("item_id", F.array_distinct(own).alias("shingles"), F.array_distinct(F.coalesce(*(F.when(F.col("length") == k, _hashes("w", k)) for k in lengths))).alias("hashes")).distinct()
    listed = stages.write(listed.withColumn("n", F.size("shingles")), "items")
    most = F.pow(F.lit(2), F.floor(F.log2(F.col("n").cast("double"))) + 1).cast("int") - 1  # the largest set of its partition
    kept = most - F.ceil(most * percent / 100).cast("int") + 1
    signed = listed.select("item_id", "n", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), F.least(kept, F.size("hashes")))).alias("hash"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    read = docs.select("doc_id", "th", words(F.col("text")).alias("w"))
    probes = read.select("doc_id", "th", F.size("w").alias("n_words"), F.explode(F.flatten(F.array(*(_hashes("w", k) for k in lengths)))).alias("hash"))
    met = probes.join(bounded(signed), "hash").where(F.col("n_words") * 100 >= F.col("n") * percent)
    pairs = stages.write(met.select("doc_id", "th", "item_id").distinct(), "candidates")
    keys = bounded(pairs.select(F.col("doc_id").alias("d"), F.col("th").alias("h")).distinct())
    named = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left_semi").dropDuplicates(["doc_id", "th"])
    full = named.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), words(F.col("text")).alias("w")).select("d", "h", F.flatten(F.array(*(_strings("w", k) for k in lengths))).alias("have"))
    sets = bounded(pairs).join(full, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).join(bounded(listed.select(F.col("item_id").alias("i"), "shingles", "n")), F.col("item_id").eqNullSafe(F.col("i")))
    found = sets.select("doc_id", "th", "item_id", F.size(F.array_intersect("shingles", "have")).cast("long").alias("n_shared"), F.col("n").cast("long").alias("n_item"))
    return found.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).distinct()


def clean(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    doc, th = unused(docs.columns, "id", "th")
    found = contained(docs.select("doc_id", "text"), items, percent).select(F.col("doc_id").alias(doc), F.col("th").alias(th)).distinct()
    found = bounded(Stages(docs.sparkSession, "leaks").write(found, "documents"))
    own = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found[doc]) & (own == found[th]), "left_anti")


#: DuckDB's account of ``op3``.
SQL = r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark
),
s AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 AND kind = 1 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
),
n AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE kind = 1 GROUP BY 1)
SELECT d.id AS doc_id, n.item_id, count(*) AS n_shared, any_value(n.n_item) AS n_item
FROM s d JOIN s b ON d.s = b.s AND d.kind = 0 AND b.kind = 1 JOIN n ON n.item_id = b.id
GROUP BY d.id, n.item_id HAVING count(*) * 100 >= any_value(n.n_item) * 75
"""
