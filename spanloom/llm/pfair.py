"""Mixing sources to target weights by Pfair scheduling (Baruah et al., "Proportionate Progress", 1996).

A source's documents, by doc_id, are cut into blocks of ``block`` documents. With target weight w of a sum of W, block k
of a source is released at slot floor(k W / w) and due by slot ceil((k + 1) W / w). One block goes to each slot: of the
released blocks the one that is due first, ties to the source first in order. On a single output earliest deadline first
meets every such window, so after any number of slots each source is less than one block away from its share.

Windows repeat every W slots, so one period is planned, on the driver, from the weights alone; the k-th block of a source
then finds its slot by arithmetic. A source that has run out leaves its slots empty, and the rest keep theirs: no row is
dropped or repeated. Documents are numbered within a source by ranges of (source, doc_id), so a source may hold any part
of all rows. Texts are carried, never read, so they may be of any length; ties and repeated rows of a source follow each
other, null sources are one source, null ids come first in theirs, and an empty table makes an empty mix.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stages, bounded, parts_for


def period(weights: list[int]) -> list[int]:
    """The source of each slot of one period of sum(weights) slots."""
    total, due, free, out = sum(weights), [], [], []
    free = [(0, s, 0) for s, w in enumerate(weights) if w > 0]  # release, source, block
    heapq.heapify(free)
    for slot in range(total):
        while free and free[0][0] <= slot:
            _, s, k = heapq.heappop(free)
            heapq.heappush(due, (-(-(k + 1) * total // weights[s]), s, k))
        _, s, k = heapq.heappop(due)
        out.append(s)
        if k + 1 < weights[s]:
            heapq.heappush(free, ((k + 1) * total // weights[s], s, k + 1))
    return out


def _numbered(docs: DataFrame, stages: Stages) -> DataFrame:
    """``docs`` (source, doc_id, row) with ``at``, each row's number within its source by (doc_id, row), from 0.

    Rows are sorted in ranges, and each range is a file; a row's place in its file, less that of its source's first one there,
    and the source's rows in the ranges before make up its number. No source is gathered anywhere.
    """
    keys = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("row")]
    ranged = docs.repartitionByRange(parts_for(docs, 64), *keys).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*keys)
    placed = stages.write(ranged, "ranges").select("source", "doc_id", "row", "part", F.col("_metadata.row_index").alias("near"))
    # one row for each range and source: their running sums within a source
    ends = placed.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("near").alias("first"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")
    starts = ends.select(F.col("part").alias("p"), F.col("source").alias("s"), (before - F.col("first")).alias("before"))
    joined = placed.join(bounded(starts), (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return joined.select("source", "doc_id", "row", (F.col("near") + F.col("before")).alias("at"))


def schedule(docs: DataFrame, weight: Column, block: int = 16) -> DataFrame:
    """(doc_id, source, row, at, block, release, deadline, slot) of each row of ``docs`` (doc_id, source).

    ``weight``: the whole target weight of a row's source, 1 or more. Target weights are configuration, and the schedule of
    one period needs all of them: sources and weights come to the driver, never rows. row tells rows of the same source and
    doc_id apart. A null source is a source of its own.
    """
    stages = Stages(docs.sparkSession, "pfair")
    cols = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.col("row").cast("long").alias("row"))
    found = [(r[0], int(r[1])) for r in docs.select(F.col("source").cast("string").alias("source"), weight.alias("w")).groupBy("source").agg(F.max("w").alias("w")).orderBy(F.asc_nulls_first("source")).collect()]
    numbered = _numbered(cols, stages)
    total = sum(w for _, w in found) or 1
    slots: list[list[int]] = [[] for _ in found]
    for slot, s in enumerate(period([w for _, w in found])):
        slots[s].append(slot)
    plan = docs.sparkSession.createDataFrame([(name, w, s) for (name, w), s in zip(found, slots, strict=True)], "name string, w long, slots array<int>")
    k = F.floor(F.col("at") / block)
    out = numbered.join(bounded(plan), F.col("source").eqNullSafe(F.col("name"))).withColumn("block", k.cast("long"))
    turn, rest = F.floor(F.col("block") / F.col("w")), (F.col("block") % F.col("w")).cast("int")
    return out.select(
        "doc_id", "source", "row", "at", "block",
        F.expr(f"block * {total} div w").alias("release"), F.expr(f"((block + 1) * {total} + w - 1) div w").alias("deadline"),
        (turn * total + F.element_at("slots", rest + 1)).cast("long").alias("slot"),
    )


def mixed(docs: DataFrame, weight: Column, block: int = 16) -> DataFrame:
    """All rows of ``docs`` with all their columns, sorted by slot: written, its files follow the mix, row by row.

    Rows that are equal in all sortable columns share a slot.
    """
    sortable = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    key, name, of = F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(*sortable)
    marked = docs.select(F.struct("*").alias("row"), key.alias("key"), name.alias("name"), of.alias("of"))
    plan = schedule(docs.select("doc_id", "source", of.alias("row")), weight, block).groupBy(F.col("doc_id").alias("k"), F.col("source").alias("s"), F.col("row").alias("o")).agg(F.min("slot").alias("slot"), F.min("at").alias("at"))
    joined = marked.join(plan, F.col("key").eqNullSafe(F.col("k")) & F.col("name").eqNullSafe(F.col("s")) & (F.col("of") == F.col("o")))
    placed = joined.repartitionByRange(parts_for(docs, 128), "slot", "at").sortWithinPartitions("slot", "at")
    return placed.select("row.*")


def by_number(source: Column) -> Column:
    """The target weights of the query and the pipeline: 1 to 4 by the number in a source's name, 1 without one."""
    number = F.substring(F.regexp_extract(source, "([0-9]+)", 1), -9, 9)
    return F.coalesce(number.try_cast("long"), F.lit(0)) % 4 + 1


#: DuckDB's account of ``schedule`` with those weights and blocks of 16: earliest deadline first, slot by slot.
SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS at,
    coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), 0) % 4 + 1 AS w FROM documents
),
src AS (SELECT source, any_value(w) AS w, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM d GROUP BY source),
t AS (SELECT CAST(sum(w) AS BIGINT) AS total, list(w ORDER BY i) AS ws FROM src),
run AS (
  SELECT CAST(0 AS BIGINT) AS slot, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS pick FROM t
  UNION ALL
  SELECT slot + 1, list_transform(range(1, len(done) + 1), lambda i: done[i] + CAST(i = best AS BIGINT)), best FROM (
    SELECT slot, done, list_min(list_transform(list_filter(range(1, len(ws) + 1), lambda i: done[i] < ws[i] AND done[i] * total // ws[i] <= slot),
      lambda i: ((done[i] + 1) * total + ws[i] - 1) // ws[i] * 1000000 + i)) % 1000000 AS best
    FROM run, t WHERE slot < total)
),
plan AS (SELECT pick AS i, slot - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS j FROM run WHERE pick IS NOT NULL)
SELECT d.doc_id, d.source, d.at, d.at // 16 AS block, (d.at // 16) * total // d.w AS release, ((d.at // 16 + 1) * total + d.w - 1) // d.w AS deadline,
  (d.at // 16) // d.w * total + plan.slot AS slot
FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source CROSS JOIN t JOIN plan ON plan.i = src.i AND plan.j = (d.at // 16) % d.w
"""
