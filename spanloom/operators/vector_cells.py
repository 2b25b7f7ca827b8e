"""Cells for vector search: vectors are kept by their nearest centroid, probes look into the cells nearest to them.

Centroids are fitted on the ``sample`` vectors of least hash, which any vector may be among: each round deals the sample to
its nearest centroids and averages it by cell in DataFrame aggregates, until no vector moves or ``rounds`` are over. Sample
and centroids are bounded by their parameters, so centroids go to all tasks. Every vector is then dealt to a cell and
written, once; a cell of more than ``split`` vectors is cut into parts by id, so that a cell with a third of all vectors is
many tasks. A cell keeps the widest angle between its centroid and a vector.

A search looks into the ``near`` cells nearest to each probe, as many as ``near_for`` measures for a wanted recall, and ranks
what is there exactly: a group of one part's vectors
and a slice of the probes that ask for it is a product of two matrices, and leaves ``top`` rows a probe. ``certain=True``
goes on to every other cell in which, by its widest angle, a better vector could be: the result is then that of
``search.cosine``, whatever the centroids are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .search import ROWS, cosine, few, nearest, ranked, unit

#: Scores are compared after rounding to four digits.
_SLACK = 6e-5


def _dealt(vectors: DataFrame, id_: str, vector: str, centroids: np.ndarray, near: int) -> DataFrame:
    """(id, vector, cells): each vector's ``near`` nearest cells with their cosines, the nearest first."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = dict(vectors.dtypes)[id_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            m = unit(batch.column(1).to_pandas())
            s = m @ c.T if len(m) else np.zeros((0, len(c)))
            pick = np.argsort(-s, axis=1, kind="stable")[:, :near]
            got = np.take_along_axis(s, pick, 1)
            cells = [[{"cell": int(a), "cosine": float(b)} for a, b in zip(x, y, strict=True)] for x, y in zip(pick, got, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.struct([("cell", pa.int32()), ("cosine", pa.float64())])))], names=[id_, vector, "cells"])

    plain = vectors.select(id_, F.col(vector).cast("array<double>").alias(vector))
    return plain.mapInArrow(run, f"{id_} {kind}, {vector} array<double>, cells array<struct<cell:int,cosine:double>>")


def fitted(vectors: DataFrame, cells: int = 64, sample: int = 50_000, rounds: int = 10) -> np.ndarray:
    """Centroids of length 1, at most ``cells``, fitted on a sample of ``sample`` vectors (vec_id, embedding)."""
    from ..shipping import ship

    ship(vectors.sparkSession)
    key = F.xxhash64(F.col("vec_id"), F.lit("cells"))
    spark, folder = vectors.sparkSession, scratch(vectors.sparkSession, "sample")
    vectors.select("vec_id", "embedding", key.alias("key")).orderBy("key").limit(sample).write.parquet(folder)
    drawn = spark.read.parquet(folder)  # so that the rounds read the sample, not all vectors
    start = [r.embedding for r in drawn.orderBy("key").limit(cells).collect()]
    if not start:
        return np.zeros((0, 1))
    import pandas as pd

    centroids, before = unit(pd.Series(start)), None
    for _ in range(rounds):
        placed = _dealt(drawn, "vec_id", "embedding", centroids, 1).select(F.col("cells")[0]["cell"].alias("cell"), "embedding")
        # one row for each cell and dimension: bounded by the parameters
        length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
        each = placed.select("cell", length.alias("l"), F.posexplode("embedding").alias("at", "x")).where("l > 0")
        sums = each.groupBy("cell", "at").agg(F.sum(F.col("x") / F.col("l")).alias("x"), F.count("*").alias("n")).collect()
        moved, sizes = centroids.copy(), {}
        for r in sums:
            moved[r.cell, r.at] = r.x
            sizes[r.cell] = r.n
        centroids = unit(pd.Series(list(moved)))
        if sizes == before:
            break
        before = sizes
    return centroids


class VectorCells:
    """Vectors (vec_id, embedding) below ``path``, by cell."""

    def __init__(self, spark: SparkSession, path: str):
        from ..shipping import ship

        ship(spark)
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, cells: int = 64, sample: int = 50_000, rounds: int = 10, split: int = ROWS) -> None:
        centroids = fitted(vectors, cells, sample, rounds)
        self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{self.path}/centroids")
        placed = _dealt(vectors, "vec_id", "embedding", centroids, 1).select("vec_id", "embedding", F.col("cells")[0]["cell"].alias("cell"), F.col("cells")[0]["cosine"].alias("cosine"))
        placed.write.parquet(f"{self.path}/placed")
        placed = self.spark.read.parquet(f"{self.path}/placed")
        # a row for each cell
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).withColumn("parts", F.ceil(F.col("n") / split).cast("int"))
        sizes.coalesce(1).write.parquet(f"{self.path}/sizes")
        sizes = self.spark.read.parquet(f"{self.path}/sizes").select("cell", "parts")
        cut = placed.join(F.broadcast(sizes), "cell").select("vec_id", "embedding", "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"))
        cut.repartition("cell", "part").sortWithinPartitions("cell", "part").write.parquet(f"{self.path}/vectors")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def search(self, probes: DataFrame, top: int = 10, near: int = 8, certain: bool = False, rows: int = ROWS) -> DataFrame:
        """(query_id, vec_id, score, rank) of probes (query_id, probe), the probe's own id left out."""
        centroids = self._centroids()
        asked = _dealt(probes, "query_id", "probe", centroids, len(centroids) if certain else near)
        first = asked.select("query_id", "probe", F.explode(F.slice("cells", 1, near)).alias("c")).select("query_id", "probe", "c.cell")
        found = self._looked_up(first, top, rows)
        if not certain:
            return found
        # the k-th best so far; another cell is left out if no vector within its widest angle could be as near
        floor = found.where(F.col("rank") == top).select("query_id", F.col("score").alias("floor"))
        rest = asked.select("query_id", "probe", F.explode(F.slice("cells", near + 1, max(1, len(centroids)))).alias("c")).select("query_id", "probe", "c.cell", "c.cosine")
        wide = F.broadcast(self._table("sizes").select("cell", "least"))  # a row for each cell
        edge = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("cosine")))
        angle = F.acos(edge) - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("least"))))
        bound = F.when(angle <= 0, 1.0).otherwise(F.cos(angle))
        open_ = rest.join(wide, "cell").join(floor, "query_id", "left").where(F.col("floor").isNull() | (bound >= F.col("floor") - _SLACK))
        more = self._looked_up(open_.select("query_id", "probe", "cell"), top, rows)
        return ranked(found.drop("rank").unionByName(more.drop("rank")), top, "vec_id")

    def near_for(self, recall: float, top: int = 10, probes: int = 200) -> int:
        """How many cells a search has to look into to find ``recall`` of the ``top`` nearest.

        Measured against the exact search, on the ``probes`` vectors of least hash: each of their neighbours stands in some
        cell, which is the nearest, second nearest, ... to the probe.
        """
        vectors = self._table("vectors")
        drawn = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe"), F.xxhash64(F.col("vec_id"), F.lit("probes")).alias("key")).orderBy("key").limit(probes).drop("key")
        true = cosine(vectors.select("vec_id", "embedding"), drawn, top).select("query_id", "vec_id")
        centroids = self._centroids()
        ranks = _dealt(drawn, "query_id", "probe", centroids, len(centroids)).select("query_id", F.posexplode("cells").alias("nth", "c")).select("query_id", "nth", "c.cell")
        met = true.join(vectors.select("vec_id", "cell"), "vec_id").join(ranks, ["query_id", "cell"])
        at = sorted(r.nth for r in met.select("nth").collect())  # probes x top rows
        return at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)] + 1 if at else 1

    def _centroids(self) -> np.ndarray:
        stored = sorted((r.cell, r.centroid) for r in self._table("centroids").collect())
        return np.array([c for _, c in stored], np.float64).reshape(len(stored), -1)

    def _looked_up(self, asked: DataFrame, top: int, rows: int) -> DataFrame:
        """The best of (query_id, probe, cell): each part of a cell meets each slice of the probes that ask for it."""
        vectors, sizes = self._table("vectors"), self._table("sizes").select("cell", "parts")
        slices = asked.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("slices"))  # a row for each cell
        each = few(sizes.join(slices, "cell"))
        p = asked.join(each, "cell").select("query_id", "probe", "cell", F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        v = vectors.join(each, "cell").select("vec_id", "embedding", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        return nearest(v, p, ["cell", "part", "slice"], top)
