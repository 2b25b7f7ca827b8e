"""Connected components of a link table, by aggregates and joins alone.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). A
node's neighbours are never collected: each step needs only their least, so a hub of any degree stays spread out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stages


def components(links: DataFrame, stages: Stages) -> DataFrame:
    """(node, comp) of the nodes of ``links`` (a, b): comp is the least node reachable. Nodes without links are left out."""
    edges = stages.write(_canon(links), "edges")
    seen = None
    while True:
        large = stages.write(_large_star(edges), "large")
        small = stages.write(_small_star(large), "small")
        stages.drop(large)
        now = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        stages.drop(edges)
        edges = small
        if seen == (now.n, now.s):
            break
        seen = (now.n, now.s)
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return leaves.union(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _canon(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _canon(edges.select(F.col("b").alias("u"), "a").join(least, "u").select("a", F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of those."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _canon(moved.union(least.select("a", F.col("m").alias("b"))))
