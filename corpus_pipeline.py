"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Part of the subpackage ``spanloom.llm``. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet in the shared folder and reads it again as the next one's docs. All stages but the last return the columns of
``docs``, whatever further ones there are and whatever their names. Null texts count as empty, null ids, sources and
languages as values of their own; documents without words are judged by their metadata and by having none, are nobody's
near copies, contain nothing, and stay. An empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import cotraining, decontamination, jaccard_join, pfair, sharding
from spanloom.llm.shared import Stages


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject; all of them where there are no labels of both classes."""
    return cotraining.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join, that of the least doc_id; of repeated rows one."""
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files whose rows follow the Pfair schedule of their sources."""
    return pfair.mixed(docs, pfair.by_number(F.col("source")))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and file in a compacted store of all documents.

    Shards are cut along the order of rows in the files of ``docs``, which is the mix: the first shards, up to any one, hold
    each source to within a block of its target weight, until a source has run out.
    """
    return sharding.sharded(docs, ordered=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The classifier can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = stages.write(stage(spark, docs, sf_dir), name)
        stages.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
