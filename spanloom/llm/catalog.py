"""The queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contextual_pii, cotraining, decontamination, fingerprints, importance, jaccard_join, periodic_runs, pfair, sharding, suffix_dedup, token_counts, toxicity, url_lists


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a Jaccard similarity of 0.75 over 5-word shingles; each document's set size and component."""
    return jaccard_join.op1(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight arrivals of 8 MB shards, compacted to 64 MB files; each document's shard and file, read through the manifest."""
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds 0.75 of the 5-word shingles."""
    found = decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and its edited text, with likenesses to that and to the next document."""
    return fingerprints.against_next(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page judged by the list entries active on its fetch day."""
    return url_lists.op5(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's token count and best score under the 32,000 scored pieces of the default model file."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), *token_counts.read_model())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity; learned from labels of documents that aren't held out."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text without the bytes of 200-byte strings that start anywhere else as well."""
    return suffix_dedup.removed(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality by both views and together, and whether it is kept."""
    return cotraining.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's block of 16 of its source, the block's window, and its slot in the mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(0).alias("row"))
    return pfair.schedule(docs, pfair.by_number(F.col("source"))).drop("row")


def op11_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each text, by form and by the contexts that known instances share."""
    return contextual_pii.op11(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's periodic runs of 12 words or more, the longest of them, and the text without their repeats."""
    return periodic_runs.op12(table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark's words."""
    return importance.op13(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_jaccard_join, op2_sharding, op3_decontamination, op4_fingerprints, op5_url_filters, op6_token_counts, op7_toxicity, op8_suffix_dedup, op9_quality, op10_mixing, op11_contextual_pii, op12_periodic_runs, op13_importance)}

ORACLES: dict[str, str] = {"op11_contextual_pii": contextual_pii.SQL, "op2_sharding": sharding.SQL, "op3_decontamination": decontamination.SQL, "op5_url_filters": url_lists.SQL, "op10_mixing": pfair.SQL, "op13_importance": importance.SQL}
