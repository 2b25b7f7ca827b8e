"""Variants that extend each other, many manifests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from ..sources.scratch import scratch


def _kept(chains: DataFrame, path: str) -> DataFrame:
    chains.write.parquet(path)
    return chains.sparkSession.read.schema(chains.schema).parquet(path)


def _longer(chains: DataFrame) -> DataFrame:
    """Chains (manifest, id, n, path, parent, ended), each that isn't over put together with its parent's."""
    upper = chains.select("manifest", F.col("id").alias("parent"), F.col("path").alias("more"), F.col("parent").alias("next"), F.col("ended").alias("how"))
    met = chains.where("ended is null").join(upper, ["manifest", "parent"], "left")
    # where the parent's chain first comes to a variant that is in this one; neither has one twice
    again = F.array_position(F.transform("more", lambda v: F.array_contains("path", v)), True)
    met = met.withColumn("again", F.when(F.arrays_overlap("path", "more"), again).cast("int"))
    longer = met.select(
        "manifest", "id", "n",
        F.when(F.col("more").isNull(), F.col("path")).when(F.col("again").isNull(), F.concat("path", "more")).otherwise(F.concat("path", F.slice("more", F.lit(1), F.col("again") - 1))).alias("path"),
        F.when(F.col("more").isNull(), F.col("parent")).when(F.col("again").isNull(), F.col("next")).otherwise(F.get("more", F.col("again") - 1)).alias("parent"),
        F.when(F.col("more").isNull(), "unknown").when(F.col("again").isNull(), F.col("how")).otherwise("cycle").alias("ended"),
    )
    return chains.where("ended is not null").unionByName(longer)


def resolved(variants: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """(manifest, id, options, lineage, problem) of variants (manifest, id, extends, options: map<string,string>).

    A variant's options are its own over those of the one that it extends, and so on, over the manifest's ``defaults``
    (manifest, options). Nested options have keys of the form ``backend.options.beam``; a value replaces one of the same key,
    lists included, and one that is a map replaces one that isn't, or is replaced by it. lineage: the variants from it upwards. problem: a cycle or an unknown parent among these, or an id that a
    manifest has twice; the options are then null.

    Chains grow by doubling: in each round a chain that isn't over takes over all that the chain of its last variant's parent
    has, so a chain of n variants takes about log2(n) rounds over a row for each variant, each round written as a table. A
    chain ends where its next variant is in it already.
    """
    spark = variants.sparkSession
    folder = scratch(spark, "chains")
    whole = F.col("manifest").isNotNull() & F.col("id").isNotNull()
    own = variants.where(whole).groupBy("manifest", "id").agg(F.count("*").alias("n"), F.array("id").alias("path"), F.max("extends").alias("parent"))
    ended = F.when(F.col("parent").isNull(), "root")
    chains, rounds = _kept(own.withColumn("ended", ended), f"{folder}/0"), 0
    while not chains.where("ended is null").isEmpty():
        rounds += 1
        chains = _kept(_longer(chains), f"{folder}/{rounds}")
    problem = (
        F.when(F.col("n") > 1, F.concat(F.lit("duplicate id "), "id"))
        .when(F.col("ended") == "unknown", F.concat(F.element_at("path", -1), F.lit(" extends unknown "), "parent"))
        .when(F.col("ended") == "cycle", F.concat(F.lit("cycle at "), "parent"))
    )
    found = chains.select("manifest", "id", F.col("path").alias("lineage"), problem.alias("problem"))
    steps = chains.select("manifest", "id", F.posexplode("path").alias("depth", "at"))
    if defaults is None:
        defaults = spark.createDataFrame([], "manifest string, options map<string,string>")
    each = steps.join(variants.select("manifest", F.col("id").alias("at"), "options"), ["manifest", "at"]).select("manifest", "id", "depth", F.explode("options").alias("key", "value"))
    base = found.select("manifest", "id").join(defaults, "manifest").select("manifest", "id", F.lit(1 << 30).alias("depth"), F.explode("options").alias("key", "value"))
    nearest = each.unionByName(base).groupBy("manifest", "id", "key").agg(F.min(F.struct("depth", "value")).alias("x")).select("manifest", "id", "key", "x.*")
    inside = lambda a, b: a["key"].startswith(F.concat(b["key"], F.lit(".")))
    hidden = lambda all_, e: F.exists(all_, lambda o: (o["depth"] < e["depth"]) & (inside(e, o) | inside(o, e)))
    kept = lambda all_: F.filter(all_, lambda e: ~hidden(all_, e))
    pairs = F.transform(bound(F.array_sort(F.collect_list(F.struct("key", "depth", "value"))), kept), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    merged = nearest.groupBy("manifest", "id").agg(F.map_from_entries(pairs).alias("options"))
    none = F.create_map().cast("map<string,string>")
    out = found.join(merged, ["manifest", "id"], "left")
    return out.select("manifest", "id", F.when(F.col("problem").isNull(), F.coalesce("options", none)).alias("options"), "lineage", "problem")
