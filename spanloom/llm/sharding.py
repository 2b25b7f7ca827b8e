"""Sharding by size-tiered compaction, with a versioned manifest.

A store is a folder. Each arrival is appended as small shards that are never changed. ``compact`` puts files of like size,
in the same power of two of bytes and below half the target, into tiers; a tier's files, in order of their first shard, are
merged into files of about the target size, one after the other. What they make may fill the next tier: merges are
planned on in the manifest until nothing more comes together, and only then is each row rewritten, once. A file alone in
its tier, or of half the target and more, stays as it is.

Each change writes its data first, then a manifest of the next version, whose folder is renamed into place: that one step
commits, and it fails if another writer has committed the version meanwhile. This needs a file system whose renames are
atomic and fail where the target exists, as HDFS and local disks have; a bare object store needs a committer of its own.
Readers take the highest version and see all of a change or nothing. ``vacuum`` removes files that it no longer names.

The main path is DataFrame functions and Spark's own writer; sizes are bytes of text, and rows are shuffled to their shard
before they are written, so a shard is one file. Rows are stored whole, below one column, so columns may have any names,
and arrivals different ones. The manifest is a table and is planned as one; from it only distinct folders, one for each
change, come to the driver, and files to delete, one at a time. Null texts count no bytes. A text of any length is one row;
a shard that one row makes larger than the target stays alone. Repeated rows are kept; rows of one doc_id share a shard,
rows without one are spread by their text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Stages, bounded, filesystem, plain, remove, remove_at_exit, shared_dir, unused

#: Shards whose sizes are summed together, in order, when files are planned.
SPAN = 4096
_MANIFEST = "folder string, file string, shard long, n_rows long, n_bytes long, file_rows long, file_bytes long, version long"
_NAMES = [c.split()[0] for c in _MANIFEST.split(", ")]


class Store:
    def __init__(self, spark: SparkSession, path: str, target: int = 64 << 20, weight: str = "text"):
        self.spark, self.path, self.target, self.weight = spark, path.rstrip("/"), target, weight
        self.schema: T.StructType | None = None  # of the last arrival
        self.schemas: dict[str, T.StructType] = {}  # by folder, of those written here

    def version(self) -> int:
        """Of the last commit; 0 before the first."""
        fs, where = filesystem(self.spark, f"{self.path}/manifest")
        if not fs.exists(where):
            return 0
        return max((int(s.getPath().getName()[1:]) for s in fs.listStatus(where) if s.getPath().getName().startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """One row for each shard that a version holds, with the file that it is in."""
        at = self.version() if version is None else version
        if not at:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v{at:08d}")

    def _commit(self, rows: DataFrame, base: int) -> int:
        """Makes ``rows`` version base + 1, unless there is one."""
        spare, final = f"{self.path}/manifest/.{uuid.uuid4().hex}", f"{self.path}/manifest/v{base + 1:08d}"
        with plain(self.spark):
            rows.select(*_NAMES).coalesce(8).write.parquet(spare)
        jvm = self.spark.sparkContext._jvm
        source, target = jvm.org.apache.hadoop.fs.Path(spare), jvm.org.apache.hadoop.fs.Path(final)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context.rename(source, target, none)
        return base + 1

    def _write(self, rows: DataFrame, files: int) -> str:
        """``rows`` (row, shard, size, file) as files of a new folder, each written by one task."""
        folder = f"{self.path}/data/change={uuid.uuid4().hex}"
        rows.repartition(max(1, 3 * files), "file").write.option("compression", "zstd").partitionBy("file").parquet(folder)
        self.schemas[folder] = rows.drop("file").schema
        return folder

    def append(self, docs: DataFrame, shard: Column, shards: int = 64, first: int | None = None, columns: list[str] | None = None) -> int:
        """Writes ``docs`` as new shards: ``first`` + ``shard``, by default from the first number that isn't used yet.

        shards: about how many there are; columns: those that are stored, by default all. Numbers of earlier shards can't
        be used again.
        """
        base = self.version()
        before = self.manifest(base)
        top = before.agg(F.max("shard")).first()[0] if base else None
        free = 0 if top is None else top + 1
        first = free if first is None else first
        if first < free:
            raise ValueError(f"shards from {first} on were asked for, but those below {free} are in use")
        stored = [F.col(f"`{c}`") for c in columns or docs.columns]
        self.schema = docs.select(*stored).schema
        size = F.coalesce(F.octet_length(F.col(self.weight).cast("string")), F.lit(0)).cast("long")
        number = (shard + first).cast("long")
        folder = self._write(docs.select(F.struct(*stored).alias("row"), number.alias("shard"), size.alias("size"), F.concat(F.lit("s"), number).alias("file")), shards)
        own = self.spark.read.schema("shard long, size long").parquet(folder).groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))
        new = own.select(F.lit(folder).alias("folder"), F.concat(F.lit("s"), F.col("shard")).alias("file"), "shard", "n_rows", "n_bytes", F.col("n_rows").alias("file_rows"), F.col("n_bytes").alias("file_bytes"), F.lit(base + 1).cast("long").alias("version"))
        version = self._commit(before.unionByName(new), base)
        return version

    def append_each(self, docs: DataFrame, number: Column, per: int, arrivals: int, columns: list[str] | None = None) -> Iterator[int]:
        """Appends ``arrivals`` that came together, one after the other; yields each one's version.

        ``number`` is a row's shard, counted from the first number that isn't used yet; ``per`` shards in a row are one
        arrival. One pass over ``docs`` writes all of them aside, in a folder each. An append moves its arrival's folder to
        the others by a rename and commits it, so that a reader sees whole arrivals, and the store may be compacted between
        two. An arrival without rows is a version without new shards. columns: as in ``append``.
        """
        base = self.version()
        top = self.manifest(base).agg(F.max("shard")).first()[0] if base else None
        first = 0 if top is None else top + 1
        stored = [F.col(f"`{c}`") for c in columns or docs.columns]
        self.schema = docs.select(*stored).schema
        size = F.coalesce(F.octet_length(F.col(self.weight).cast("string")), F.lit(0)).cast("long")
        batch = uuid.uuid4().hex
        aside = f"{self.path}/.arrivals-{batch}"
        change = F.concat(F.lit(f"{batch}-"), F.floor(number / per).cast("string"))
        rows = docs.select(F.struct(*stored).alias("row"), (number + first).cast("long").alias("shard"), size.alias("size"), change.alias("change"), F.concat(F.lit("s"), (number + first).cast("long")).alias("file"))
        rows.repartition(max(1, 3 * per * arrivals), "change", "file").write.option("compression", "zstd").partitionBy("change", "file").parquet(aside)
        schema = rows.drop("change", "file").schema
        own = self.spark.read.schema("shard long, size long, change string").parquet(aside)
        sizes = Stages(self.spark, "arrivals").write(own.groupBy("change", "shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes")), "sizes")
        names = [f"{batch}-{k}" for k in range(arrivals)]
        seen = {r[0] for r in sizes.select("change").distinct().limit(arrivals + 1).collect()}
        if not seen <= set(names):
            raise ValueError(f"a shard's number isn't in 0 to {per * arrivals - 1}")
        for name in names:
            folder = f"{self.path}/data/change={name}"
            if name in seen:
                fs, target = filesystem(self.spark, folder)
                fs.mkdirs(target.getParent())
                if not fs.rename(filesystem(self.spark, f"{aside}/change={name}")[1], target):
                    raise OSError(f"{folder} couldn't be put in place")
                self.schemas[folder] = schema
            base = self.version()
            new = sizes.where(F.col("change") == name).select(F.lit(folder).alias("folder"), F.concat(F.lit("s"), F.col("shard")).alias("file"), "shard", "n_rows", "n_bytes", F.col("n_rows").alias("file_rows"), F.col("n_bytes").alias("file_bytes"), F.lit(base + 1).cast("long").alias("version"))
            yield self._commit(self.manifest(base).unionByName(new), base)
        remove(self.spark, aside)

    def _merges(self, files: DataFrame) -> DataFrame:
        """(first, low) of ``files`` (first, size) that come together: low is the first shard of the file that they make.

        The bytes before a file in its tier are those of earlier spans of shards and of earlier files of its own span.
        """
        small = files.where(F.col("size") * 2 < self.target).withColumn("tier", F.length(F.bin("size"))).withColumn("span", F.floor(F.col("first") / SPAN))
        spans = small.groupBy("tier", "span").agg(F.sum("size").alias("all"))
        earlier = spans.select("tier", "span", (F.sum("all").over(Window.partitionBy("tier").orderBy("span")) - F.col("all")).alias("earlier"))
        near = F.sum("size").over(Window.partitionBy("tier", "span").orderBy("first")) - F.col("size")
        placed = small.withColumn("near", near).join(earlier, ["tier", "span"]).withColumn("group", F.floor((F.col("earlier") + F.col("near")) / self.target))
        low = placed.groupBy("tier", "group").agg(F.min("first").alias("low"), F.count("*").alias("members")).where("members > 1")
        return placed.join(low, ["tier", "group"]).select("first", "low")

    def plan(self, manifest: DataFrame) -> DataFrame:
        """``manifest`` with ``into``: the file that a shard's rows go to, null if they stay."""
        stages = Stages(self.spark, "plan")
        now = manifest.withColumn("was", F.min("shard").over(Window.partitionBy("folder", "file"))).withColumn("first", F.col("was"))
        while True:
            merges = stages.write(self._merges(now.groupBy("first").agg(F.sum("n_bytes").alias("size"))), "merges")
            if merges.isEmpty():
                break
            now = stages.write(now.join(merges, "first", "left").withColumn("first", F.coalesce("low", "first")).drop("low"), "files")
        moved = now.groupBy("first").agg(F.countDistinct("was").alias("members")).where("members > 1").select(F.col("first").alias("f"), F.concat(F.lit("m"), "first").alias("into"))
        return now.join(moved, F.col("first") == F.col("f"), "left").drop("f", "first", "was")

    def compact(self) -> int:
        """Merges files of like size and commits; the version as it was if there is nothing to merge."""
        base = self.version()
        with plain(self.spark):
            planned = Stages(self.spark, "compaction").write(self.plan(self.manifest(base)), "plan")
            moved = planned.where("into is not null")
            sums = moved.groupBy(F.col("into").alias("g")).agg(F.sum("n_rows").alias("r"), F.sum("n_bytes").alias("b"))
            n = sums.count()
        if not n:
            return base
        folder = self._write(self._rows(moved).select("row", "shard", "size", F.col("into").alias("file")), n)
        merged = moved.join(sums, F.col("into") == F.col("g")).select(F.lit(folder).alias("folder"), F.col("into").alias("file"), "shard", "n_rows", "n_bytes", F.col("r").alias("file_rows"), F.col("b").alias("file_bytes"), F.lit(base + 1).cast("long").alias("version"))
        return self._commit(planned.where("into is null").drop("into").unionByName(merged), base)

    def _rows(self, manifest: DataFrame) -> DataFrame:
        """Rows (row, shard, size) of the files in ``manifest``, with its columns file, file_rows, file_bytes and into."""
        tags = ["file_rows", "file_bytes", *(c for c in ("into",) if c in manifest.columns)]
        files = manifest.select(F.col("folder").alias("of"), F.col("file").alias("name"), *tags).distinct()
        alike: list[tuple[T.StructType, list[str]]] = []  # folders by schema
        for folder in sorted(r[0] for r in files.select("of").distinct().collect()):
            if folder not in self.schemas:
                self.schemas[folder] = self.spark.read.parquet(folder).drop("file").schema
            for schema, folders in alike:
                if schema == self.schemas[folder]:
                    folders.append(folder)
                    break
            else:
                alike.append((self.schemas[folder], [folder]))
        files, out = bounded(files), None
        for schema, folders in alike:
            whole = T.StructType([*schema.fields, T.StructField("change", T.StringType()), T.StructField("file", T.StringType())])
            rows = self.spark.read.option("basePath", f"{self.path}/data").schema(whole).parquet(*folders)
            part = rows.join(files, (F.col("file") == F.col("name")) & (F.col("change") == F.regexp_extract("of", "/change=([^/]+)$", 1))).drop("change", "name", "of")
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            kinds = [T.StructField("row", self.schema or T.StructType([])), T.StructField("shard", T.LongType()), T.StructField("size", T.LongType()), T.StructField("file", T.StringType())]
            out = self.spark.createDataFrame([], T.StructType(kinds)).withColumns({c: F.lit(None).cast("string" if c == "into" else "long") for c in tags})
        return out

    def placed(self, version: int | None = None) -> DataFrame:
        """(row, shard, size, file, file_rows, file_bytes) of all rows as of a version; row has their own columns."""
        return self._rows(self.manifest(version))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows as of a version, as they were appended."""
        return self.placed(version).select("row.*")

    def vacuum(self) -> None:
        """Removes files that the last manifest doesn't name; earlier versions can't be read any more."""
        last = self.version()
        live = self.manifest(last).select("folder", "file").distinct()
        folders = {r[0] for r in live.select("folder").distinct().collect()}
        fs, where = filesystem(self.spark, f"{self.path}/data")
        for s in fs.listStatus(where) if fs.exists(where) else []:
            name = f"{self.path}/data/{s.getPath().getName()}"
            if name not in folders:
                remove(self.spark, name)
        for version in range(last - 1, 0, -1):
            old = f"{self.path}/manifest/v{version:08d}"
            if not fs.exists(filesystem(self.spark, old)[1]):
                break
            for r in self.manifest(version).select("folder", "file").distinct().join(live, ["folder", "file"], "left_anti").where(F.col("folder").isin(*folders)).toLocalIterator():
                remove(self.spark, f"{r.folder}/file={r.file}")
            remove(self.spark, old)


def _in_order(docs: DataFrame, size: Column, shards: int, total: int, at: str) -> DataFrame:
    """``docs`` with column ``at``, the shard of each row along the order of rows in their files.

    Files follow each other by part number and name. A row's place among all bytes is that of its file and, within the
    file, as far in as its row number tells: shards are runs of rows, of about the same bytes each.
    """
    path, row = unused(docs.columns, "path", "row_index")
    try:
        marked = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    except AnalysisException:  # no files to be in the order of
        written = Stages(docs.sparkSession, "ordered").write(docs, "docs")
        marked = written.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    part = F.regexp_extract(path, r"part-(\d+)[^/]*$", 1).try_cast("long")
    files = marked.groupBy(F.col(path).alias("p")).agg(F.sum(size).alias("own"), (F.max(row) + 1).alias("rows")).withColumn("part", F.regexp_extract("p", r"part-(\d+)[^/]*$", 1).try_cast("long"))
    before = F.sum("own").over(Window.orderBy(F.asc_nulls_first("part"), "p")) - F.col("own")
    files = Stages(docs.sparkSession, "ordered").write(files.select("p", "own", "rows", before.alias("before")), "files")
    p, own, rows, earlier = unused([*marked.columns], "p", "own", "rows", "before")
    joined = marked.join(bounded(files.toDF(p, own, rows, earlier)), F.col(path) == F.col(p))
    share = (F.col(earlier) + F.col(own) * (F.col(row) / F.col(rows))) * (shards / max(1, total))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.least(F.floor(share), F.lit(shards - 1)).cast("long").alias(at))


def sharded(docs: DataFrame, arrivals: int = 8, small: int = 8 << 20, target: int = 64 << 20, ordered: bool = False) -> DataFrame:
    """``docs`` appended arrival by arrival as small shards, compacted after each half, and read back by the manifest.

    doc_id modulo ``arrivals`` is a row's arrival, which comes in as many shards as it has ``small`` bytes for. With
    ``ordered``, arrivals and shards follow each other along the order of rows in the files of ``docs`` instead: the first
    shards, up to any one, hold what comes first. Returns (doc_id, n_bytes, shard, file, file_rows, file_bytes).
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    total = docs.agg(F.sum(size)).first()[0] or 0
    shards = max(1, total // (arrivals * small))
    store = Store(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", target)
    remove_at_exit(spark, store.path)
    (number,) = unused(docs.columns, "number")
    if ordered:
        marked = _in_order(docs, size, arrivals * shards, total, number)
    else:
        doc = F.col("doc_id").cast("long")
        nameless = F.conv(F.substring(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
        at = F.coalesce(doc, nameless)
        marked = docs.withColumn(number, F.pmod(at, F.lit(arrivals)) * shards + F.pmod(F.floor(at / arrivals), F.lit(shards)))
    for k, _ in enumerate(store.append_each(marked, F.col(number), shards, arrivals, docs.columns)):
        if k in (arrivals // 2 - 1, arrivals - 1):
            store.compact()
            store.vacuum()
    return store.placed().select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("size").alias("n_bytes"), "shard", "file", "file_rows", "file_bytes")


def _rounds(start: str, names: str, target: int, rounds: int = 5) -> tuple[str, str]:
    """DuckDB's account of ``compact``, as common table expressions from ``start`` (shard, n_rows, n_bytes, first) on."""
    out, now = [], start
    for k in range(rounds):
        f, p, q, x = (f"{names}{k}{c}" for c in "fpqx")
        out.append(f"""{f} AS (SELECT first, CAST(sum(n_bytes) AS BIGINT) AS size FROM {now} GROUP BY first),
{p} AS (SELECT first, length(bin(size)) AS tier, CAST(floor((sum(size) OVER (PARTITION BY length(bin(size)) ORDER BY first) - size) / {target}) AS BIGINT) AS g FROM {f} WHERE size * 2 < {target}),
{q} AS (SELECT first, min(first) OVER (PARTITION BY tier, g) AS low FROM {p}),
{x} AS (SELECT shard, n_rows, n_bytes, coalesce(low, t.first) AS first FROM {now} t LEFT JOIN {q} ON t.first = {q}.first)""")
        now = x
    return ",\n".join(out), now


def _sql(arrivals: int = 8, small: int = 8 << 20, target: int = 64 << 20) -> str:
    early, half = _rounds("a", "e", target)
    late, end = _rounds("b", "l", target)
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes FROM documents),
k AS (SELECT greatest(1, CAST(coalesce(sum(n_bytes), 0) AS BIGINT) // ({arrivals} * {small})) AS k FROM d),
s AS (SELECT doc_id, n_bytes, doc_id % {arrivals} * k + (doc_id // {arrivals}) % k AS shard, doc_id % {arrivals} AS arrival FROM d, k),
f AS (SELECT shard, any_value(arrival) AS arrival, count(*) AS n_rows, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM s GROUP BY 1),
a AS (SELECT shard, n_rows, n_bytes, shard AS first FROM f WHERE arrival < {arrivals // 2}),
{early},
b AS (SELECT shard, n_rows, n_bytes, first FROM {half} UNION ALL SELECT shard, n_rows, n_bytes, shard FROM f WHERE arrival >= {arrivals // 2}),
{late},
o AS (SELECT shard, first, count(*) OVER w AS members, sum(n_rows) OVER w AS r, sum(n_bytes) OVER w AS b FROM {end} WINDOW w AS (PARTITION BY first))
SELECT s.doc_id, s.n_bytes, s.shard, CASE WHEN members > 1 THEN 'm' ELSE 's' END || o.first AS file, CAST(o.r AS BIGINT) AS file_rows, CAST(o.b AS BIGINT) AS file_bytes
FROM s JOIN o USING (shard)
"""


#: DuckDB's account of ``sharded``.
SQL = _sql()
