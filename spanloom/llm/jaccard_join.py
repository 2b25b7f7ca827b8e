"""N-gram Jaccard join by prefix filters under several global token orders.

Two texts link when the Jaccard similarity of their shingle sets reaches a threshold. With a threshold t, a set x of n
shingles shares at least ceil(t n) of them with any partner, so under any fixed global order its first
n - ceil(t n) + 1 shingles, its prefix, share one with the partner's prefix (Chaudhuri et al., 2006; several orders:
Rong et al., "Efficient and Scalable Processing of String Similarity Join", 2013). Order 1 is rarest first; orders 2 and
3 put the shingles of a single set first, too, and shuffle the others. Order 1's prefixes are the buckets that make
pairs; the pair's prefixes under orders 2 and 3, 32 bits a shingle, are joined to it next, and only pairs that meet under
every order get their whole sets joined and verified.

1. Shingles are counted over all documents in hash partitions, as packed arrays. A shingle of only one document can't be
   shared, so a document of which less than t of the shingles are found elsewhere has no partner.
2. Equal sets become one class. Only classes go on, and their shingles are counted anew.
3. Each prefix shingle of order 1 is a bucket. In a few rounds each class is matched with one leader, the best of those
   of its buckets; classes that are connected by then need no further comparison. Then all pairs of a bucket that still
   lie in different components are matched, which makes the components exact without all pairs of a group of near copies.

Row counts stay linear in the input besides pairs across components. Shingles are 64-bit hashes (classes: 128 bits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import as_bytes, mix, release, runs, shingle_sets
from .components import components
from .shared import Stages, parts_for, planned_bytes, unused

_SALTS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x8E6C7F1B3D5A9207))
#: Packed rows are held and counted by hash partitions of so many MB of input; a task takes several, one after the other.
PART_MB, TASK_PARTS = 8, 16
_PACK = "part int, batch long, docs binary, keys binary, counts binary, tokens binary"
_SHARES = 32
_COUNTS = "batch long, docs binary, keys binary, sizes binary, hits binary"


def _packed(size: int, parts: int):
    """Documents to packed rows: for each hash partition the low 32 bits of the shingles there, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, 1000):
                doc, key = (np.asarray(piece.column(c)).astype(np.int64) for c in ("doc_id", "th"))
                sets = list(shingle_sets(as_bytes(piece.column("text")), size))
                yield from _rows(doc, key, sets, parts)
        release()

    return run


def _pieces(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _rows(doc: np.ndarray, key: np.ndarray, sets: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    size = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    part = (((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint16 if parts < 65536 else np.uint32)
    order = np.argsort(part, kind="stable")
    part, owner, low = part[order], owner[order], tokens[order].astype(np.uint32)
    name = int(mix(np.uint64(len(doc)) + (doc[:1].view(np.uint64) ^ key[:1].view(np.uint64)))[0].astype(np.int64)) if len(doc) else 0
    out = []
    for a, b in runs(part):
        first = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
        who = owner[a:b][first]
        out.append((int(part[a]), name, doc[who].tobytes(), key[who].tobytes(), np.diff([*first, b - a]).astype(np.uint32).tobytes(), low[a:b].tobytes()))
    # a row without shingles carries the size of each set
    out.append((name % parts, name, doc.tobytes(), key.tobytes(), size.astype(np.uint32).tobytes(), None))
    yield _batch(out, [pa.int32(), pa.int64(), *[pa.binary()] * 4], ["part", "batch", "docs", "keys", "counts", "tokens"])


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def _shared_of(packed: list[tuple]) -> pa.RecordBatch:
    """Packed counts of a partition, by batch of documents: how many of a document's shingles another document has as well."""
    out = [(x[0], x[1], x[2], x[3], None) for x in packed if x[4] is None]
    found = [x for x in packed if x[4] is not None]
    if found:
        count = [np.frombuffer(x[3], np.uint32) for x in found]
        border = np.cumsum([0, *(len(c) for c in count)])
        both = np.concatenate([np.frombuffer(x[4], np.uint32) for x in found]).astype(np.uint64) << np.uint64(32)
        both |= np.repeat(np.arange(border[-1], dtype=np.uint32), np.concatenate(count))
        both.sort()
        token = (both >> np.uint64(32)).astype(np.uint32)
        same = token[1:] == token[:-1]
        twice = np.zeros(len(token), bool)
        twice[1:] = same
        twice[:-1] |= same
        n = np.bincount((both[twice] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=int(border[-1])).astype(np.uint32)
        for x, a, b in zip(found, border, border[1:], strict=False):
            at = np.flatnonzero(n[a:b])
            if len(at):
                out.append((x[0], np.frombuffer(x[1], np.int64)[at].tobytes(), np.frombuffer(x[2], np.int64)[at].tobytes(), None, n[a:b][at].tobytes()))
    return _batch(out, [pa.int64(), *[pa.binary()] * 4], ["batch", "docs", "keys", "sizes", "hits"])


def _summed(packed: list[tuple]) -> pa.RecordBatch:
    """Packed counts of a batch of documents to (doc_id, th, size, hits, times) of each; times: rows that repeat it."""
    whole, found = [x for x in packed if x[2] is not None], [x for x in packed if x[2] is None]
    numbers = lambda rows, k, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x[k], kind) for x in rows)])
    doc, key = numbers(whole + found, 0, np.int64), numbers(whole + found, 1, np.int64)
    order = np.lexsort((key, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (key[order][1:] != key[order][:-1])
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(new) - 1
    n, own = int(new.sum()), numbers(whole, 2, np.uint32)
    size, times = np.zeros(n, np.int64), np.bincount(name[: len(own)], minlength=n)
    size[name[: len(own)]] = own
    hits = np.bincount(name[len(own) :], numbers(found, 3, np.uint32), minlength=n).astype(np.int64) // times  # each repeated row brings its own
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[order][new], key[order][new], size, hits, times)], names=["doc_id", "th", "size", "hits", "times"])


def _by_part(make):
    """Runs ``make`` on the packed rows of each hash partition; the rows come sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for k, part in enumerate(batch.column(0).to_pylist()):
                if part != at and held:
                    yield make(held)
                    held = []
                at = part
                held.append(tuple(c[k].as_py() for c in batch.columns[1:]))
        if held:
            yield make(held)
        release()

    return run


def _class_sets(size: int):
    """(doc_id, th) to its set as packed 64-bit shingles and the set's 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in _pieces(batch, 1000)):
            sets = [s.tobytes() for s in shingle_sets(as_bytes(piece.column("text")), size)]
            digest = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("th"), pa.array(digest, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "th", "set_id", "tokens"])
        release()

    return run


def _packed_classes(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in _pieces(b, 2000)):
            node = np.asarray(batch.column("node")).astype(np.int64)
            sets = [np.frombuffer(x, np.uint64) for x in batch.column("tokens").to_pylist()]
            size = np.array([len(s) for s in sets], np.int64)
            tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
            owner = np.repeat(node, size)
            part = (((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, owner, tokens = part[order], owner[order], tokens[order]
            yield _batch([(int(part[a]), 0, owner[a:b].tobytes(), None, None, tokens[a:b].tobytes()) for a, b in runs(part)], [pa.int32(), pa.int64(), *[pa.binary()] * 4], ["part", "batch", "docs", "keys", "counts", "tokens"])

    return run


def _counted_of(packed: list[tuple]) -> pa.RecordBatch:
    """(node, tokens, counts) of a partition: a class's shingles that other classes have, and in how many classes each is."""
    owner = np.concatenate([np.frombuffer(x[1], np.int64) for x in packed])
    token = np.concatenate([np.frombuffer(x[4], np.uint64) for x in packed])
    _, where, count = np.unique(token, return_inverse=True, return_counts=True)
    count = count[where]
    keep = np.flatnonzero(count > 1)
    keep = keep[np.argsort(owner[keep], kind="stable")]
    owner, token, count = owner[keep], token[keep], count[keep].astype(np.uint32)
    return _batch([(int(owner[a]), token[a:b].tobytes(), count[a:b].tobytes()) for a, b in runs(owner)], [pa.int64(), pa.binary(), pa.binary()], ["node", "tokens", "counts"])


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefixes(percent: int):
    """Classes with the shared shingles of each hash partition to (node, size, hits, typical, tokens, prefix, second, third).

    hits: its shared shingles; typical: in how many classes a shingle of it is on average; prefix, second, third: the
    prefixes under the three orders, without the class's own shingles, which come first in each and meet nobody's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in _pieces(b, 1000)):
            out = []
            for node, size, tokens, counts in zip(*(batch.column(c).to_pylist() for c in ("node", "size", "tokens", "counts")), strict=True):
                token, count = np.frombuffer(b"".join(tokens), np.uint64), np.frombuffer(b"".join(counts), np.uint32)
                if 100 * len(token) < percent * size:
                    continue
                left = prefix_size(size, percent) - (size - len(token))
                first = token[np.lexsort((token, count))[:left]]
                out.append((node, size, len(token), float(count.sum()) / size, np.sort(token).tobytes(), first.astype(np.int64).tolist(), *(shuffled(token, left, salt) for salt in _SALTS)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield _batch(out, kinds, ["node", "size", "hits", "typical", "tokens", "prefix", "second", "third"])

    return run


def shuffled(tokens: np.ndarray, left: int, salt: np.uint64) -> list[int]:
    """The first ``left`` shared shingles under the order of ``salt``, 32 bits of each: equal shingles stay equal."""
    order = mix(tokens ^ salt)
    if left < len(order):
        order = np.partition(order, left)[:left] if left else order[:0]
    return order.astype(np.uint32).view(np.int32).tolist()


def _verified(percent: int):
    """Pairs with the number of shingles that their whole sets share, and whether they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for piece in _pieces(batch, 500):
                for a, b, n, m, x, y in zip(*(piece.column(c).to_pylist() for c in ("a", "b", "n", "m", "x", "y")), strict=True):
                    both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                    out.append((a, b, both, 100 * both >= percent * (n + m - both)))
            yield _batch(out, [pa.int64(), pa.int64(), pa.int64(), pa.bool_()], ["a", "b", "both", "link"])
        release()

    return run


class JaccardJoin:
    """Links texts of which ``percent`` or more of the joint ``size``-word shingles are shared.

    ``classes(docs)`` has a row for each document: (doc_id, th, times, n_shingles, component_id, comp); th is the text's
    hash. Rows that repeat both doc_id and text are one document, times says how many. component_id is the least doc_id of
    the component, null ids aside (null if it has no others); comp is the component's own number, null of a document
    without links. A text without words, an empty text and null are sets without shingles and linked with nothing.
    """

    def __init__(self, size: int = 5, percent: int = 75, star_rounds: int = 2):
        self.size, self.percent, self.star_rounds = size, percent, star_rounds

    def classes(self, docs: DataFrame) -> DataFrame:
        spark, stages = docs.sparkSession, Stages(docs.sparkSession, "jaccard")
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("text").cast("string").alias("text"))
        # a null id gets one of its own below all others, by its text's hash
        named = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 62)) + F.shiftright("th", 8)))
        parts = parts_for(docs, PART_MB)
        tasks = parts_for(docs, PART_MB * TASK_PARTS)
        packed = named.select("doc_id", "th", "text").mapInArrow(_packed(self.size, parts), _PACK)
        found = packed.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_by_part(_shared_of), _COUNTS)
        found = found.repartition(tasks, "batch").sortWithinPartitions("batch").mapInArrow(_by_part(_summed), "doc_id long, th long, size long, hits long, times long")
        sized = stages.write(found.groupBy("doc_id", "th").agg(F.max("size").alias("size"), F.max("hits").alias("hits"), F.sum("times").alias("times")), "sizes")
        likely = sized.where(f"size > 0 and hits * 100 >= size * {self.percent}").select("doc_id", "th")
        chosen = named.join(likely, ["doc_id", "th"], "left_semi")
        sets = stages.write(chosen.mapInArrow(_class_sets(self.size), "doc_id long, th long, set_id binary, tokens binary"), "sets")
        node = F.conv(F.substring(F.hex("set_id"), 1, 15), 16, 10).cast("long").alias("node")
        nodes = sets.groupBy("set_id").agg(F.first("tokens").alias("tokens"))
        nodes = stages.write(nodes.select(node, (F.octet_length("tokens") / 8).cast("long").alias("size"), "tokens"), "nodes")
        members = stages.write(sets.select("doc_id", "th", node).distinct(), "members")
        stages.drop(sets)
        comps = self._components(nodes, stages)
        placed = stages.write(members.join(comps, "node", "left").select("doc_id", "th", F.coalesce("comp", "node").alias("comp")), "placed")
        stages.keep(sized, placed)
        real = F.when(F.col("doc_id") > -(1 << 61), F.col("doc_id"))
        least = placed.groupBy("comp").agg(F.min(real).alias("component_id"), F.count("*").alias("members"))
        linked = placed.join(least, "comp").select("doc_id", "th", "component_id", F.lit(True).alias("linked"), F.when(F.col("members") > 1, F.col("comp")).alias("comp"))
        out = sized.join(linked, ["doc_id", "th"], "left")
        return out.select(real.alias("doc_id"), "th", "times", F.col("size").alias("n_shingles"), F.when(F.col("linked"), F.col("component_id")).otherwise(real).alias("component_id"), "comp")

    def _components(self, nodes: DataFrame, stages: Stages) -> DataFrame:
        spark = nodes.sparkSession
        parts = max(1, planned_bytes(nodes) // (PART_MB << 20))
        packed = nodes.select("node", "tokens").mapInArrow(_packed_classes(parts), _PACK)
        counted = packed.repartition(max(1, -(-parts // TASK_PARTS), min(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))), "part").sortWithinPartitions("part").mapInArrow(_by_part(_counted_of), "node long, tokens binary, counts binary")
        whole = counted.groupBy("node").agg(F.collect_list("tokens").alias("tokens"), F.collect_list("counts").alias("counts"))
        sized = nodes.select("node", "size").join(whole, "node")
        live = stages.write(sized.mapInArrow(_prefixes(self.percent), "node long, size long, hits long, typical double, tokens binary, prefix array<long>, second array<int>, third array<int>"), "live")
        stages.drop(nodes)
        # a shingle's position in order 1 counts the class's own shingles, which come first
        index = stages.write(live.select("node", "size", "hits", "typical", F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos") + F.col("size") - F.col("hits")), "index")
        links = None
        led = spark.createDataFrame([], "node long, lead long, over long")
        comps = index.select("node").distinct().select("node", F.col("node").alias("comp"))
        for k in range(self.star_rounds + 1):
            placed = index.join(comps, "node", "left").select("token", "pos", "node", "size", "hits", "typical", F.coalesce("comp", "node").alias("comp"))
            # the most typical class leads first, any one after that
            rank = F.struct(*([-F.col("typical")] if k == 0 else []), F.xxhash64("node", F.lit(k)).alias("h"), "node", "size", "hits", "comp")
            bucket = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(rank).alias("lead"))
            open_ = bucket.where("lo <> hi").select("token", "lead")
            if k < self.star_rounds:
                met = placed.join(open_, "token").where((F.col("comp") != F.col("lead.comp")) & self._fits("size", "lead.size", "hits", "lead.hits"))
                pairs = met.groupBy(F.col("node").alias("a")).agg(F.min("lead").alias("lead")).select("a", F.col("lead.node").alias("b"))
            else:
                pairs = self._across(placed.join(open_.select("token"), "token", "left_semi").join(led, "node", "left"), stages)
            found = stages.write(self._verify(self._filtered(pairs.distinct(), live), live), "links")
            if k == 0:
                led = found.select(F.col("a").alias("node"), F.col("b").alias("lead"), F.col("both").alias("over"))
            # an empty leader round ends nothing: if no class fits its leader, others of a bucket may link
            new = found.where("link").select("a", "b")
            if not new.isEmpty():
                links = new if links is None else links.union(new)
                comps = stages.write(components(links, stages), "comps")
                links = comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))
        return comps

    def _filtered(self, pairs: DataFrame, live: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b), made by order 1, whose prefixes meet under orders 2 and 3 as well."""
        p = live.select(F.col("node").alias("a"), F.col("second").alias("a2"), F.col("third").alias("a3"))
        q = live.select(F.col("node").alias("b"), F.col("second").alias("b2"), F.col("third").alias("b3"))
        met = pairs.join(p, "a").join(q, "b").where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3"))
        return met.select("a", "b")

    def _fits(self, n: str, m: str, u: str, v: str) -> Column:
        """Whether two sets of sizes n and m, of which u and v shingles are found elsewhere at all, can reach the threshold."""
        n, m, u, v = (F.col(c) for c in (n, m, u, v))
        return (F.least(n, m) * 100 >= F.greatest(n, m) * self.percent) & self._enough(F.least(u, v), n, m)

    def _enough(self, both: Column, n: Column, m: Column) -> Column:
        return both * (100 + self.percent) >= (n + m) * self.percent

    def _across(self, placed: DataFrame, stages: Stages) -> DataFrame:
        """All pairs of a bucket's classes of different components that can link. Large parts of a component never meet.

        At the first shingle that two sets share, neither can share more than what follows it. Of two classes that were
        matched with the same leader, the shared shingles are some of the fewer that one shares with it and some of the
        fewer that one has besides.
        """
        rows = stages.write(placed, "across")
        # rows of a large part are spread by node: the part's few sizes are repeated for each share
        size = rows.groupBy(F.col("token").alias("t"), F.col("comp").alias("c")).agg(F.count("*").alias("members")).where("members > 8")
        size = size.select("t", "c", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1))).alias("s"), F.lit(True).alias("big"))
        shared = rows.withColumn("share", F.pmod(F.xxhash64("node"), F.lit(_SHARES)).cast("int"))
        marked = shared.join(size, (F.col("token") == F.col("t")) & (F.col("comp") == F.col("c")) & (F.col("share") == F.col("s")), "left").select(*rows.columns, F.coalesce("big", F.lit(False)).alias("large"))
        placed = stages.write(marked, "open")  # rows of open buckets alone, which six sides of joins read
        stages.drop(rows)

        def side(c: str, large: bool) -> DataFrame:
            return placed.where(F.col("large") == large).select(*(F.col(x).alias(f"{c}_{x}") for x in ("token", "pos", "comp", "node", "size", "hits", "lead", "over")))

        most = F.least("u_over", "v_over") + F.least(F.col("u_hits") - F.col("u_over"), F.col("v_hits") - F.col("v_over"))
        near = F.coalesce((F.col("u_lead") != F.col("v_lead")) | self._enough(most, F.col("u_size"), F.col("v_size")), F.lit(True))
        unmatched = F.coalesce(F.col("u_lead") != F.col("v_node"), F.lit(True)) & F.coalesce(F.col("v_lead") != F.col("u_node"), F.lit(True))
        follow = self._enough(F.least(F.col("u_size") - F.col("u_pos"), F.col("v_size") - F.col("v_pos")), F.col("u_size"), F.col("v_size"))
        can = self._fits("u_size", "v_size", "u_hits", "v_hits") & follow & near & unmatched & (F.col("u_comp") != F.col("v_comp"))
        same = F.col("u_token") == F.col("v_token")
        small = side("u", False).join(side("v", False), same & (F.col("u_node") < F.col("v_node")) & can)
        mixed = side("u", True).join(side("v", False), same & can)
        parts = placed.where("large").select("token", "comp").distinct()
        p, q = parts.select(F.col("token").alias("p_token"), F.col("comp").alias("pc")), parts.select(F.col("token").alias("q_token"), F.col("comp").alias("qc"))
        over = p.join(q, (F.col("p_token") == F.col("q_token")) & (F.col("pc") < F.col("qc")))
        u = over.join(side("u", True), (F.col("p_token") == F.col("u_token")) & (F.col("pc") == F.col("u_comp")))
        large = u.join(side("v", True), same & (F.col("qc") == F.col("v_comp")) & can)
        pairs = None
        for x in (small, mixed, large):
            x = x.select(F.least("u_node", "v_node").alias("a"), F.greatest("u_node", "v_node").alias("b"))
            pairs = x if pairs is None else pairs.union(x)
        return pairs

    def _verify(self, pairs: DataFrame, live: DataFrame) -> DataFrame:
        a = live.select(F.col("node").alias("a"), F.col("size").alias("n"), F.col("tokens").alias("x"))
        b = live.select(F.col("node").alias("b"), F.col("size").alias("m"), F.col("tokens").alias("y"))
        return pairs.join(a, "a").join(b, "b").mapInArrow(_verified(self.percent), "a long, b long, both long, link boolean")


def op1(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return JaccardJoin().classes(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, join: JaccardJoin | None = None) -> DataFrame:
    """``docs`` without all but one row of each component, with all their columns.

    The document of the least doc_id stays, of equal ids that of the lesser text hash, null ids last. Documents without
    links stay, also such as share their doc_id with another text; of rows that repeat both doc_id and text, the first by
    (lang, source, other sortable columns) stays.
    """
    found = Stages(docs.sparkSession, "kept").write((join or JaccardJoin()).classes(docs.select("doc_id", "text")), "classes")
    first = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "times")
    of_comp = found.where("comp is not null").groupBy("comp").agg(F.min(first).alias("k")).select("k.doc_id", "k.th", "k.times")
    keys = of_comp.unionByName(found.where("comp is null").select("doc_id", "th", "times"))
    row, doc, th, times = unused(docs.columns, "row", "id", "th", "times")
    keys = keys.select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("times").alias(times))
    own = docs.withColumn(row, F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    same = own["doc_id"].cast("long").eqNullSafe(keys[doc]) & (own[row] == keys[th])
    if found.where("times > 1").isEmpty():
        return own.join(keys, same, "left_semi").select(*columns)
    met = own.join(keys, same)
    sortable = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    again = met.where(F.col(times) > 1).withColumn(row, F.row_number().over(Window.partitionBy(doc, th).orderBy(*sortable)))
    return met.where(F.col(times) == 1).select(*columns).unionAll(again.where(F.col(row) == 1).select(*columns))
