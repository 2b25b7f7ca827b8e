"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line with its line end; a section ends at a blank line or, so that an insertion moves no later border,
where a paragraph's digest says so. Digests go upward: paragraph bytes, sections over paragraphs, the root over
sections. Equal roots mean equal texts; where roots differ, ``differences`` descends into the differing branches only.

The tree's leaves, below paragraphs, are 32-bit hashes of content-defined runs of a few words. ``likeness`` is the share of
leaves that two trees have in common, found from the root down: all leaves below equal roots; else those below sections
paired with equal ones; else, within the sections left over, those below equal paragraphs; and only of paragraphs left over
are leaves compared themselves. Repeated branches count as often as both trees have them.

A fingerprint is ``root.sections.paragraphs.runs``: 32 hex digits; in base64 each section's digest and number of
paragraphs, each paragraph's digest and number of runs, and the runs. Null counts as the empty text; of two different texts
without words the likeness is 0. A text of any length is one tree in one task's memory, its lines and runs as lists.
"""

from __future__ import annotations

import base64
import difflib
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Words, chunks, range_hash
from .shared import parts_for

_LEAST = -(1 << 63)


@dataclass
class Tree:
    root: bytes
    sections: list[bytes]
    paragraphs: list[list[bytes]]  # by section
    counts: list[list[int]]  # of each paragraph's runs
    runs: np.ndarray
    spans: list[list[tuple[int, int]]] = field(default_factory=list, repr=False)  # bytes of each paragraph

    @property
    def text(self) -> str:
        heads = b"".join(d + len(p).to_bytes(4, "little") for d, p in zip(self.sections, self.paragraphs, strict=True))
        below = b"".join(d + n.to_bytes(4, "little") for p, c in zip(self.paragraphs, self.counts, strict=True) for d, n in zip(p, c, strict=True))
        return ".".join([self.root.hex(), *(base64.b64encode(x).decode() for x in (heads, below, self.runs.tobytes()))])

    @classmethod
    def of(cls, fingerprint: str) -> Tree:
        """A tree as its fingerprint has it, without spans."""
        root, *rest = fingerprint.split(".")
        heads, below, runs = (base64.b64decode(x) for x in rest)
        pairs = lambda data: [(data[k : k + 8], int.from_bytes(data[k + 8 : k + 12], "little")) for k in range(0, len(data), 12)]
        own, sections, paragraphs, counts = iter(pairs(below)), [], [], []
        for digest, n in pairs(heads):
            part = [next(own) for _ in range(n)]
            sections.append(digest)
            paragraphs.append([d for d, _ in part])
            counts.append([c for _, c in part])
        return cls(bytes.fromhex(root), sections, paragraphs, counts, np.frombuffer(runs, np.uint32))


def _digest(data: bytes, size: int = 8) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def _runs(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's runs, and the number of the paragraph that each is in."""
    words = Words(texts, lower=False)
    n = len(words.start)
    lines = np.cumsum(words.data == 10)
    fresh = np.zeros(n, bool)
    fresh[1:] = ((words.hash[:-1] & np.uint64(3)) == 0) | (lines[words.start[1:]] != lines[words.start[:-1]])
    fresh[words.first[:-1][words.first[:-1] < n]] = True
    at = np.flatnonzero(fresh)
    hashes = range_hash(words.sums, words.start[at], words.end[np.append(at[1:], n) - 1]).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
    line, cut = lines[words.start[at]], np.searchsorted(at, words.first)
    base = lines[np.cumsum([0, *(len(t) + 1 for t in texts)])]  # line ends before each text
    return [(hashes[a:b], line[a:b] - base[k]) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]


def trees(texts: list[bytes]) -> list[Tree]:
    out = []
    for a, b in chunks(texts):
        for text, (runs, line) in zip(texts[a:b], _runs(texts[a:b]), strict=True):
            lines = text.splitlines(keepends=True) if b"\r" not in text else _lines(text)
            each = np.bincount(line, minlength=len(lines)).tolist()
            sections, paragraphs, counts, spans, first, at, place = [], [], [], [], 0, 0, []
            own: list[bytes] = []
            for k, x in enumerate(lines, 1):
                d = _digest(x)
                own.append(d)
                place.append((at, at := at + len(x)))
                if not d[0] & 7 or k == len(lines) or not x.strip():
                    sections.append(_digest(b"".join(own)))
                    paragraphs.append(own)
                    counts.append(each[first:k])
                    spans.append(place)
                    own, place, first = [], [], k
            out.append(Tree(_digest(b"".join(sections), 16), sections, paragraphs, counts, runs, spans))
    return out


def _lines(text: bytes) -> list[bytes]:
    parts = text.split(b"\n")
    return [x + b"\n" for x in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def tree(text: str | None) -> Tree:
    return trees([(text or "").encode()])[0]


def differences(x: Tree, y: Tree) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Byte spans of x and y that differ, found from the root down; equal sections and paragraphs aren't entered."""
    if x.root == y.root:
        return []
    out = []

    def reach(spans: list[tuple[int, int]], at: int, to: int, end: int) -> tuple[int, int]:
        return (spans[at][0], spans[to - 1][1]) if to > at else (spans[at][0] if at < len(spans) else end,) * 2

    for tag, a, b, c, d in difflib.SequenceMatcher(None, x.sections, y.sections, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        p, q = ([h for s in t.paragraphs[i:j] for h in s] for t, i, j in ((x, a, b), (y, c, d)))
        before = [[s for k in t.spans[:i] for s in k] for t, i in ((x, a), (y, c))]
        u, v = ([s for k in t.spans[i:j] for s in k] for t, i, j in ((x, a, b), (y, c, d)))
        ends = [s[-1][1] if s else (w[-1][1] if w else 0) for s, w in zip((u, v), before, strict=True)]
        for kind, i, j, k, m in difflib.SequenceMatcher(None, p, q, autojunk=False).get_opcodes():
            if kind != "equal":
                out.append((reach(u, i, j, ends[0]), reach(v, k, m, ends[1])))
    return out


def _left(x: list, y: list) -> tuple[list[int], list[int]]:
    """Places of x and of y that are left over when equal items are paired off."""
    out = []
    for one, other in ((x, y), (y, x)):
        free = Counter(other)
        places = []
        for k, item in enumerate(one):
            if free[item] > 0:
                free[item] -= 1
            else:
                places.append(k)
        out.append(places)
    return tuple(out)


def _leaves(t: Tree, sections: list[int]) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Digests of the paragraphs of some sections, and where their runs are."""
    digests, where = [], []
    begin = np.cumsum([0, *(sum(c) for c in t.counts)]).tolist()
    for k in sections:
        at = begin[k]
        for d, n in zip(t.paragraphs[k], t.counts[k], strict=True):
            digests.append(d)
            where.append((at, at := at + n))
    return digests, where


def likeness_of(x: Tree, y: Tree) -> float:
    """The share of leaves in common, from the root down; 1 of equal trees."""
    if x.root == y.root:
        return 1.0
    total = len(x.runs) + len(y.runs)
    if not total:
        return 0.0
    (p, p_at), (q, q_at) = (_leaves(t, k) for t, k in zip((x, y), _left(x.sections, y.sections), strict=True))
    rest = [np.concatenate([np.zeros(0, np.uint32), *(t.runs[slice(*at[k])] for k in left)]).tolist() for t, at, left in zip((x, y), (p_at, q_at), _left(p, q), strict=True)]
    apart = sum(map(len, _left(*rest)))
    return (total - apart) / total


def likeness(x: str, y: str) -> float:
    """Of two fingerprints, from 0 to 1; 1 of equal ones."""
    return likeness_of(Tree.of(x), Tree.of(y))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = trees([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.text for t in made], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _dealt(cuts: list[int], also: dict[int, list[int]]):
    """Rows to their bucket of ids; a bucket's first document, in descending order, goes to the bucket before as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.array(cuts, np.int64)
        for batch in batches:
            at = np.asarray(batch.column("at")).astype(np.int64)
            bucket = np.searchsorted(edge, at, side="right").astype(np.int32)
            more = [(k, b) for k, x in enumerate(at.tolist()) for b in also.get(x, ())]
            take = np.concatenate([np.arange(len(at)), np.array([k for k, _ in more], np.int64)]).astype(np.int64)
            column = [np.concatenate([bucket, np.array([b for _, b in more], np.int32)]).astype(np.int32), None]
            column[1] = np.concatenate([np.zeros(len(at), bool), np.ones(len(more), bool)])
            rows = pa.table([batch.column(c) for c in ("doc_id", "at", "text")], names=["doc_id", "at", "text"]).take(pa.array(take))
            rows = rows.append_column("bucket", pa.array(column[0])).append_column("guest", pa.array(column[1]))
            yield from rows.to_batches()

    return run


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to the result: each document against its edited text and the next row of its bucket."""
    held: list[tuple] = []
    for batch in batches:
        rows = held + list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")), strict=True))
        for at in range(0, len(rows) - 1, 1000):
            part = rows[at : at + 1001]
            own = trees([(r[3] or "").encode() for r in part])
            pairs = [k for k in range(len(part) - 1) if not part[k][1] and part[k][0] == part[k + 1][0]]
            edited = []
            for k in pairs:
                text, after = part[k][3] or "", part[k + 1][3] or ""
                cut = len(text) // 3
                edited.append((text[: len(text) - cut] + after[:cut]).encode())
            after = trees(edited)
            out = []
            for k, e, t in zip(pairs, edited, after, strict=True):
                mine, other = own[k], own[k + 1]
                out.append((part[k][2], len(part[k][3] or ""), hashlib.sha256(e).hexdigest(), mine.text, t.text, likeness_of(mine, t), likeness_of(mine, other)))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _RESULT.split(", ")])
        held = rows[-1:]


def against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses to that and to the next document.

    Next goes by descending doc_id (null last; equal ids by text), and from the last to the first. The last third of the
    code points is replaced by the next text's first as many. Texts are shuffled once, by ranges of ids whose borders are
    quantiles; only a border and a first id for each range of 128 MB come to the driver. Rows of one id, and those without
    any, are one range, which a task streams through in batches. Equal rows are each other's next; a row alone is its own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("at"), F.col("text").cast("string").alias("text"))
    parts = parts_for(docs, 128)
    cuts = sorted({int(x) for x in docs.where("doc_id is not null").approxQuantile("at", [k / parts for k in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    firsts = docs.select("at").mapInArrow(_firsts(cuts), "bucket int, at long").groupBy("bucket").agg(F.max("at").alias("at")).orderBy(F.desc("bucket")).collect()
    also: dict[int, list[int]] = {}
    for k, row in enumerate(firsts):
        before = firsts[k - 1] if k else firsts[-1]
        also.setdefault(row["at"], []).append(before["bucket"])
    dealt = docs.mapInArrow(_dealt(cuts, also), "doc_id long, at long, text string, bucket int, guest boolean")
    ordered = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc("at"), F.asc_nulls_first("text"))
    return ordered.mapInArrow(_neighbours, _RESULT)


def _firsts(cuts: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge, best = np.array(cuts, np.int64), {}
        for batch in batches:
            at = np.asarray(batch.column("at")).astype(np.int64)
            for b, x in zip(np.searchsorted(edge, at, side="right").tolist(), at.tolist(), strict=True):
                if b not in best or best[b] < x:
                    best[b] = x
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], names=["bucket", "at"])

    return run
