"""Word and character edit distance, many cells to a machine word, and aligned edit operations; all as Arrow UDFs.

The table of distances is walked column by column, a column's vertical differences held in two whole numbers of one bit a
cell (Myers, 1999; Hyyrö, 2003), so that a step is a few operations on long integers. A distance keeps one column. Aligned
operations need the way back, from the end: columns are held as far as ``COLUMNS`` goes; of a larger table so many starts are
held, and the columns from the last start on are worked out again in the same manner. A table has as many levels of starts as
it needs, so memory grows with their number only, and counts of operations hold none. Any number of distinct words will do.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound


#: Fixed value: bytes of masks that are held for a pair; those of further items are made each time they are asked for.
MASKS = 64 << 20


class _Masks(dict):
    """The places in the reference of each item of the hypothesis, as bits."""

    def __init__(self, reference: Sequence, hypothesis: Sequence):
        super().__init__(dict.fromkeys(hypothesis, 0))
        self.places = {}
        for i, w in enumerate(reference):
            if w in self:
                self.places.setdefault(w, []).append(i)
        room = MASKS
        for w in sorted(self.places, key=lambda w: -len(self.places[w])):
            room -= self.places[w][-1] // 7 + 100
            if room < 0:
                del self[w]
            else:
                self[w] = self._bits(self.places.pop(w))

    def __missing__(self, w) -> int:
        return self._bits(self.places[w])

    @staticmethod
    def _bits(at: list[int]) -> int:
        if len(at) < 16:
            return sum(1 << i for i in at)
        row = np.zeros(at[-1] + 1, np.uint8)
        row[at] = 1
        return int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")


def _column(up: int, down: int, same: int, all_: int) -> tuple[int, int, int]:
    """The next column's cells that are one more, or one less, than the cell above, and those that equal the one across."""
    across = ((((same & up) + up) ^ up) | same | down) & all_
    more, less = down | (all_ & ~(across | up)), across & up
    more, less = ((more << 1) | 1) & all_, (less << 1) & all_
    return less | (all_ & ~(across | more)), more & across, across


def distance(reference: Sequence, hypothesis: Sequence) -> int:
    """Least number of replaced, deleted and inserted items."""
    a, b = 0, min(len(reference), len(hypothesis))
    while a < b and reference[a] == hypothesis[a]:
        a += 1
    z = 0
    while z < b - a and reference[-1 - z] == hypothesis[-1 - z]:
        z += 1
    r, h = reference[a : len(reference) - z], hypothesis[a : len(hypothesis) - z]
    if not r or not h:
        return len(r) + len(h)
    masks, all_ = _Masks(r, h), (1 << len(r)) - 1
    up, down = all_, 0
    for w in h:
        up, down, _ = _column(up, down, masks[w], all_)
    return len(h) + up.bit_count() - down.bit_count()


#: Fixed value: how many items of finished rows are held as Python objects before they are handed on.
HELD = 50_000


def _each(pairs: Iterator[tuple[pa.Array, pa.Array]], of: Callable, pack: Callable[[list], pa.Array], size: Callable = lambda _: 1) -> Iterator[pa.Array]:
    """``of`` each row, packed in parts; a batch of Spark's has 10,000 rows of any length, and only a row's items become objects."""
    for r, h in pairs:
        out, held = [], 0
        for i in range(len(r)):
            out.append(of(r[i].as_py(), h[i].as_py()))
            held += size(out[-1])
            if held >= HELD:
                yield pack(out)
                out, held = [], 0
        yield pack(out)


def _distances(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    return _each(pairs, lambda a, b: None if a is None or b is None else distance(a, b), lambda out: pa.array(out, pa.int64()))


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Edits between two word arrays, or between two texts by character; null if either is."""
    return F.arrow_udf(_distances, "bigint")(reference, hypothesis)


def rate(edits: Column, reference: Column, hypothesis: Column) -> Column:
    """Edits by reference length, six digits; of an empty reference 0, or 1 if the hypothesis isn't empty."""
    return F.when(reference == 0, F.when(hypothesis == 0, 0.0).otherwise(1.0)).otherwise(F.bround(edits / reference, 6))


#: Fixed value: bytes of columns that a way back holds for each level of starts, whatever the lengths of a pair.
COLUMNS = 32 << 20


def _back(reference: Sequence, hypothesis: Sequence) -> Iterator[tuple[str, int, int]]:
    """(tag, place in the reference, place in the hypothesis) of each step of the way back, the last items first."""
    i, j = len(reference), len(hypothesis)
    while i and j and reference[i - 1] == hypothesis[j - 1]:
        i, j = i - 1, j - 1
        yield "equal", i, j
    masks = _Masks(reference[:i], hypothesis[:j])
    starts = [(0, (1 << i) - 1, 0)]
    while i and j:
        first, up, down = starts.pop()
        all_ = (1 << i) - 1  # the way never comes below row i again
        up, down, room = up & all_, down & all_, max(2, COLUMNS // (i // 4 + 200))
        if j - first > room:
            step = -(-(j - first) // room)
            for k in range(first, j):
                if (k - first) % step == 0:
                    starts.append((k, up, down))
                up, down, _ = _column(up, down, masks[hypothesis[k]], all_)
            continue
        block = []  # of each column: cells that equal the one across, cells that are one more than the one above
        for k in range(first, j):
            up, down, across = _column(up, down, masks[hypothesis[k]], all_)
            block.append((across, up))
        while i and j > first:
            across, more = block[j - 1 - first]
            same = reference[i - 1] == hypothesis[j - 1]
            if same or not across >> (i - 1) & 1:
                i, j = i - 1, j - 1
                yield "equal" if same else "replace", i, j
            elif more >> (i - 1) & 1:
                i -= 1
                yield "delete", i, j
            else:
                j -= 1
                yield "insert", i, j
    while j:
        j -= 1
        yield "insert", i, j
    while i:
        i -= 1
        yield "delete", i, j


def align(reference: Sequence[str], hypothesis: Sequence[str]) -> list[tuple[str, str | None, str | None]]:
    """(tag, reference word, hypothesis word); going back, a diagonal step is preferred to a deletion, that to an insertion."""
    steps = _back(reference, hypothesis)
    return [(tag, None if tag == "insert" else reference[i], None if tag == "delete" else hypothesis[j]) for tag, i, j in steps][::-1]


def _split(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.struct([(t, pa.int64()) for t in ("hits", "substitutions", "deletions", "insertions")])

    def counts(a: Sequence | None, b: Sequence | None) -> dict:
        tags = Counter(tag for tag, _, _ in _back(a or [], b or []))
        return {"hits": tags["equal"], "substitutions": tags["replace"], "deletions": tags["delete"], "insertions": tags["insert"]}

    return _each(pairs, counts, lambda out: pa.array(out, kind))


def edit_counts(reference: Column, hypothesis: Column) -> Column:
    """struct<hits, substitutions, deletions, insertions> of two word arrays, or two texts by character, of any length."""
    return F.arrow_udf(_split, "struct<hits:bigint,substitutions:bigint,deletions:bigint,insertions:bigint>")(reference, hypothesis)


_OPS = "array<struct<tag:string,reference:string,hypothesis:string>>"


def _aligned(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    def pack(rows: list[list[tuple]]) -> pa.Array:
        parts = [pa.array([op[k] for row in rows for op in row], pa.string()) for k in range(3)]
        ends = np.cumsum([0, *map(len, rows)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["tag", "reference", "hypothesis"]))

    return _each(pairs, lambda a, b: align(a or [], b or []), pack, len)


def aligned(reference: Column, hypothesis: Column) -> Column:
    """Edit operations between two word arrays."""
    return F.arrow_udf(_aligned, _OPS)(reference, hypothesis)


def counted(ops: Column, tag: str) -> Column:
    return F.size(F.filter(ops, lambda o: o.tag == tag)).cast("long")


def marked(ops: Column) -> Column:
    """A readable diff: words as they are, {ref|hyp}, [-ref-], [+hyp+]."""
    return F.array_join(F.transform(ops, _mark), " ")


def _mark(o: Column) -> Column:
    return (
        F.when(o.tag == "replace", F.concat(F.lit("{"), o.reference, F.lit("|"), o.hypothesis, F.lit("}")))
        .when(o.tag == "delete", F.concat(F.lit("[-"), o.reference, F.lit("-]")))
        .when(o.tag == "insert", F.concat(F.lit("[+"), o.hypothesis, F.lit("+]")))
        .otherwise(o.reference)
    )


def marked_errors(ops: Column, context: int = 4) -> Column:
    """The diff with ``context`` operations to either side of errors; each longer run of others as one ellipsis."""
    near = lambda all_, k: F.exists(F.slice(all_, F.greatest(k - context, F.lit(0)) + 1, F.least(k, F.lit(context)) + context + 1), lambda o: o.tag != "equal")
    shown = bound(ops, lambda all_: F.transform(all_, lambda o, k: F.when(near(all_, k), _mark(o)).otherwise("…")))
    return F.array_join(bound(shown, lambda s: F.filter(s, lambda x, k: (x != "…") | (k == 0) | (F.get(s, k - 1) != "…"))), " ")
