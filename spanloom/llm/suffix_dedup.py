"""Suffix-array deduplication: byte strings of ``size`` or more that start at several places, by longest-factor arrays.

In suffix order, the longest factor that a suffix shares with any suffix of an earlier position is shared with its previous
or its next neighbour of smaller position (Crochemore and Ilie, "Computing Longest Previous Factor in linear time", 2008).
With positions turned round the same gives the longest later factor, and both together every place of a string. A corpus has no one suffix array here; suffixes are
dealt out so that all which share ``size`` bytes meet:

1. Equal texts become one, with its number.
2. Of the 32-byte grams that start in each ``size``-byte string the one of least hash is its anchor (winnowing, Schleimer
   et al., 2003). Equal strings have equal anchors at equal offsets; about one position in 85 is one. Anchors that occur
   once are dropped.
3. Around each other anchor its context is cut: all strings of which it is the anchor, which start one after the other.
   Equal contexts become one, with its number and first place. Contexts are dealt by anchor; those of an anchor with more
   than ``MANY`` are cut further, into single strings dealt by digest. Equal ones become one there, too, and do so first
   among the contexts of each task, so that neither a common anchor nor a common string is gathered anywhere.
4. For each other anchor, suffixes of its contexts are sorted and longest previous and next factors found; these alone
   tell which strings repeat. A factor of more than ``size`` bytes covers the starts behind it as well, so only starts that
   no factor covers yet become suffixes, along with those that agree with them in both ends: a hash of these rules out,
   beforehand, strings that can't have an equal.
5. Found ranges go back to the occurrences of their context, and by text to the documents.

Texts, contexts and the single strings of very common anchors are equal if their 128-bit digests are; suffixes are compared
byte by byte, and other hashes only ever rule out or deal out. ``removed(..., keep_first=True)`` removes the later
copies and keeps each string's first place, by (text's least doc_id, text, offset). ``keep_first=False`` removes every
place of a string that starts anywhere else as well.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import as_bytes, chunks, mix, prefix_sums, range_hash, release, runs
from .jaccard_join import _batch, _by_part
from .shared import Stages, parts_for, planned_bytes, tidy

GRAM = 32
#: Bytes at each end of a string that its label is of.
END = 64
_AT = "at struct<z:boolean,low:bigint,key:string,place:bigint>"
_SLICE = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
#: Distinct contexts of one anchor that are sorted together; more are cut into single strings.
MANY = 1200
_BLOCK = 20_000


def _slid_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each run of w neighbours."""
    n = len(v)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    block = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(texts: list[bytes], size: int) -> list[tuple[np.ndarray, ...]]:
    """(offsets, hashes, first, last) of each text's anchors, ascending; first, last: starts of the strings whose anchor it is."""
    pieces = []  # a long text in slices that overlap by all but one byte of a string
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - size + 1), _SLICE):
            pieces.append((k, at, t if len(t) <= _SLICE else t[at : at + _SLICE + size - 1]))
    found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in texts]
    for a, b in chunks([p[2] for p in pieces], 1 << 18):
        part = pieces[a:b]
        data = np.frombuffer(b"".join(p[2] for p in part), np.uint8)
        if len(data) < size:
            continue
        sums = prefix_sums(data)
        at = np.arange(len(data) - GRAM + 1)
        gram = range_hash(sums, at, at + GRAM)
        v = (gram & ~_PLACE) | (at.astype(np.uint64) & _PLACE)
        least = _slid_min(v, size - GRAM + 1)
        first = np.cumsum([0, *(len(p[2]) for p in part)])
        for (k, skip, t), x in zip(part, first, strict=False):
            if len(t) >= size:
                p = (least[x : x + len(t) - size + 1] & _PLACE).astype(np.int64)  # never falls
                a = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1])
                found[k].append((p[a] - x + skip, gram[p[a]], a + skip, np.append(a[1:], len(p)) - 1 + skip))
    out = []
    for f in found:
        if len(f) > 1:
            p, g, a, b = (np.concatenate(c) for c in zip(*f, strict=True))
            at = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1])  # one that two slices share is one
            f = [(p[at], g[at], a[at], b[np.append(at[1:], len(p)) - 1])]
        out.append(f[0] if f else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
    return out


#: Marks an anchor whose other places in its batch of texts are known already, and itself among them.
_KNOWN_HERE = np.uint32(1 << 31)


def _packed_anchors(size: int, parts: int):
    """(key, text) to packed rows: for each hash partition the anchors there, by text.

    An anchor that occurs several times among a batch's texts repeats, so its places need no partition to say so: they go on
    by text, as rows without owners, and one of them alone, marked, goes to the anchor's partition to tell other batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                found = anchors(as_bytes(piece.column("text")), size)
                keys = piece.column("key").to_pylist()
                owner = np.repeat(np.arange(len(keys), dtype=np.int32), [len(f[0]) for f in found])
                place = np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)])
                gram = np.concatenate([np.zeros(0, np.uint64), *(f[1] for f in found)])
                # of the strings that an anchor has, how far before it the first and the last start
                reach = np.concatenate([np.zeros(0, np.int64), *((f[0] - f[2]) << 16 | (f[0] - f[3]) for f in found)]).astype(np.uint32)
                order = np.argsort(gram, kind="stable")
                lead = np.ones(len(gram), bool)
                lead[1:] = gram[order][1:] != gram[order][:-1]
                more = np.zeros(len(gram), bool)
                more[order] = (np.bincount(np.cumsum(lead) - 1)[np.cumsum(lead) - 1] > 1) if len(gram) else False
                rows = []
                for a, b in runs(owner[more]):
                    p, g, r = place[more][a:b], gram[more][a:b], reach[more][a:b]
                    key = keys[owner[more][a]]
                    rows.append((int.from_bytes(key[:6], "little") % parts, key, None, p.tobytes(), g.tobytes(), r.tobytes()))
                one = order[lead]
                owner, place, gram, reach = owner[one], place[one], gram[one], np.where(more[one], reach[one] | _KNOWN_HERE, reach[one])
                part = (((gram >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint32)
                order = np.argsort(part, kind="stable")
                part, owner, place, gram, reach = part[order], owner[order], place[order], gram[order], reach[order]
                for a, b in runs(part):
                    who, index = np.unique(owner[a:b], return_inverse=True)
                    rows.append((int(part[a]), b"".join(keys[k] for k in who), index.astype(np.uint16).tobytes(), place[a:b].tobytes(), gram[a:b].tobytes(), reach[a:b].tobytes()))
                yield _batch(rows, [pa.int32(), *[pa.binary()] * 5], ["part", "keys", "owners", "places", "grams", "reaches"])
        release()

    return run


def _repeated(packed: list[tuple]) -> pa.RecordBatch:
    """(key, places, grams, reaches) of the anchors of a partition that occur more than once, by text."""
    out = [(x[0], x[2], x[3], x[4]) for x in packed if x[1] is None]
    packed = [x for x in packed if x[1] is not None]
    if packed:
        keys = np.concatenate([np.frombuffer(x[0], "V16") for x in packed])
        skip = np.cumsum([0, *(len(x[0]) // 16 for x in packed)])
        owner = np.concatenate([np.frombuffer(x[1], np.uint16).astype(np.int64) + s for x, s in zip(packed, skip, strict=False)])
        place, gram, reach = (np.concatenate([np.frombuffer(x[k], kind) for x in packed]) for k, kind in ((2, np.int64), (3, np.uint64), (4, np.uint32)))
        order = np.argsort(gram)
        same = gram[order][1:] == gram[order][:-1]
        twice = np.zeros(len(gram), bool)
        twice[1:] = same
        twice[:-1] |= same
        keep = order[twice]
        keep = np.sort(keep[reach[keep] & _KNOWN_HERE == 0])
        keep = keep[np.argsort(owner[keep], kind="stable")]
        owner, place, gram, reach = owner[keep], place[keep], gram[keep], reach[keep]
        out += [(keys[owner[a]].tobytes(), place[a:b].tobytes(), gram[a:b].tobytes(), reach[a:b].tobytes()) for a, b in runs(owner)]
    return _batch(out, [pa.binary()] * 4, ["key", "places", "grams", "reaches"])


def _contexts(size: int):
    """Texts with their repeated anchors to (context, anchor, left, length, place, key, low): one row for each anchor."""
    kinds, names = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64()], ["context", "anchor", "left", "length", "place", "key", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                piece = batch.slice(at, 500)
                for text, key, low, *packed in zip(as_bytes(piece.column("text")), *(piece.column(c).to_pylist() for c in ("key", "low", "places", "grams", "reaches")), strict=True):
                    p, g, r = (np.frombuffer(b"".join(x), k) for x, k in zip(packed, (np.int64, np.int64, np.uint32), strict=True))
                    for k in range(0, len(p), _BLOCK):  # a long text has many
                        for x, h, reach in zip(*(v[k : k + _BLOCK].tolist() for v in (p, g, r)), strict=True):
                            left = reach >> 16
                            body = text[x - left : x - (reach & 0xFFFF) + size]
                            out.append((hashlib.blake2b(body + left.to_bytes(2, "little"), digest_size=16).digest(), h, left, len(body), x, key, low))
                        if len(out) >= _BLOCK:
                            yield _batch(out, kinds, names)
                            out = []
                yield _batch(out, kinds, names)
        release()

    return run


#: Rows to search, all in one shuffle: contexts by anchor; strings of very common anchors by digest; what is known already.
_CONTEXT, _STRINGS, _KNOWN = 0, 1, 2
_ROWS = f"kind int, deal long, context binary, left int, body binary, n long, {_AT}, more binary"


def _place(at: dict) -> bytes:
    """A context's first place as bytes that sort like it."""
    return bytes([at["z"]]) + (at["low"] + (1 << 63)).to_bytes(8, "big") + bytes.fromhex(at["key"]) + at["place"].to_bytes(8, "big")


def _bodies(size: int, parts: int):
    """Texts with the contexts to cut from them to rows to search.

    Contexts of very common anchors are taken some thousand at a time. Strings that are in several of these are known to
    repeat; for all others of their kind, elsewhere, the one of the first context goes on, with its digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), at, pa.binary()]
            return _batch(rows, kinds, ["kind", "deal", "context", "left", "body", "n", "at", "more"])

        for batch in batches:
            at = batch.schema.field("wanted").type.value_type.field("at").type
            for piece in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                out = []
                for text, wanted in zip(as_bytes(piece.column("text")), piece.column("wanted").to_pylist(), strict=True):
                    for w in wanted:
                        start = w["at"]["place"] - w["left"]
                        row = (w["context"], w["left"], text[start : start + w["length"]], w["n"], w["at"])
                        if w["common"]:
                            held.append(row)
                        else:
                            out.append((_CONTEXT, w["anchor"], *row, None))
                    if len(out) >= _BLOCK:
                        yield made(out)
                        out = []
                yield made(out)
                if len(held) >= _BLOCK // 4:
                    yield made(_singles(held, size, parts))
                    held = []
        if held:
            yield made(_singles(held, size, parts))
        release()

    return run


_SINGLE = np.dtype([("context", "S16"), ("x", "<i4"), ("string", "<u8", 2), ("place", "S33"), ("again", "?")])


def _singles(rows: list[tuple], size: int, parts: int) -> list[tuple]:
    """Contexts to what is known of their strings, and one of each string for the search, packed by its digest."""
    rank = np.empty(len(rows), np.int64)
    places = [_place(r[4]) for r in rows]
    rank[sorted(range(len(rows)), key=places.__getitem__)] = np.arange(len(rows))
    span = [(max(0, left - (size - GRAM)), min(left, len(body) - size)) for _, left, body, *_ in rows]
    ctx = np.repeat(np.arange(len(rows)), [hi - lo + 1 for lo, hi in span])
    x = np.concatenate([np.arange(lo, hi + 1) for lo, hi in span])
    digest = b"".join(hashlib.blake2b(body[k : k + size], digest_size=16).digest() for (_, _, body, *_), (lo, hi) in zip(rows, span, strict=True) for k in range(lo, hi + 1))
    string = np.frombuffer(digest, "<u8").reshape(-1, 2)
    order = np.lexsort((rank[ctx], string[:, 1], string[:, 0]))
    lead = np.ones(len(order), bool)
    lead[1:] = (string[order][1:] != string[order][:-1]).any(1)
    kind = np.cumsum(lead) - 1
    times = np.bincount(kind, np.array([r[3] for r in rows])[ctx[order]])  # occurrences of each string
    later, again = np.empty(len(order), bool), np.empty(len(order), bool)
    later[order], again[order] = ~lead, times[kind] > 1
    known = []
    for r, a, b in zip(rows, *(_ranges(f, ctx, x, len(rows), size) for f in (again, later)), strict=True):
        if a or b:
            # the context's name spreads these rows
            known.append((_KNOWN, int.from_bytes(r[0][:7], "little"), r[0], r[1], None, None, None, pickle.dumps((a, b))))
    one = order[lead]
    packed = np.empty(len(one), _SINGLE)
    packed["context"], packed["place"] = np.array([r[0] for r in rows], "S16")[ctx[one]], np.array(places, "S33")[ctx[one]]
    packed["x"], packed["string"], packed["again"] = x[one] - np.array([r[1] for r in rows])[ctx[one]], string[one], again[one]
    part = string[one, 0] % np.uint64(parts)
    by = np.argsort(part, kind="stable")
    return known + [(_STRINGS, int(part[by[a]]), None, None, None, None, None, packed[by[a:b]].tobytes()) for a, b in runs(part[by])]


def _again(packed: list[bytes], size: int) -> list[tuple]:
    """(context, ranges anywhere, ranges before) of single strings of one part that others have as well."""
    rows = np.concatenate([np.frombuffer(p, _SINGLE) for p in packed])
    rows = rows[np.lexsort((rows["place"], rows["string"][:, 1], rows["string"][:, 0]))]
    same = (rows["string"][1:] == rows["string"][:-1]).all(1)
    later = np.concatenate([[False], same])
    anywhere = later | np.append(same, False)
    hit = rows[anywhere]
    out = []
    for r, b in zip(hit, later[anywhere].tolist(), strict=True):
        run = [(int(r["x"]), int(r["x"]) + size)]
        out.append((r["context"].ljust(16, b"\0"), run, run if b else []))
    return out


def longest_factors(order: np.ndarray, lcp: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each suffix, the longest factor it shares with any suffix of smaller rank.

    order: suffixes in suffix order; lcp[i]: common prefix of order[i - 1] and order[i]; rank: positions by suffix. The
    longer of those that it shares with its previous and its next suffix of smaller rank.
    """
    best, r = np.zeros(len(order), np.int64), rank[order]
    if len(order):
        back = _shared_with_smaller(r[::-1], np.concatenate([[0], lcp[:0:-1]]))[::-1]
        best[order] = np.maximum(_shared_with_smaller(r, lcp), back)
    return best


def _shared_with_smaller(rank: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of each place the common prefix with the nearest place before it of smaller rank; common[0] is 0.

    All places go back at once by falling powers of two, as far as only larger ranks lie between. Tables have the least
    rank and the least common prefix of the last 1, 2, 4, ... places. Beyond a common prefix of 0 nothing is looked for.
    """
    n = len(rank)
    border = np.flatnonzero(common == 0)
    levels = int(np.diff(np.append(border, n)).max()).bit_length()
    least, least_common = [rank], [common]
    for k in range(levels):
        step = 1 << k
        for table in (least, least_common):
            longer = table[-1].copy()
            longer[step:] = np.minimum(table[-1][step:], table[-1][:-step]) if step < n else longer[step:]
            table.append(longer)
    at, shared = np.arange(n), np.full(n, np.iinfo(np.int64).max)
    for k in range(levels, -1, -1):
        step = 1 << k
        go = np.flatnonzero(at >= step)
        go = go[least[k][at[go] - 1] > rank[go]]
        shared[go] = np.minimum(shared[go], least_common[k][at[go]])
        at[go] -= step
    return np.where(at > 0, np.minimum(shared, common[at]), 0)


def _sorted_suffixes(data: np.ndarray, group: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order within groups, and common prefixes of neighbours (0 between groups); all bytes are compared."""
    width = -(-int(length.max()) // 8) * 8
    m = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(width, np.uint8)]), width)[start]
    m[np.arange(width) >= length[:, None]] = 0
    words = m.view(">u8").astype(np.uint64)
    order, rank = np.argsort(group, kind="stable"), np.unique(group, return_inverse=True)[1]
    for k in range(words.shape[1]):
        # by eight more bytes, those alone that are equal so far
        head = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
        tied = ~head | ~np.append(head[1:], True)
        open_ = order[tied]
        if not len(open_):
            break
        open_ = open_[np.lexsort((words[open_, k], rank[open_]))]
        new = np.concatenate([[True], (rank[open_][1:] != rank[open_][:-1]) | (words[open_, k][1:] != words[open_, k][:-1])])
        order[tied] = open_
        place = np.flatnonzero(tied)
        rank[open_] = place[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        rank[order[~tied]] = np.flatnonzero(~tied)
    if len(order) < 2:
        return order, np.zeros(len(order), np.int64)
    diff = words[order[1:]] != words[order[:-1]]
    first = np.where(diff.any(1), diff.argmax(1), -1)
    lcp = np.full(len(first), width)
    apart = np.flatnonzero(first >= 0)
    at = first[apart, None] * 8 + np.arange(8)
    lcp[apart] = first[apart] * 8 + (m[order[1:][apart, None], at] != m[order[:-1][apart, None], at]).argmax(1)
    short = np.minimum(length[order][1:], length[order][:-1])
    lcp = np.where(group[order][1:] == group[order][:-1], np.minimum(lcp, short), 0)
    return order, np.concatenate([[0], lcp])


def _strings(groups: np.ndarray, bodies: list[bytes], lefts: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(context, start within it, label) of the strings that hold their context's anchor.

    label: a hash of the anchor, its place in the string and the string's first and last ``END`` bytes. It can rule out
    that a string is equal to another, no more.
    """
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(bodies), 1000):
        part, left = bodies[a : a + 1000], lefts[a : a + 1000]
        length = np.array([len(b) for b in part], np.int64)
        offset = np.cumsum([0, *length])[:-1]
        lo = np.maximum(0, left - (size - GRAM))
        n = np.maximum(np.minimum(left, length - size) - lo + 1, 0)
        ctx = np.repeat(np.arange(len(part)), n)
        at = np.arange(len(ctx)) - np.repeat(np.cumsum(n) - n, n) + lo[ctx]
        start = offset[ctx] + at
        sums = prefix_sums(np.frombuffer(b"".join(part), np.uint8))
        ctx += a
        place = (groups[ctx] * 1024 + at - lefts[ctx] + 512).astype(np.uint64)
        ends = range_hash(sums, start, start + END) ^ mix(range_hash(sums, start + size - END, start + size))
        out.append((ctx, at, ends ^ mix(place)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def covered(groups: np.ndarray, bodies: list[bytes], lefts: np.ndarray, counts: np.ndarray, ranks: np.ndarray, size: int, keep_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, anywhere, before) of strings: whether each starts elsewhere; with ``keep_first``, or earlier.

    A context that counts several occurrences repeats as a whole. Of all others the longest factors tell which strings
    repeat, and how far: strings of one label become suffixes together, some labels at a time.
    """
    ctx, at, label = _strings(groups, bodies, lefts, size)
    anywhere, before = counts[ctx] > 1, np.zeros(len(ctx), bool)
    order = np.argsort(label)
    same = label[order][1:] == label[order][:-1]
    kind = np.empty(len(ctx), np.int64)
    kind[order] = np.concatenate([[0], np.cumsum(~same)])[: len(ctx)]
    live = np.zeros(len(ctx), bool)  # not ruled out, and not known yet
    live[order[1:]] = same
    live[order[:-1]] |= same
    need = before if keep_first else anywhere
    live &= ~need
    data = np.frombuffer(b"".join(bodies), np.uint8)
    length = np.array([len(b) for b in bodies], np.int64)
    offset = np.cumsum([0, *length])[:-1]
    last = np.searchsorted(ctx, ctx, side="right") - 1
    for heads in (True, False):
        # at first the first open string of each run, with all of its label; then those that no factor covers
        some = live.copy()
        if heads:
            some[1:] &= ~(live[:-1] & (ctx[1:] == ctx[:-1]))
        wanted = np.zeros(len(ctx) + 1, bool)
        wanted[kind[some]] = True
        cand = np.flatnonzero(wanted[kind])
        cand = cand[np.argsort(kind[cand], kind="stable")]
        border = np.flatnonzero(np.concatenate([[True], kind[cand][1:] != kind[cand][:-1], [True]])) if len(cand) else np.zeros(1, np.int64)
        x = 0
        while x < len(border) - 1:
            y = max(x + 1, int(np.searchsorted(border, border[x] + 20_000, side="right")) - 1)
            some = cand[border[x] : border[y]]
            rest = length[ctx[some]] - at[some]
            s_order, lcp = _sorted_suffixes(data, kind[some], offset[ctx[some]] + at[some], rest)
            rank = ranks[ctx[some]]
            reach = longest_factors(s_order, lcp, rank)
            if not keep_first:
                reach = np.maximum(reach, longest_factors(s_order, lcp, -rank))  # positions turned round: later places
            hit = np.flatnonzero(reach >= size)
            # a factor of size + k covers the k starts behind it, too
            span = np.minimum(reach[hit] - size, last[some[hit]] - some[hit])
            edge = np.bincount(some[hit], minlength=len(ctx) + 1) - np.bincount(some[hit] + span + 1, minlength=len(ctx) + 1)
            need |= np.cumsum(edge[:-1]) > 0
            x = y
        live[cand] = False
        live &= ~need
    return ctx, at, anywhere, before


def _ranges(flag: np.ndarray, ctx: np.ndarray, at: np.ndarray, n: int, size: int) -> list[list[tuple[int, int]]]:
    """Runs of flagged strings of each of n contexts, as byte ranges."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    keep = np.flatnonzero(flag)
    c, p = ctx[keep], at[keep]
    gap = np.concatenate([[True], (c[1:] != c[:-1]) | (p[1:] != p[:-1] + 1)]) if len(c) else np.zeros(0, bool)
    first = np.flatnonzero(gap)
    for x, y in zip(first.tolist(), [*(first[1:] - 1).tolist(), len(c) - 1], strict=False):
        out[int(c[x])].append((int(p[x]), int(p[y]) + size))
    return out


def _found(size: int, keep_first: bool):
    """Rows to search, sorted by kind and deal, to (context, starts, ends, first_starts, first_ends), from the anchor."""
    kinds, columns = [pa.binary(), *[pa.list_(pa.int32())] * 4], ["context", "starts", "ends", "first_starts", "first_ends"]

    def make(rows: list[tuple]) -> pa.RecordBatch:
        name = {x: k for k, x in enumerate(dict.fromkeys(r[1] for r in rows))}
        groups = np.array([name[r[1]] for r in rows], np.int64)
        lefts, counts = (np.array([r[k] for r in rows], np.int64) for k in (2, 4))
        ranks = np.arange(len(rows))  # any order will do if all places go
        if keep_first:
            ranks[sorted(range(len(rows)), key=lambda k: tuple(rows[k][5].values()))] = np.arange(len(rows))
        bodies = [r[3] for r in rows]
        ctx, at, anywhere, before = covered(groups, bodies, lefts, counts, ranks, size, keep_first)
        out = []
        for r, x, y in zip(rows, *(_ranges(f, ctx, at, len(rows), size) for f in (anywhere, before)), strict=True):
            if x or y or keep_first:
                out.append((r[0], *([v[k] - r[2] for v in z] for z in (x, y) for k in (0, 1))))
        return _batch(out, kinds, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = ["kind", "deal", "context", "left", "body", "n", *(["at"] if keep_first else []), "more"]
        for piece in (batch.slice(k, 500) for batch in batches for k in range(0, batch.num_rows, 500)):
            for kind, deal, context, *row, more in zip(*(piece.column(c).to_pylist() for c in names), strict=True):
                if held and (kind != held[0][0] or deal != held[-1][1] and (kind == _STRINGS or len(held) >= MANY)):
                    yield from made(held)
                    held = []
                held.append((kind, deal, context, *row, more))
        yield from made(held)
        release()

    def made(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if held and held[0][0] == _CONTEXT:
            yield make([(r[2], r[1], *r[3:-1]) for r in held])
        elif held and held[0][0] == _STRINGS:
            found = _again([r[-1] for r in held], size)
            yield _batch([(c, *([v[k] for v in z] for z in (x, y) for k in (0, 1))) for c, x, y in found], kinds, columns)
        elif held:
            found = [(r[2], r[3], *pickle.loads(r[-1])) for r in held]
            yield _batch([(c, *([v[k] - left for v in z] for z in (x, y) for k in (0, 1))) for c, left, x, y in found], kinds, columns)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with ranges to remove to (key, n_bytes, n_removed, n_spans, kept_sha256, kept)."""
    for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
        out = []
        for text, key, whole, starts, ends in zip(as_bytes(batch.column("text")), *(batch.column(c).to_pylist() for c in ("key", "whole", "starts", "ends")), strict=True):
            spans: list[list[int]] = [[0, len(text)]] if whole else []
            for a, b in sorted(zip([x for s in starts or [] for x in s], [x for s in ends or [] for x in s], strict=True)) if not whole else []:
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            edge = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)) if spans else text
            out.append((key, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [x for s in spans for x in s]))
        yield _batch(out, [pa.binary(), *[pa.int64()] * 3, pa.string(), pa.list_(pa.int64())], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    release()


def removed(docs: DataFrame, size: int = 200, keep_first: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row of ``docs``.

    Texts are UTF-8 bytes, null as empty; matches never cross documents; the input decides, not what is left of it. spans:
    from, to, from, to of the maximal removed runs. Null and repeated doc_ids are rows like others.
    """
    with tidy(docs.sparkSession):
        return _removed(docs, size, keep_first)


def _removed(docs: DataFrame, size: int, keep_first: bool) -> DataFrame:
    stages = Stages(docs.sparkSession, "suffixes")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    texts = stages.write(docs.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("n"), F.min("doc_id").alias("low")), "texts", large=True)
    long = texts.where(f"octet_length(text) >= {size}")
    parts = parts_for(texts, 16)
    packed = long.select("key", "text").mapInArrow(_packed_anchors(size, parts), "part int, keys binary, owners binary, places binary, grams binary, reaches binary")
    repeated = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_by_part(_repeated), "key binary, places binary, grams binary, reaches binary")
    marked = repeated.groupBy("key").agg(F.collect_list("places").alias("places"), F.collect_list("grams").alias("grams"), F.collect_list("reaches").alias("reaches"))
    cut = stages.write(long.select("key", "text", "low").join(marked, "key").mapInArrow(_contexts(size), "context binary, anchor long, left int, length int, place long, key binary, low long"), "contexts", large=True)
    place = F.struct(F.col("low").isNull().alias("z"), F.coalesce("low", F.lit(0)).alias("low"), F.hex("key").alias("key"), "place")
    distinct = stages.write(cut.groupBy("context", "anchor", "left", "length").agg(F.count("*").alias("n"), F.min(place).alias("at")), "distinct", large=True)
    many = stages.write(distinct.groupBy("anchor").agg(F.count("*").alias("m"), F.max("n").alias("top")).where("m > 1 or top > 1"), "many")
    grouped = distinct.join(many, "anchor")
    lo, hi = F.greatest(-F.col("left"), F.lit(GRAM - size)), F.least(F.lit(0), F.col("length") - F.col("left") - size) + size
    none = F.array().cast("array<int>")
    # a context that no other one shares its anchor with repeats as a whole
    alone = grouped.where("m = 1").select("context", F.array(lo).alias("starts"), F.array(hi).alias("ends"), none.alias("first_starts"), none.alias("first_ends"))
    wanted = grouped.where("m > 1").groupBy(F.unhex("at.key").alias("key")).agg(F.collect_list(F.struct("context", "anchor", (F.col("m") > MANY).alias("common"), "left", "length", "n", "at")).alias("wanted"))
    spread = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), planned_bytes(cut) >> 20)
    rows = long.select("key", "text").join(wanted, "key").mapInArrow(_bodies(size, spread), _ROWS)
    searched = rows.repartition(spread, "kind", "deal").sortWithinPartitions("kind", "deal").mapInArrow(_found(size, keep_first), "context binary, starts array<int>, ends array<int>, first_starts array<int>, first_ends array<int>")
    ranges = stages.write(searched.unionByName(alone), "ranges", large=True)
    del searched, alone, rows, wanted, grouped, many, repeated, marked, packed
    if not keep_first:
        stages.drop(distinct)
    places = cut.select("context", "key", "place", "left", "length").join(ranges, "context")
    if keep_first:
        one = distinct.select("context", F.unhex("at.key").alias("k"), F.col("at.place").alias("p"))
        places = places.join(one, "context").withColumn("lead", (F.col("key") == F.col("k")) & (F.col("place") == F.col("p")))
        starts = F.when(F.col("lead"), F.col("first_starts")).otherwise(F.array(lo))
        ends = F.when(F.col("lead"), F.col("first_ends")).otherwise(F.array(hi))
    else:
        starts, ends = F.col("starts"), F.col("ends")
    found = places.select("key", F.transform(starts, lambda x: x + F.col("place")).alias("starts"), F.transform(ends, lambda x: x + F.col("place")).alias("ends")).groupBy("key").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    by_text = stages.write(found, "places", large=True)
    whole = (F.col("n") > 1) & (F.octet_length("text") >= size) if not keep_first else F.lit(False)
    sized = stages.write(texts.withColumn("whole", whole).join(by_text, "key", "left").select("key", "text", "whole", "starts", "ends").mapInArrow(_cut, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"), "sized")
    stages.keep(texts, sized) if keep_first else stages.keep(sized)
    rows = docs.select("doc_id", "key")
    if keep_first:
        # of equal texts the first keeps what the search left, the others lose every string of the size
        w = texts.select("key", F.col("low").alias("least"))
        rows = rows.join(w, "key").groupBy("doc_id", "key", "least").agg(F.count("*").alias("c"))
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("c").cast("int")))).withColumn("later", ~(F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("copy") == 1)) & F.lit(True))
        out = rows.join(sized, "key").withColumn("gone", F.col("later") & (F.col("n_bytes") >= size))
        return out.select("doc_id", "n_bytes", F.when(F.col("gone"), F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(F.col("gone"), F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"), F.when(F.col("gone"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"), F.when(F.col("gone"), F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(F.col("spans")).alias("spans"))
    return rows.join(sized, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
