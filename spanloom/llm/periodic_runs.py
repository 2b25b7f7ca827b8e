"""Periodic runs of words: stretches that repeat with some period, found by heavy/light lag counting.

A run is a stretch of consecutive words with smallest period q, of ``least`` words or more and at least 2 q, that no
neighbouring word extends keeping that period. At lag q it is an island of length - q places i at which words i and i + q
are the same, so a lag needs that many matches to have any run. Matches are counted for all lags at once: the
autocorrelation of a frequent word's places by FFT, whose sums round to whole numbers, and the pairwise differences of a
rare word's places. A word is frequent where its pairs would cost more than a transform. Only lags with enough matches
are scanned for islands.

Lags are taken in ascending order. Every multiple of a found run's period has an island over the same stretch; these
matches are taken off the multiple's count. A run of smallest period q overlaps one whose period is a proper divisor of q
by fewer than q words (or, by Fine and Wilf, would be it), so no two runs explain the same match and none of the matches
of a run yet to be found: the count left is exact, and a text of one repeated word is scanned at lag 1 alone. Islands of
long lags are looked for on a grid of one place in lag / 16 first, of which an island covers 16 neighbours or more.

Each row is one text's work, in a task that streams its rows: no shuffle. A word costs about 100 bytes of the worker. Null
texts and texts without words have no run; null ids are not edited by ``op12``; rows that are repeated, or share an id,
are judged each on its own; further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import as_bytes, release

#: Least words of a run.
LEAST = 12
_PAIRS = 1 << 22  # pairs of places laid out at once
_GRID = 16


def coded(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for the same word."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def lag_matches(codes: np.ndarray) -> np.ndarray:
    """At each lag q up to half the words: at how many places i words i and i + q are the same."""
    n = len(codes)
    half = n // 2
    out = np.zeros(half + 1, np.int64)
    order = np.argsort(codes, kind="stable")
    counts = np.bincount(codes)
    ends = np.cumsum(counts)
    size = 1 << (n + half).bit_length()  # lags up to half don't wrap round
    heavy = np.flatnonzero(counts.astype(float) ** 2 > 4.0 * size * size.bit_length())
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for w in heavy.tolist():
            places = np.zeros(size)
            places[order[ends[w] - counts[w] : ends[w]]] = 1.0
            wave = np.fft.rfft(places)
            power += wave.real**2 + wave.imag**2
        out += np.rint(np.fft.irfft(power, size)[: half + 1]).astype(np.int64)
    light = counts.copy()
    light[heavy] = 0
    group = codes[order]
    later = np.where(light[group] > 0, ends[group] - 1 - np.arange(n), 0)  # places of the same rare word behind each
    upto = np.cumsum(later)
    a = 0
    while a < n:
        base = int(upto[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(upto, base + _PAIRS, "right")))
        each = later[a:b]
        total = int(upto[b - 1]) - base
        if total:
            first = np.repeat(np.arange(a, b), each)
            step = np.arange(total) - np.repeat(upto[a:b] - base - each, each) + 1
            lag = order[first + step] - order[first]
            out += np.bincount(lag[lag <= half], minlength=half + 1)
        a = b
    out[0] = 0
    return out


def _spells(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal spells of True."""
    edge = np.flatnonzero(np.diff(flags.view(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2]


def islands(codes: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """Maximal spells [a, b) of ``least`` places or more at which words i and i + lag are the same; least >= lag."""
    ahead, behind = codes[:-lag], codes[lag:]
    step = lag // _GRID
    if step < 4:
        spans = [(0, len(ahead))]
    else:
        a, b = _spells(ahead[::step] == behind[::step])
        long = b - a >= _GRID - 1
        spans = [(max(0, (x - 1) * step), min(len(ahead), y * step)) for x, y in zip(a[long].tolist(), b[long].tolist(), strict=True)]
    for x, y in spans:
        a, b = _spells(ahead[x:y] == behind[x:y])
        for k in np.flatnonzero(b - a >= least).tolist():
            yield x + int(a[k]), x + int(b[k])


def runs(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by start, then period."""
    n = len(codes)
    if n < max(2, least):
        return []
    left = lag_matches(codes)
    lags = np.arange(len(left))
    need = np.maximum(lags, least - lags)
    found: dict[tuple[int, int], int] = {}
    for q in (np.flatnonzero(left[1:] >= need[1:]) + 1).tolist():
        if left[q] < need[q]:
            continue
        for a, b in islands(codes, q, int(need[q])):
            if (a, b + q) in found:
                continue
            found[a, b + q] = q
            size = b + q - a
            multiples = lags[2 * q : size : q]
            left[multiples] -= size - multiples
    return sorted((a, e - a, q) for (a, e), q in found.items())


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run has behind its first period."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def stretched(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words that ``op12`` judges: those of one id in ten or so repeat from some word on, by a period that the id gives."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digest(doc_id: int | None, words: list[bytes], least: int) -> tuple:
    found = runs(coded(words), least)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
    kept = hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()
    return (doc_id, len(found), *(top or (None, None, None)), top and 1000 * top[1] // top[2], listed, kept)


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with its runs, an array of (start, length, period), and the text without repeats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, kept = [], []
            for text in as_bytes(batch.column("text")):
                words = text.split()
                own = runs(coded(words), least)
                found.append([{"start": s, "length": m, "period": q} for s, m, q in own])
                kept.append(b" ".join(collapsed(words, own)).decode("utf-8", "replace"))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind), pa.array(kept, pa.string())], names=["doc_id", "runs", "collapsed"])
        release()

    return _read(docs).mapInArrow(work, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def op12(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Each row's runs as digests, over the words of ``stretched``; see the catalog."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [_digest(d, stretched(t.split(), d), least) for d, t in zip(ids, as_bytes(batch.column("text")), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        release()

    return _read(docs).mapInArrow(work, _SCHEMA)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
