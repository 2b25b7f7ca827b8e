"""Vectorized words and hashes over many texts at once.

Texts of a batch are laid out in one byte buffer. A polynomial prefix sum modulo 2**64 gives the hash of any byte
range from two array reads, so words and shingles are hashed without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A fixed pseudo-random 64-bit value per byte.
_VALUE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        ones = np.full((2, size), 1, np.uint64)
        ones[0, 1:], ones[1, 1:] = _BASE, _INVERSE
        _powers[size] = tuple(np.multiply.accumulate(ones, axis=1))
    up, down = _powers[size]
    return up[:n], down[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums before each byte, of len(data) + 1 entries."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * powers(len(data))[0], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about ``most`` bytes; a longer text is a run of its own."""
    a = held = 0
    for b, text in enumerate(texts):
        if held and held + len(text) > most:
            yield a, b
            a, held = b, 0
        held += len(text) + 1
    if a < len(texts):
        yield a, len(texts)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts: ``start``, ``end``, ``hash`` by word; ``first`` has each text's first word."""

    def __init__(self, texts: list[bytes], lower: bool = True, space: np.ndarray = SPACE):
        self.data = data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        if lower:
            self.data = data = LOWER[data]
        gap = space[data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        at = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, at)
        self.sums = prefix_sums(data)
        self.hash = range_hash(self.sums, self.start, self.end)


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Bounds [a, b) of runs of equal neighbours."""
    if not len(x):
        return []
    cut = (np.flatnonzero(x[1:] != x[:-1]) + 1).tolist()
    return list(zip([0, *cut], [*cut, len(x)], strict=True))


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of ``size`` neighbouring word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return hashes[:0]
    out = hashes[:n].copy()
    for k in range(1, size):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + n])
    return out


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles of ``size`` words, as 64-bit hashes; of fewer words, the whole sequence as one."""
    for a, b in chunks(texts):
        words = Words(texts[a:b])
        whole = rolled(words.hash, size)
        first = words.first.tolist()
        for x, y in zip(first, first[1:], strict=False):
            if y - x >= size:
                yield np.unique(whole[x : y - size + 1])
            elif y > x:
                yield rolled(words.hash[x:y], y - x)
            else:
                yield whole[:0]


def release() -> None:
    """Gives memory that a Python worker no longer uses back to its machine, which it shares with the executor's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column's texts as UTF-8; null as empty."""
    import pyarrow as pa

    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]
