"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a vector of its own and the mean of those of its byte 3- and 4-grams, the word's ends marked, from hashed
tables; the first number of each is the log-odds of toxic among texts that have it, and the highest one of a word's grams
enters as well. A recurrent layer (GRU) reads a window of words in both directions, attention weighs the states, and a
logistic unit scores their sum. A text is read in windows of ``WINDOW`` words every ``STEP`` words, so that all words are
read and neighbouring windows overlap; its score is that of its highest window. Training follows the highest window of each
training text. Half of the training texts give the log-odds, the other half train the network, which so never sees odds
that come from a text's own label; other numbers of the tables are learned only for words and grams of eight texts or more.

Words are runs of letters and digits (any byte from 0x80 counts as a letter), lower-cased in A-Z; a word that repeats at once
counts once. Texts without words, and null, have one window without words; its score is what remains of the unit, its
constant.

``train`` sees at most ``Fit.rows`` texts of each label, and as many of them as have ``Fit.megabytes`` together (the first
one in any case), in the order of a hash of the id: whole texts, from the labelled rows that aren't held out. The scores of
all documents use the text alone, of any length. Null ids are scored and never learned from, as are labels given both ways;
of rows that repeat an id one is learned from; without labels of both classes the score is a constant.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import Words, as_bytes, chunks, mix

WINDOW, STEP = 24, 18
WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 15
WORD_DIM, CHAR_DIM, HIDDEN = 4, 4, 8
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Fit:
    rows: int = 1200
    megabytes: float = 32.0
    epochs: int = 6
    batch: int = 32
    rate: float = 0.01
    seed: int = 7


class Text:
    """Windows over some texts: ``words`` (distinct), ``index`` (window, place) into them with -1 for none, ``owner``."""

    def __init__(self, texts: list[bytes]):
        words = Words(texts, lower=True, space=_BREAK)
        self.data = words.data
        fresh = np.ones(len(words.hash), bool)
        fresh[1:] = words.hash[1:] != words.hash[:-1]
        fresh[words.first[:-1][words.first[:-1] < len(fresh)]] = True
        starts = np.concatenate([[0], np.cumsum(fresh)])[words.first]
        self.hash, first, index = np.unique(words.hash[fresh], return_index=True, return_inverse=True)
        self.start, self.end = words.start[fresh][first], words.end[fresh][first]
        n = np.diff(starts)
        count = np.maximum(1, -(-(n - WINDOW) // STEP) + 1)
        self.owner = np.repeat(np.arange(len(texts)), count)
        self.count = count
        at = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STEP
        spots = at[:, None] + np.arange(WINDOW)
        inside = spots < n[self.owner][:, None]
        source = np.minimum(starts[self.owner][:, None] + spots, max(0, len(index) - 1))
        self.index = np.where(inside, index[source] if len(index) else -1, -1)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, row) of the byte grams of each distinct word."""
        size = (self.end - self.start) + 2  # with the marks of both ends
        owner = np.repeat(np.arange(len(size)), size)
        spot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        inner = (spot > 0) & (spot < size[owner] - 1)
        char = np.where(inner, self.data[np.minimum(self.start[owner] + spot - 1, len(self.data) - 1)], np.where(spot == 0, 1, 2)).astype(np.uint64)
        out = []
        for k in (3, 4):
            code = char[: len(char) - k + 1].copy()
            for j in range(1, k):
                code = code * np.uint64(257) + char[j : len(char) - k + 1 + j]
            whole = owner[: len(code)] == owner[k - 1 :]
            out.append((owner[: len(code)][whole], mix(code[whole] + np.uint64(k << 40))))
        return np.concatenate([x for x, _ in out]), (np.concatenate([x for _, x in out]) % np.uint64(CHAR_ROWS)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _start(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM + 1, HIDDEN
    p = {"word": r.normal(0, 0.1, (WORD_ROWS, WORD_DIM)), "char": r.normal(0, 0.1, (CHAR_ROWS, CHAR_DIM))}
    for s in "fb":
        p |= {f"x{s}": r.normal(0, d**-0.5, (d, 3 * h)), f"u{s}": r.normal(0, h**-0.5, (h, 3 * h)), f"c{s}": np.zeros(3 * h)}
    p |= {"a": r.normal(0, 0.3, (2 * h, h)), "v": r.normal(0, 0.3, h), "o": r.normal(0, 0.3, 2 * h), "k": np.array([-2.0])}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _vectors(p: dict, text: Text) -> tuple[np.ndarray, tuple]:
    row = (text.hash % np.uint64(WORD_ROWS)).astype(np.int64)
    owner, gram = text.grams()
    order = np.argsort(owner, kind="stable")
    owner, gram = owner[order], gram[order]
    n = np.bincount(owner, minlength=len(row))
    mean, top = np.zeros((len(row), CHAR_DIM), np.float32), np.zeros((len(row), 1), np.float32)
    has = np.flatnonzero(n)
    if len(has):
        own, at = p["char"][gram], (np.cumsum(n) - n)[has]
        mean[has] = np.add.reduceat(own, at) / n[has, None]
        top[has, 0] = np.maximum.reduceat(own[:, 0], at)
    return np.concatenate([p["word"][row], mean, top], axis=1), (row, owner, gram, np.maximum(n, 1).astype(np.float32))


def _direction(p: dict, s: str, gates: np.ndarray, index: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (place, window, HIDDEN) of one direction; gates: each distinct word's input to the three gates."""
    h, u = HIDDEN, p[f"u{s}"]
    state = np.zeros((len(index), h), np.float32)
    out, tape = np.zeros((WINDOW, len(index), h), np.float32), []
    for t in range(WINDOW) if s == "f" else range(WINDOW - 1, -1, -1):
        word = index[:, t]
        there = (word >= 0).astype(np.float32)[:, None]
        g = gates[word]
        zr = _sigmoid(g[:, : 2 * h] + state @ u[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        rs = r * state
        new = np.tanh(g[:, 2 * h :] + rs @ u[:, 2 * h :])
        if keep:
            tape.append((t, word, there, z, r, rs, new, state))
        state = state + there * (1 - z) * (new - state)
        out[t] = state
    return out, tape


def _forward(p: dict, text: Text, index: np.ndarray, vectors: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Log-odds of windows."""
    if not len(vectors):
        return np.full(len(index), p["k"][0], np.float32), ()
    parts = [_direction(p, s, vectors @ p[f"x{s}"] + p[f"c{s}"], index, keep) for s in "fb"]
    states = np.concatenate([x[0] for x in parts], axis=2)
    hidden = np.tanh(states @ p["a"])
    weight = np.exp(np.minimum(hidden @ p["v"], 20)) * (index.T >= 0)
    total = weight.sum(0) + 1e-9
    share = weight / total
    pooled = np.einsum("tw,twh->wh", share, states)
    return pooled @ p["o"] + p["k"][0], (parts, states, hidden, share, pooled)


def _backward(p: dict, text: Text, index: np.ndarray, vectors: np.ndarray, made: tuple, lookup: tuple, slope: np.ndarray, grad: dict) -> None:
    """Adds to ``grad`` for ``slope``, the loss by each window's log-odds."""
    parts, states, hidden, share, pooled = made
    row, owner, gram, n = lookup
    h = HIDDEN
    grad["o"] += pooled.T @ slope
    grad["k"] += slope.sum()
    d_pooled = slope[:, None] * p["o"]
    d_states = share[:, :, None] * d_pooled
    d_share = np.einsum("twh,wh->tw", states, d_pooled)
    d_logit = share * (d_share - (share * d_share).sum(0))
    grad["v"] += np.einsum("twh,tw->h", hidden, d_logit)
    d_hidden = d_logit[:, :, None] * p["v"] * (1 - hidden**2)
    grad["a"] += np.einsum("twi,twj->ij", states, d_hidden)
    d_states = d_states + d_hidden @ p["a"].T
    d_vectors = np.zeros_like(vectors)
    for s, (_, tape), at in (("f", parts[0], 0), ("b", parts[1], h)):
        u = p[f"u{s}"]
        d_gates = np.zeros((len(vectors), 3 * h), np.float32)
        carry = np.zeros((len(index), h), np.float32)
        for t, word, there, z, r, rs, new, before in reversed(tape):
            d = carry + d_states[t][:, at : at + h]
            dh = d * there
            d_new = dh * (1 - z) * (1 - new**2)
            d_z = dh * (before - new) * z * (1 - z)
            d_rs = d_new @ u[:, 2 * h :].T
            d_r = d_rs * before * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], axis=1)
            grad[f"u{s}"][:, : 2 * h] += before.T @ d_zr
            grad[f"u{s}"][:, 2 * h :] += rs.T @ d_new
            carry = d * (1 - there) + dh * z + d_rs * r + d_zr @ u[:, : 2 * h].T
            np.add.at(d_gates, word[there[:, 0] > 0], np.concatenate([d_zr, d_new], axis=1)[there[:, 0] > 0])
        grad[f"x{s}"] += vectors.T @ d_gates
        grad[f"c{s}"] += d_gates.sum(0)
        d_vectors += d_gates @ p[f"x{s}"].T
    np.add.at(grad["word"], row, d_vectors[:, :WORD_DIM])
    np.add.at(grad["char"], gram, (d_vectors[:, WORD_DIM : WORD_DIM + CHAR_DIM] / n[:, None])[owner])


def train(texts: list[bytes], labels: np.ndarray, fit: Fit = Fit()) -> dict[str, np.ndarray]:
    """The network's parameters. With labels of one class only, the constant alone is set."""
    p = _start(fit.seed)
    if not len(labels) or labels.min() == labels.max():
        p["o"][:] = 0
        p["k"][:] = 4.0 if len(labels) and labels[0] else -4.0
        return p
    half = np.arange(len(texts)) % 2 == 0
    if labels[half].min() == labels[half].max() or labels[~half].min() == labels[~half].max():
        half = np.ones(len(texts), bool)  # too few for halves
    seen = {"word": np.zeros((2, WORD_ROWS)), "char": np.zeros((2, CHAR_ROWS))}
    known = {"word": np.zeros(WORD_ROWS), "char": np.zeros(CHAR_ROWS)}
    for t, label, counts in zip(texts, labels.tolist(), half.tolist(), strict=True):
        text = Text([t])
        for k, rows in (("word", np.unique((text.hash % np.uint64(WORD_ROWS)).astype(np.int64))), ("char", np.unique(text.grams()[1]))):
            known[k][rows] += 1
            seen[k][label, rows] += counts
    total = np.bincount(labels[half], minlength=2)[:, None] + 1.0
    learned = {}
    for k, c in seen.items():
        odds = np.log((c[1] + 0.5) / total[1]) - np.log((c[0] + 0.5) / total[0])
        p[k][:, 0] = np.clip(odds, -3, 3) * (c.sum(0) / (c.sum(0) + 4))
        learned[k] = np.broadcast_to((known[k] >= 8)[:, None], p[k].shape).astype(np.float32).copy()
        learned[k][:, 0] = 0
        p[k][:, 1:] *= learned[k][:, 1:]
    kept = np.flatnonzero(~half) if not half.all() else np.arange(len(texts))
    texts, labels = [texts[k] for k in kept], labels[kept]
    r = np.random.default_rng(fit.seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0
    balance = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    for epoch in range(fit.epochs):
        order = r.permutation(len(texts))
        for at in range(0, len(order), fit.batch):
            chosen = order[at : at + fit.batch]
            text = Text([texts[k] for k in chosen])
            vectors, lookup = _vectors(p, text)
            if not len(vectors):
                continue
            logit, _ = _forward(p, text, text.index, vectors)
            lead = np.cumsum(text.count) - text.count
            top = np.array([x + int(np.argmax(logit[x : x + c])) for x, c in zip(lead, text.count, strict=True)])
            index = text.index[top]
            z, made = _forward(p, text, index, vectors, keep=True)
            slope = ((_sigmoid(z) - labels[chosen]) * balance[chosen] / len(chosen)).astype(np.float32)
            grad = {k: np.zeros_like(x) for k, x in p.items()}
            _backward(p, text, index, vectors, made, lookup, slope, grad)
            step += 1
            rate = fit.rate * (0.3 if epoch >= fit.epochs - 2 else 1.0)
            for k, g in grad.items():
                g = g * learned[k] if k in learned else g + 1e-4 * p[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return p


def scores(p: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """A score from 0 to 1 for each text: that of its highest window."""
    out = np.empty(len(texts))
    for a, b in chunks(texts, 1 << 21):
        text = Text(texts[a:b])
        vectors, _ = _vectors(p, text)
        logit = np.concatenate([_forward(p, text, text.index[k : k + 4096], vectors)[0] for k in range(0, len(text.index), 4096)])
        out[a:b] = np.maximum.reduceat(logit, np.cumsum(text.count) - text.count)
    return _sigmoid(np.clip(out, -30, 30))


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def fitted(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> dict[str, np.ndarray]:
    """Trained on ``labels`` (doc_id, toxic) of rows that aren't held out; rows labelled both ways are left out."""
    clean = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = clean.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("hi")).where("toxic = hi")
    own = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.col("text").cast("string")).alias("size"))
    have = own.join(known, "doc_id").groupBy("doc_id").agg(F.max("size").cast("long").alias("size"), F.min("toxic").alias("toxic")).withColumn("rank", F.xxhash64("doc_id"))
    chosen = have.where("toxic = 1").orderBy("rank", "doc_id").limit(fit.rows).union(have.where("toxic = 0").orderBy("rank", "doc_id").limit(fit.rows))
    before = F.sum("size").over(Window.partitionBy("toxic").orderBy("rank", "doc_id")) - F.col("size")
    chosen = chosen.withColumn("before", before).where((F.col("before") == 0) | (F.col("before") + F.col("size") <= int(fit.megabytes * (1 << 20)))).drop("before", "size")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("rank", "toxic", "text").toPandas().sort_values("rank")
    return train([t.encode() for t in rows["text"]], rows["toxic"].to_numpy().astype(np.int64), fit)


def scored(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; predicted is 1 where the score is 0.7 or more."""
    p = fitted(docs, labels, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(p, as_bytes(batch.column("text"))) if batch.num_rows else np.zeros(0)
            held = [held_out(x) for x in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= 0.7).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
