"""Quality classifier by co-training (Blum and Mitchell, "Combining Labeled and Unlabeled Data with Co-Training", 1998).

Two logistic regressions see different views: the text's content, and the metadata of its page (language, source,
length). Both start from the labelled rows. In each round each view labels all unlabelled documents of which it is
confident, and the other one learns from these pseudo-labels as well: together they weigh half as much as the labelled rows
at most, one by one half as much. At the end each view is calibrated on labelled rows that it hasn't learned from, and all
documents are scored by the sum of the calibrated log-odds, each weighted by how much its view tells there (0 if nothing).

Fitting sees at most ``Fit.labelled`` labelled rows, chosen by a hash of the id, and every unlabelled row. Features are
worked out once and written. A document's metadata is one of at most 12,288 codes, so what the text view says of all
documents comes to the metadata view as counts by code; what the metadata view says is a table by code, with which each
Newton step of the text view sums its slope and curvature over all unlabelled rows. Only counts by code and those sums
come to the driver, and the features of the labelled sample.

Rows with a null id, or labelled both ways, aren't learned from; repeated rows are rows like others. Null or empty text has
its own feature, null metadata a category of its own, and texts of any length are read whole. Without labels of both classes
every document scores 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Words, as_bytes, chunks, release
from .shared import Stages, unused

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "other": range(128, 256), "space": (32, 9, 13), "line": (10,), "stop": b".,;:?'\"-()", "bang": b"!", "bar": b"|<>{}[]\\/=+_~^`", "odd": b"#$%&*@"}
_KIND = np.full(256, len(_CLASSES), np.uint8)
for _k, _v in enumerate(_CLASSES.values()):
    _KIND[list(_v)] = _k
N_TEXT = 2 * (len(_CLASSES) + 7) + 1
_LANGS, _SOURCES, _LENGTHS = 16, 64, 12
#: Tasks that sum what all others give.
SUMMERS = 4
N_META, N_CODES = _LANGS + _SOURCES + _LENGTHS, _LANGS * _SOURCES * _LENGTHS


@dataclass(frozen=True)
class Fit:
    labelled: int = 4000
    rounds: int = 3
    confident: float = 0.95
    steps: int = 12  # of Newton at most, where the pool is summed anew for each
    keep_from: float = 0.5


def text_features(texts: list[bytes]) -> np.ndarray:
    """Shares of byte classes, of repeated words and lines, mean lengths; and their square roots, which part small shares."""
    out = np.zeros((len(texts), N_TEXT))
    for a, b in chunks(texts):
        part = texts[a:b]
        words = Words(part, lower=True)
        size = np.array([len(t) for t in part])
        raw = np.frombuffer(b"".join(part), np.uint8)
        owner = np.repeat(np.arange(len(part)), size)
        kinds = np.bincount(owner * (len(_CLASSES) + 1) + _KIND[raw], minlength=len(part) * (len(_CLASSES) + 1)).reshape(len(part), -1)
        n = np.maximum(size, 1)
        counts = np.diff(words.first)
        w = np.maximum(counts, 1)
        word_owner = np.repeat(np.arange(len(part)), counts)
        length = words.end - words.start
        row = [kinds[:, k] / n for k in range(len(_CLASSES))]
        row.append(np.bincount(word_owner, length, minlength=len(part)) / w / 20)
        row.append(np.bincount(word_owner, length > 14, minlength=len(part)) / w)
        row.append(np.array([len(np.unique(words.hash[i:j])) for i, j in zip(words.first, words.first[1:], strict=False)]) / w)
        lines = [t.split(b"\n") for t in part]
        row.append(np.array([1 - len(set(x)) / len(x) for x in lines]))
        row.append(np.log1p(counts) / 10)
        row.append(kinds[:, 6] / w)
        row.append(kinds[:, 7] / w)
        x = np.stack(row, axis=1)
        out[a:b] = np.concatenate([x, np.sqrt(x), (size == 0)[:, None]], axis=1)
    return out


def meta_codes(lang: list, source: list, length: list) -> np.ndarray:
    """Language, source and length, each in a few hashed or rounded values, as one number."""
    x = np.array([zlib.crc32(str(v).lower().encode()) % (_LANGS - 1) if v is not None else _LANGS - 1 for v in lang], np.int64)
    y = np.array([zlib.crc32(str(v).encode()) % (_SOURCES - 1) if v is not None else _SOURCES - 1 for v in source], np.int64)
    z = np.array([min(10, max(0, int(v)).bit_length() // 2) if v is not None else _LENGTHS - 1 for v in length], np.int64)
    return ((x * _SOURCES + y) * _LENGTHS + z).reshape(-1)


def meta_features(codes: np.ndarray) -> np.ndarray:
    """Codes as three ones each among ``N_META`` columns."""
    out, rows = np.zeros((len(codes), N_META)), np.arange(len(codes))
    out[rows, codes // _LENGTHS // _SOURCES] = 1
    out[rows, _LANGS + codes // _LENGTHS % _SOURCES] = 1
    out[rows, _LANGS + _SOURCES + codes % _LENGTHS] = 1
    return out


def sums_of(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slope and curvature of the logistic loss of some rows, one after the other; the last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    p = _sigmoid(x @ w)
    return np.concatenate([x.T @ (weight * (p - y)), ((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()])


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30, start: np.ndarray | None = None, more: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Ridge logistic regression by Newton steps from ``start`` or 0; ``more`` gives the sums of further rows."""
    n = x.shape[1] + 1
    w, penalty = np.zeros(n) if start is None else start, np.full(n, ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        sums = sums_of(x, y, weight, w) + (more(w) if more else 0)
        step = np.linalg.solve(sums[n:].reshape(n, n) + np.diag(penalty + 1e-9), sums[:n] + penalty * w)
        w = w - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < (1e-3 if more else 1e-6):
            break
    return np.round(w, 8)  # beyond that the order of summing shows


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    weights: tuple[np.ndarray, np.ndarray]
    scale: tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    calibration: tuple[np.ndarray, np.ndarray]
    shares: tuple[float, float]
    prior: float
    exchanged: tuple[int, int]

    def view(self, v: int, features: np.ndarray) -> np.ndarray:
        """Calibrated log-odds of a view."""
        m, s = self.scale[v]
        return self.calibration[v][0] * _odds((features - m) / s, self.weights[v]) + self.calibration[v][1]

    def score(self, text: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.view(0, text), self.view(1, meta_features(codes))
        both = self.prior + self.shares[0] * (a - self.prior) + self.shares[1] * (b - self.prior)
        return _sigmoid(a), _sigmoid(b), _sigmoid(both)


class Pool:
    """Unlabelled rows held in memory: text features and codes. ``Table`` has the same of a DataFrame."""

    def __init__(self, text: np.ndarray, codes: np.ndarray):
        self.text, self.codes = text, codes

    def counts(self) -> np.ndarray:
        """Rows by code."""
        return np.bincount(self.codes, minlength=N_CODES)

    def named(self, odds: Callable[[np.ndarray], np.ndarray], least: float) -> np.ndarray:
        """(2, code): rows that a view of the text is confident are of class 0, and 1."""
        z = odds(self.text)
        return np.stack([np.bincount(self.codes[k], minlength=N_CODES) for k in (z <= -least, z >= least)])

    def sums(self, w: np.ndarray, scale: tuple[np.ndarray, np.ndarray], label: np.ndarray) -> np.ndarray:
        """``sums_of`` the rows whose code has a label of 0 or 1."""
        y = label[self.codes]
        some = y >= 0
        return sums_of((self.text[some] - scale[0]) / scale[1], y[some].astype(float), np.ones(some.sum()), w)


class Table:
    """A pool of the rows of a DataFrame (text, code)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("text", "code")

    def _total(self, make: Callable[[Pool], np.ndarray], size: int) -> np.ndarray:
        """The sum over all batches of the ``size`` numbers that ``make`` gives for one.

        Each task gives one packed row, a few tasks sum those, and only their sums come to the driver.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    total += make(Pool(_stacked(batch.column("text")), np.asarray(batch.column("code")).astype(np.int64))).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["v"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for v in batch.column("v").to_pylist():
                    total += np.frombuffer(v)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["v"])

        rows = self.rows.mapInArrow(run, "v binary").repartition(SUMMERS).mapInArrow(add, "v binary").collect()
        return sum((np.frombuffer(r.v) for r in rows), np.zeros(size))

    def counts(self) -> np.ndarray:
        return self._total(lambda p: p.counts(), N_CODES)

    def named(self, odds: Callable[[np.ndarray], np.ndarray], least: float) -> np.ndarray:
        return self._total(lambda p: p.named(odds, least), 2 * N_CODES).reshape(2, -1)

    def sums(self, w: np.ndarray, scale: tuple[np.ndarray, np.ndarray], label: np.ndarray) -> np.ndarray:
        return self._total(lambda p: p.sums(w, scale, label), len(w) + len(w) ** 2)


def _stacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_TEXT).astype(float)


def train(text: np.ndarray, codes: np.ndarray, label: np.ndarray, pool: Pool | Table | None = None, fit: Fit = Fit()) -> Model | None:
    """From labelled rows (label: 1 or 0) and a pool of unlabelled ones. Every fourth labelled row is for calibration."""
    held, learn = np.arange(len(label))[3::4], np.delete(np.arange(len(label)), np.s_[3::4])
    if len(set(label[learn])) < 2 or len(set(label[held])) < 2:
        return None
    view = (text, meta_features(codes))
    scale = tuple((x[learn].mean(0), np.maximum(x[learn].std(0), 1e-3)) for x in view)
    x = [(v - m) / s for v, (m, s) in zip(view, scale, strict=True)]
    y, base = label[learn].astype(float), label[held].mean()
    prior = float(np.log((base + 1e-6) / (1 - base + 1e-6)))
    every = meta_features(np.arange(N_CODES))
    count = pool.counts() if pool is not None else np.zeros(N_CODES)
    said = np.zeros((2, N_CODES))  # rows by class and code, as the text view says
    table = np.full(N_CODES, -1)  # class by code, as the metadata view says
    weights: list[np.ndarray | None] = [None, None]
    calibration = [np.array([0.0, prior])] * 2
    trust = lambda n: 0.5 * min(1.0, len(learn) / max(n, 1))
    for turn in range(fit.rounds + 1):
        given = (count[table >= 0].sum(), said.sum())
        of_codes = np.flatnonzero(said.sum(0))
        hot = (every[of_codes] - scale[1][0]) / scale[1][1]
        more: list[Callable[[np.ndarray], np.ndarray] | None] = [
            (lambda w: trust(given[0]) * pool.sums(w, scale[0], table)) if given[0] else None,
            (lambda w: trust(given[1]) * sum(sums_of(hot, np.full(len(hot), float(c)), said[c, of_codes], w) for c in (0, 1))) if given[1] else None,
        ]
        for v in (0, 1):
            # the fit of the first round with pseudo-labels starts afresh, as without them weights can be far too large
            start = weights[v] if turn > 1 and more[v] is not None else None
            weights[v] = _fit(x[v][learn], y, np.ones(len(learn)), steps=30 if v or more[v] is None else fit.steps, start=start, more=more[v])
            z = _odds(x[v][held], weights[v])
            # calibration keeps the order: a view that tells nothing has slope 0
            c = _fit(z[:, None], label[held].astype(float), np.ones(len(held)), ridge=0.1)
            calibration[v] = c if c[0] > 0 else np.array([0.0, prior])
        made = Model(tuple(weights), scale, tuple(calibration), (1.0, 1.0), prior, tuple(int(n) for n in given))
        if turn == fit.rounds or pool is None:
            break
        least = float(np.log(fit.confident / (1 - fit.confident)))
        odds = made.view(1, every)
        table = np.where(odds >= least, 1, np.where(odds <= -least, 0, -1))
        said = pool.named(lambda t, m=made: m.view(0, t), least)

    def loss(z: np.ndarray) -> float:
        p = np.clip(_sigmoid(z), 1e-9, 1 - 1e-9)
        t = label[held]
        return float(-(t * np.log(p) + (1 - t) * np.log(1 - p)).mean())

    entropy = loss(np.full(len(held), prior))
    shares = tuple(float(np.clip((entropy - loss(made.view(v, view[v][held]))) / max(entropy, 1e-9), 0, 1)) for v in (0, 1))
    top = max(shares) or 1.0
    return replace(made, shares=tuple(s / top for s in shares))


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = text_features(as_bytes(batch.column("text"))).astype(np.float32).astype(float)
    return text, meta_codes(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, codes = _features(batch)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.tobytes() for t in text.astype(np.float32)], pa.binary()), pa.array(codes.astype(np.int32))], names=["doc_id", "text", "code"])
    release()


def _typed(docs: DataFrame) -> DataFrame:
    have = {c.lower() for c in docs.columns}
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*((F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, code, label) of each row of ``docs``, written; label: 1, 0, null of unlabelled rows, else -1."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    known = known.select("doc_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1).cast("int").alias("label"))
    made = _typed(docs).mapInArrow(_featured, "doc_id long, text binary, code int").join(known, "doc_id", "left")
    made = made.withColumn("label", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("label")))
    return Stages(docs.sparkSession, "quality").write(made, "features")


def fitted(made: DataFrame, fit: Fit = Fit()) -> Model | None:
    """The model for ``features``."""
    some = made.where("label >= 0").orderBy(F.xxhash64("doc_id"), "doc_id", "code", "text").limit(fit.labelled)
    rows = some.select("label", "code", "text").toPandas()
    if not len(rows):
        return None
    text = np.frombuffer(b"".join(map(bytes, rows["text"])), np.float32).reshape(-1, N_TEXT).astype(float)
    return train(text, rows["code"].to_numpy().astype(np.int64), rows["label"].to_numpy().astype(int), Table(made.where("label is null")), fit)


def scored(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """(doc_id, p_text, p_meta, score, keep) of each row; keep where the score is ``fit.keep_from`` or more."""
    made = features(docs, labels)
    model = fitted(made, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = model.score(_stacked(batch.column("text")), np.asarray(batch.column("code")).astype(np.int64)) if model else [np.ones(batch.num_rows)] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.float64()) for x in (a, b, c)), pa.array(c >= fit.keep_from)], names=["doc_id", "p_text", "p_meta", "score", "keep"])

    return made.select("doc_id", "text", "code").mapInArrow(run, "doc_id long, p_text double, p_meta double, score double, keep boolean")


def kept(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    model = fitted(features(docs, labels), fit)
    if model is None:
        return docs
    have = {c.lower(): c for c in docs.columns}
    typed = [(F.col(f"`{have[c]}`") if c in have else F.lit(None)).cast(k).alias(c) for c, k in (("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view = pa.RecordBatch.from_struct_array(batch.column(batch.num_columns - 1))
            good = model.score(*_features(view))[2] >= fit.keep_from
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(good))
        release()

    return docs.select("*", F.struct(*typed).alias(unused(docs.columns, "view")[0])).mapInArrow(run, docs.schema)
