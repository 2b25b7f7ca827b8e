"""Search over segments as it is documented: keywords, vectors, pages. ``keyword_index`` and ``vector_cells`` do the same by index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_tokens

#: A side of up to so many rows, which are counted, is broadcast.
FEW = 200_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df``, marked for broadcast if it has no more than ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bm25(segments: DataFrame, queries: DataFrame, top: int = 10, k: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``top`` segments (meeting_id, seg_idx, text) of each query (query_id, terms), ties by position.

    Only terms that are asked for are counted by segment: the join with the queries' distinct terms comes first.
    """
    t = segments.select("meeting_id", "seg_idx", content_tokens(F.col("text")).alias("w"))
    size = t.agg(F.count("*").cast("double").alias("n"), F.avg(F.size("w")).alias("mean"))
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    tf = t.select("meeting_id", "seg_idx", F.size("w").alias("len"), F.explode("w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("meeting_id", "seg_idx", "term").agg(F.first("len").alias("len"), F.count("*").alias("f"))
    df = tf.groupBy("term").agg(F.count("*").cast("double").alias("d"))
    each = asked.join(tf, "term").join(df, "term").join(F.broadcast(size))
    gain = F.log(1 + (F.col("n") - F.col("d") + 0.5) / (F.col("d") + 0.5)) * F.col("f") * (k + 1) / (F.col("f") + k * (1 - b + b * F.col("len") / F.col("mean")))
    scored = each.groupBy("query_id", "meeting_id", "seg_idx").agg(F.bround(F.sum(gain), 6).alias("score"))
    return ranked(scored, top, "meeting_id", "seg_idx")


def ranked(scored: DataFrame, top: int, *ties: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *ties))
    return scored.withColumn("rank", n.cast("long")).where(F.col("rank") <= top)


#: Rows of one block of vectors or probes.
ROWS = 4096


def cosine(vectors: DataFrame, probes: DataFrame, top: int = 10, rows: int = ROWS) -> DataFrame:
    """The ``top`` vectors (vec_id, embedding) nearest to each probe (query_id, probe), itself left out; exact.

    Vectors and probes are dealt into blocks of about ``rows`` by their ids; each block of probes meets each block of
    vectors in a group of its own, as two matrices, and leaves ``top`` rows for each probe. No pair is a row.
    """
    blocks = lambda df: max(1, -(-df.count() // rows))
    v_blocks, q_blocks = blocks(vectors), blocks(probes)
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    v = vectors.select("vec_id", "embedding", deal("vec_id", v_blocks).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"))
    p = probes.select("query_id", "probe", deal("query_id", q_blocks).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))).alias("v"))
    return nearest(v, p, ["v", "q"], top)


def nearest(vectors: DataFrame, probes: DataFrame, groups: list[str], top: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``top`` of all groups, each of which has some vectors and some probes."""
    from ..shipping import ship

    ship(vectors.sparkSession)
    kinds = dict(vectors.dtypes)["vec_id"], dict(probes.dtypes)["query_id"]

    def met(v: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        return best_of(v, p, top)

    cog = probes.groupBy(*groups).cogroup(vectors.groupBy(*groups))
    each = cog.applyInPandas(lambda p, v: met(v, p), f"query_id {kinds[1]}, vec_id {kinds[0]}, score double")
    return ranked(each, top, "vec_id")


def unit(column: pd.Series) -> np.ndarray:
    """Vectors as rows of length 1; zeros stay."""
    m = np.array(column.tolist(), np.float64).reshape(len(column), -1)
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def best_of(v: pd.DataFrame, p: pd.DataFrame, top: int) -> pd.DataFrame:
    """Each probe's ``top`` among the vectors, by score to four digits, then id."""
    empty = pd.DataFrame({"query_id": p["query_id"][:0], "vec_id": v["vec_id"][:0], "score": np.zeros(0)})
    if not len(v) or not len(p):
        return empty
    order = np.argsort(v["vec_id"].to_numpy(), kind="stable")
    ids, m, q = v["vec_id"].to_numpy()[order], unit(v["embedding"])[order], unit(p["probe"])
    parts = []
    for a, b in _slices(len(p), max(1, 2_000_000 // len(v))):
        s = np.round(q[a:b] @ m.T, 4)
        own = p["query_id"].to_numpy()[a:b]
        s[ids[None, :] == own[:, None]] = -np.inf
        pick = np.argsort(-s, axis=1, kind="stable")[:, :top]  # ids ascend, so ties go to the lower
        score = np.take_along_axis(s, pick, 1)
        parts.append(pd.DataFrame({"query_id": np.repeat(own, pick.shape[1]), "vec_id": ids[pick].ravel(), "score": score.ravel()}))
    out = pd.concat(parts)
    return out[out["score"] > -np.inf]


def _slices(n: int, size: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, size):
        yield a, min(n, a + size)


def page(segments: DataFrame, limit: int, offset: int = 0, speaker: str | None = None) -> DataFrame:
    out = segments if speaker is None else segments.where(F.col("speaker") == speaker)
    return out.orderBy("meeting_id", "seg_idx").offset(offset).limit(limit)
