"""Queries of search by index and of language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import language_model, search
from ..operators.keyword_index import KeywordIndex
from ..operators.vector_cells import VectorCells
from ..sources.scratch import scratch
from . import roles
from .registry import query
from .roles import content, using

BM25_SQL = f"""WITH q AS (SELECT item_id AS query_id, {content('text')} AS terms FROM benchmark),
t AS (SELECT conv_id, turn, {content('text')} AS w FROM conversations),
n AS (SELECT count(*)::DOUBLE AS n, avg(len(w))::DOUBLE AS a FROM t),
u AS (SELECT conv_id, turn, len(w) AS l, unnest(w) AS term FROM t),
tf AS (SELECT conv_id, turn, any_value(l) AS l, term, count(*) AS f FROM u GROUP BY conv_id, turn, term),
df AS (SELECT term, count(*)::DOUBLE AS d FROM tf GROUP BY 1),
qt AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM q),
s AS (SELECT query_id, conv_id, turn, round_even(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM qt JOIN tf USING (term)
  JOIN df USING (term), n GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, conv_id, turn) AS rank FROM s)
SELECT query_id, conv_id AS meeting_id, turn AS seg_idx, score, rank FROM r WHERE rank <= 5"""
COSINE_SQL = """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, v.vec_id, round_even(list_cosine_similarity(v.embedding::DOUBLE[], q.e::DOUBLE[]), 4) AS score FROM embeddings v, q WHERE v.vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5"""


def keyword_queries(spark: SparkSession, d: str) -> DataFrame:
    return roles.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.content_tokens(F.col("text")).alias("terms"))


def keyword_index(spark: SparkSession, d: str, **sizes: int) -> KeywordIndex:
    """All turns in two batches, the users' and the others'."""
    turns = roles.turns(spark, d).select("meeting_id", "seg_idx", "speaker", "text")
    index = KeywordIndex(spark, scratch(spark, "keywords"), **sizes)
    for one in (turns.where("speaker = 'user'"), turns.where("speaker <> 'user' OR speaker IS NULL")):
        index.add(one)
    return index


@query(BM25_SQL)
def keyword_index_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search through an index of two batches: the rows of ``bm25_search``."""
    return keyword_index(spark, d).search(keyword_queries(spark, d), 5)


@query(f"""WITH t AS (SELECT conv_id, turn, role = 'user' AS u, {content('text')} AS w FROM conversations),
p AS (SELECT DISTINCT conv_id, turn, u, unnest(w) AS term FROM t),
c AS (SELECT term, u, count(*) AS n FROM p GROUP BY ALL)
SELECT term, sum(n)::BIGINT AS postings, sum((n + 127) // 128)::BIGINT AS blocks FROM c GROUP BY term""")
def keyword_index_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Postings and blocks of each term of the index."""
    return keyword_index(spark, d).heads().groupBy("term").agg(F.sum("n").alias("postings"), F.count("*").alias("blocks"))


@query(f"""WITH t AS (SELECT conv_id, turn, {content('text')} AS w FROM conversations),
p AS (SELECT DISTINCT conv_id, turn, unnest(w) AS term FROM t), c AS (SELECT term, count(*) AS n FROM p GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest({content('text')}) AS term FROM benchmark)
SELECT query_id, sum(n)::BIGINT AS postings, true AS fewer FROM q JOIN c USING (term) GROUP BY 1""")
def keyword_index_reads(spark: SparkSession, d: str) -> DataFrame:
    """The postings of each query's terms, and whether its search reads no more than these."""
    return keyword_index(spark, d).read_share(keyword_queries(spark, d), 5).select("query_id", "postings", (F.col("read") <= F.col("postings")).alias("fewer"))


def vector_cells(spark: SparkSession, d: str) -> tuple[VectorCells, DataFrame]:
    """All vectors in cells; as probes those whose id 20 divides."""
    v = roles.table(spark, d, "embeddings").select("vec_id", "embedding")
    cells = VectorCells(spark, scratch(spark, "cells"))
    cells.build(v, cells=128)
    return cells, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe"))


@query(COSINE_SQL)
def vector_cells_certain(spark: SparkSession, d: str) -> DataFrame:
    """Vector search through cells, carried on until nothing nearer can be left: the rows of ``cosine_topk``."""
    cells, probes = vector_cells(spark, d)
    return cells.search(probes, 5, near=8, certain=True)


@query()
def vector_cells_near(spark: SparkSession, d: str) -> DataFrame:
    """Vector search in as many of 128 cells as find nineteen in twenty of other probes' neighbours; its own recall is measured in a test."""
    cells, probes = vector_cells(spark, d)
    return cells.search(probes, 5, near=cells.near_for(0.95, 5))


@query("SELECT 5 * count(*) AS wanted, true AS reached FROM embeddings WHERE vec_id % 20 = 0")
def vector_cells_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether ``vector_cells_near`` finds nine in ten of the exact search's five nearest."""
    cells, probes = vector_cells(spark, d)
    exact = search.cosine(roles.table(spark, d, "embeddings").select("vec_id", "embedding"), probes, 5).select("query_id", "vec_id")
    near = cells.search(probes, 5, near=cells.near_for(0.95, 5)).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "vec_id"], "left").agg(F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


def _model_sql(order: int, names: str = "") -> str:
    """SQL of the model: n-grams ``k1`` to ``k{order}``, sums of contexts ``x1`` on, probabilities ``p1`` on."""
    out = using("whisper") + f""", sent AS (SELECT list_filter(w, lambda x: x NOT IN ('<s>', '</s>', '<unk>', '')) AS w, CASE WHEN speaker = 'user' THEN 1 ELSE 2 END AS weight FROM tok),
pad AS (SELECT list_concat(list_concat(['<s>'], w), ['</s>']) AS x, weight FROM sent WHERE len(w) > 0),
pos AS (SELECT x, weight, unnest(range(2, len(x) + 1)) AS i FROM pad),
f AS (SELECT array_to_string(x[greatest(1, i - {order - 1}):i], ' ') AS g, least(i, {order}) AS n, sum(weight) AS c FROM pos GROUP BY ALL),
k{order} AS (SELECT g, c FROM f WHERE n = {order})"""
    tail = lambda g, n: rf"array_to_string(string_split({g}, ' ')[-{n}:], ' ')"
    for n in range(order - 1, 0, -1):
        out += f",\nk{n} AS (SELECT {tail('g', n)} AS g, count(*) AS c FROM k{n + 1} GROUP BY 1 UNION ALL SELECT g, c FROM f WHERE n = {n})"
    for n in range(1, order + 1):
        out += f""",
t{n} AS (SELECT count(*) FILTER (c = 1)::DOUBLE AS a, count(*) FILTER (c = 2)::DOUBLE AS b, count(*) FILTER (c = 3)::DOUBLE AS c, count(*) FILTER (c = 4)::DOUBLE AS d FROM k{n}),
y{n} AS (SELECT CASE WHEN a * b * c * d > 0 THEN [1 - 2 * (a / (a + 2 * b)) * b / a, 2 - 3 * (a / (a + 2 * b)) * c / b, 3 - 4 * (a / (a + 2 * b)) * d / c] ELSE [-1.0::DOUBLE] END AS o FROM t{n}),
d{n} AS (SELECT CASE WHEN len(o) = 3 AND o[1] BETWEEN 0 AND 1 AND o[2] BETWEEN 0 AND 2 AND o[3] BETWEEN 0 AND 3 THEN o ELSE [0.5::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE] END AS o FROM y{n}),
o{n} AS (SELECT g, c, array_to_string(string_split(g, ' ')[1:{n - 1}], ' ') AS h, o[least(c, 3)::INT] AS d FROM k{n}, d{n}),
x{n} AS (SELECT h, sum(c)::DOUBLE AS every, (any_value(o[1]) * count(*) FILTER (c = 1) + any_value(o[2]) * count(*) FILTER (c = 2) + any_value(o[3]) * count(*) FILTER (c > 2)) / sum(c)::DOUBLE AS taken FROM o{n}, d{n} GROUP BY 1)"""
        if n == 1:
            out += """,
p1 AS (SELECT g, (c - d) / every + taken / (SELECT count(*) + 1 FROM k1) AS p FROM o1, x1 UNION ALL SELECT '<unk>', taken / (SELECT count(*) + 1 FROM k1) FROM x1 UNION ALL SELECT '<s>', 1.0 FROM x1)"""
        else:
            out += f",\np{n} AS (SELECT o.g, (o.c - o.d) / x.every + x.taken * q.p AS p FROM o{n} o JOIN x{n} x ON x.h = o.h JOIN p{n - 1} q ON q.g = {tail('o.g', n - 1)})"
    return out


def _arpa_sql(order: int) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {n} AS n, p.g, round_even(log10(p.p), 6) AS logp, " + (f"round_even(log10(coalesce(x.taken, 1)), 6) AS backoff FROM p{n} p LEFT JOIN x{n + 1} x ON x.h = p.g" if n < order else f"0.0::DOUBLE AS backoff FROM p{n} p")
        for n in range(1, order + 1)
    )
    return f"{_model_sql(order)} {rows}"


def _score_sql(order: int) -> str:
    out = _model_sql(order) + r""",
w0 AS (SELECT meeting_id, seg_idx, list_concat(list_concat(['<s>'], list_filter(w, lambda x: x NOT IN ('<s>', '</s>', '<unk>', ''))), ['</s>']) AS x FROM whisper),
w1 AS (SELECT meeting_id, seg_idx, unnest(x) AS word, unnest(range(1, len(x) + 1)) AS i FROM w0),
w2 AS (SELECT meeting_id, seg_idx, i, p1.g IS NULL AS missing, coalesce(p1.g, '<unk>') AS w FROM w1 LEFT JOIN p1 ON p1.g = w1.word),
w3 AS (SELECT *, list(w) OVER (PARTITION BY meeting_id, seg_idx ORDER BY i ROWS BETWEEN """ + str(order - 1) + " PRECEDING AND CURRENT ROW) AS past FROM w2)"
    source, logp, joins = "w3", "log10(p1.p)", "JOIN p1 ON p1.g = w3.w"
    for n in range(2, order + 1):
        joins += f" LEFT JOIN p{n} ON len(past) >= {n} AND p{n}.g = array_to_string(past[-{n}:], ' ') LEFT JOIN x{n} ON len(past) >= {n} AND x{n}.h = array_to_string(past[-{n}:-2], ' ')"
        logp = f"coalesce(log10(p{n}.p), log10(coalesce(x{n}.taken, 1)) + {logp})"
    return f"{out} SELECT meeting_id, seg_idx, count(*) - 1 AS n_words, count(*) FILTER (missing) AS n_unknown, round_even(sum({logp}), 5) AS logp FROM {source} {joins} WHERE i > 1 GROUP BY 1, 2"


def _model(spark: SparkSession, d: str, order: int) -> language_model.LanguageModel:
    """A model of the turns; a user's count once, others twice."""
    turns = roles.turns(spark, d).select(F.col("w").alias("words"), F.when(F.col("speaker") == "user", 1).otherwise(2).alias("weight"))
    return language_model.LanguageModel(spark, scratch(spark, "lm"), order).train(turns)


@query(_arpa_sql(3))
def language_model_arpa(spark: SparkSession, d: str) -> DataFrame:
    """A model of order 3, written as an ARPA file and read back."""
    model, path = _model(spark, d, 3), scratch(spark, "arpa")
    model.write_arpa(path)
    return language_model.read_arpa(spark, path).select("n", "g", F.bround("logp", 6).alias("logp"), F.bround("backoff", 6).alias("backoff"))


@query(_score_sql(3))
def language_model_scores(spark: SparkSession, d: str) -> DataFrame:
    """How likely each edited turn is under a model of the turns."""
    s = roles.whisper(roles.segments(spark, d)).select("meeting_id", "seg_idx", F.col("w").alias("words"))
    out = _model(spark, d, 3).score(s, "meeting_id", "seg_idx")
    return out.withColumn("logp", F.bround("logp", 5))
