"""Queries of error rates, alignments and speaker scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance, text
from ..operators import intervals, scoring
from . import roles
from .registry import BUCKET, query
from .roles import norm, using

#: Edit distance row by row: state (key, i, w, r, h), w is the row of the table so far.
DP = """, dp AS (
  SELECT k, 0::BIGINT AS i, range(0, len(h) + 1) AS w, r, h FROM pair
  UNION ALL
  SELECT k, i + 1, list_reduce(
    list_prepend([i + 1], list_transform(range(1, len(h) + 1), lambda j: [j::BIGINT])),
    lambda acc, x: list_append(acc, least(acc[-1] + 1, w[x[1] + 1] + 1, w[x[1]] + (r[i + 1] <> h[x[1]])::BIGINT))), r, h
  FROM dp WHERE i < len(r)
),
edit AS (SELECT k, w[-1]::BIGINT AS edits, len(r)::BIGINT AS n, len(h)::BIGINT AS m FROM dp WHERE i = len(r))"""

#: The same with a count of substitutions and deletions in each cell: edits * 2^40 + substitutions * 2^20 + deletions. Ties
#: go across, then to a deletion.
SPLIT = """, dp AS (
  SELECT k, 0::BIGINT AS i, list_transform(range(0, len(h) + 1), lambda j: j::BIGINT << 40) AS w, r, h FROM pair
  UNION ALL
  SELECT k, i + 1, list_reduce(
    list_prepend([((i + 1) << 40) + i + 1], list_transform(range(1, len(h) + 1), lambda j: [j::BIGINT])),
    lambda acc, x: list_append(acc, CASE
      WHEN (w[x[1]] >> 40) + (r[i + 1] <> h[x[1]])::BIGINT <= least(w[x[1] + 1] >> 40, acc[-1] >> 40) + 1 THEN w[x[1]] + (r[i + 1] <> h[x[1]])::BIGINT * ((1::BIGINT << 40) + (1 << 20))
      WHEN (w[x[1] + 1] >> 40) <= (acc[-1] >> 40) THEN w[x[1] + 1] + (1::BIGINT << 40) + 1
      ELSE acc[-1] + (1::BIGINT << 40) END)), r, h
  FROM dp WHERE i < len(r)
),
n AS (
  SELECT k, w[-1] >> 40 AS edits, len(r)::BIGINT AS ref_words, len(h)::BIGINT AS hyp_words, (w[-1] >> 20) & 1048575 AS word_substitutions, w[-1] & 1048575 AS word_deletions,
    (w[-1] >> 40) - ((w[-1] >> 20) & 1048575) - (w[-1] & 1048575) AS word_insertions, len(r) - ((w[-1] >> 20) & 1048575) - (w[-1] & 1048575) AS word_hits FROM dp WHERE i = len(r)
)"""

#: The way back through the table: E equal, R replace, D delete, I insert, in the same order of preference.
PATHS = DP + """, rows_ AS MATERIALIZED (SELECT k, i, w FROM dp),
back AS (
  SELECT k, len(r)::BIGINT AS i, len(h)::BIGINT AS j, '' AS o, r, h FROM pair
  UNION ALL
  SELECT k, i - (t <> 'I')::BIGINT, j - (t <> 'D')::BIGINT, t || o, r, h FROM (
    SELECT b.*, CASE WHEN b.i > 0 AND b.j > 0 AND y.w[b.j] + (r[b.i] <> h[b.j])::BIGINT = x.w[b.j + 1] THEN CASE WHEN r[b.i] = h[b.j] THEN 'E' ELSE 'R' END
      WHEN b.i > 0 AND y.w[b.j + 1] + 1 = x.w[b.j + 1] THEN 'D' ELSE 'I' END AS t
    FROM back b JOIN rows_ x ON x.k = b.k AND x.i = b.i LEFT JOIN rows_ y ON y.k = b.k AND y.i = b.i - 1 WHERE b.i > 0 OR b.j > 0)
),
path AS (SELECT k, o, r, h FROM back WHERE i = 0 AND j = 0)"""


def rate(edits: str, n: str, m: str) -> str:
    return f"CASE WHEN {n} = 0 THEN CASE WHEN {m} = 0 THEN 0.0 ELSE 1.0 END ELSE round_even(({edits})::DOUBLE / {n}, 6) END"


#: As many ASCII characters as stand for those of a pair of texts, which DuckDB's byte-wise distance then compares.
_ASCII = "".join(chr(c) for c in range(35, 127) if chr(c) not in "'\\")


def char_edits(a: str, b: str) -> str:
    """SQL of the edits between two texts of at most 90 distinct characters."""
    known = f"array_to_string(list_distinct(string_split({a} || {b}, '')), '')"
    coded = lambda x: f"translate({x}, {known}, left('{_ASCII}', length({known})))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN length({a} || {b})::BIGINT ELSE levenshtein({coded(a)}, {coded(b)})::BIGINT END"


PAIR = f""", pair AS (
  SELECT s.meeting_id * 1000 + s.seg_idx AS k, {norm('s.text')} AS r, {norm("array_to_string(c.w, ' ')")} AS h
  FROM seg s JOIN ctc c USING (meeting_id, seg_idx)
)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    s = roles.segments(spark, d)
    c = roles.ctc(s).select("meeting_id", "seg_idx", F.col("text").alias("hyp_text"))
    return s.select("meeting_id", "seg_idx", F.col("text").alias("ref_text")).join(c, ["meeting_id", "seg_idx"])


@query(
    using("seg", "ctc", recursive=True) + PAIR + DP + f"""
, item AS (SELECT k // 1000 AS meeting_id, edits, n, {rate('edits', 'n', 'm')} AS wer FROM edit)
SELECT meeting_id, count(*) AS n_items, round_even(sum(CAST(round(wer * 1000000) AS BIGINT))::DOUBLE / count(*), 0) / 1000000 AS macro_wer,
  round_even(sum(edits)::DOUBLE / nullif(sum(n), 0), 6) AS micro_wer, sum(edits)::BIGINT AS edits, sum(n)::BIGINT AS ref_words
FROM item GROUP BY 1"""
)
def corpus_wer(spark: SparkSession, d: str) -> DataFrame:
    """Word error rates of an edited transcript by meeting: macro, micro, pooled edits."""
    items = scoring.error_rates(pairs(spark, d))
    out = scoring.corpus_aggregate(items, "meeting_id").select("meeting_id", "n_items", "macro_wer", "micro_wer")
    return out.join(items.groupBy("meeting_id").agg(F.sum("word_edits").alias("edits"), F.sum("ref_words").alias("ref_words")), "meeting_id")


_CHARS = PAIR + f""", t AS (SELECT k, array_to_string(r, '') AS a, array_to_string(h, '') AS b FROM pair),
chars AS (SELECT k, length(a)::BIGINT AS n, length(b)::BIGINT AS m, {char_edits('a', 'b')} AS edits FROM t)"""


@query(using("seg", "ctc") + _CHARS + f" SELECT k // 1000 AS meeting_id, k % 1000 AS seg_idx, edits AS char_edits, n AS ref_chars, {rate('edits', 'n', 'm')} AS cer FROM chars")
def char_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Character error rates of turns."""
    return scoring.error_rates(pairs(spark, d)).select("meeting_id", "seg_idx", "char_edits", "ref_chars", "cer")


@query(using("seg", "whisper", recursive=True) + PAIR.replace("ctc c", "whisper c") + SPLIT + " SELECT k // 1000 AS meeting_id, k % 1000 AS seg_idx, word_hits, word_substitutions, word_deletions, word_insertions, edits AS word_edits FROM n")
def error_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hits, substitutions, deletions and insertions of turns against a transcript with words replaced."""
    s = roles.segments(spark, d)
    p = s.select("meeting_id", "seg_idx", F.col("text").alias("ref_text")).join(roles.whisper(s).select("meeting_id", "seg_idx", F.col("text").alias("hyp_text")), ["meeting_id", "seg_idx"])
    return scoring.error_counts(p, cells=None).select("meeting_id", "seg_idx", "word_hits", "word_substitutions", "word_deletions", "word_insertions", "word_edits")


@query(
    using("seg", "ctc", recursive=True) + _CHARS + SPLIT + f"""
, i AS (
  SELECT k // 1000 % 7 AS corpus, n.*, c.edits AS char_edits, c.n AS ref_chars, {rate('n.edits', 'n.ref_words', 'n.hyp_words')} AS wer, {rate('c.edits', 'c.n', 'c.m')} AS cer,
    CASE WHEN k % 1000 % 2 = 0 THEN k // 1000 % 10 / 10.0::DOUBLE END AS cp_wer, CASE WHEN k // 1000 % 7 < 5 THEN k % 1000 / 100.0::DOUBLE END AS der
  FROM n JOIN chars c USING (k)
)
SELECT corpus, count(*) AS n_items, sum(word_substitutions)::BIGINT AS word_substitutions, sum(word_deletions)::BIGINT AS word_deletions, sum(word_insertions)::BIGINT AS word_insertions, sum(ref_words)::BIGINT AS ref_words,
  round_even(sum(CAST(round(wer * 1000000) AS BIGINT))::DOUBLE / count(*), 0) / 1000000 AS macro_wer, round_even(sum(CAST(round(cer * 1000000) AS BIGINT))::DOUBLE / count(*), 0) / 1000000 AS macro_cer,
  round_even(sum(edits)::DOUBLE / nullif(sum(ref_words), 0), 6) AS micro_wer, round_even(sum(char_edits)::DOUBLE / nullif(sum(ref_chars), 0), 6) AS micro_cer,
  round_even(sum(CAST(round(cp_wer * 1000000) AS BIGINT))::DOUBLE / count(cp_wer), 0) / 1000000 AS macro_cp_wer, round_even(sum(CAST(round(der * 1000000) AS BIGINT))::DOUBLE / count(der), 0) / 1000000 AS mean_der
FROM i GROUP BY 1"""
)
def corpus_scores(spark: SparkSession, d: str) -> DataFrame:
    """Seven corpora of turns: macro means, micro rates from pooled counts, means of speaker scores where there are any."""
    m, k = F.col("meeting_id"), F.col("seg_idx")
    items = scoring.error_counts(pairs(spark, d), cells=None).withColumn("corpus", m % 7)
    items = items.withColumn("cp_wer", F.when(k % 2 == 0, m % 10 / 10.0)).withColumn("der", F.when(m % 7 < 5, k / 100.0))
    out = scoring.corpus_scores(items, "corpus")
    return out.select("corpus", "n_items", "word_substitutions", "word_deletions", "word_insertions", "ref_words", "macro_wer", "macro_cer", "micro_wer", "micro_cer", "macro_cp_wer", "mean_der")


@query(using("seg", "ctc", recursive=True) + PAIR + DP + " SELECT k // 1000 AS meeting_id, k % 1000 AS seg_idx, edits, n AS ref_words, m AS hyp_words FROM edit")
def align_ops(spark: SparkSession, d: str) -> DataFrame:
    """Edits and lengths counted from aligned operations."""
    p = pairs(spark, d).withColumn("ops", distance.aligned(text.tokens(F.col("ref_text")), text.tokens(F.col("hyp_text"))))
    n = {t: distance.counted(F.col("ops"), t) for t in ("equal", "replace", "delete", "insert")}
    return p.select("meeting_id", "seg_idx", (n["replace"] + n["delete"] + n["insert"]).alias("edits"), (n["equal"] + n["replace"] + n["delete"]).alias("ref_words"), (n["equal"] + n["replace"] + n["insert"]).alias("hyp_words"))


@query(
    using("seg", "ctc", recursive=True) + PAIR + PATHS + """
, s AS (SELECT k, o, r, h, unnest(range(1, length(o) + 1)) AS i FROM path),
u AS (
  SELECT k, i, o[i] AS t, r[length(replace(o[1:i], 'I', ''))] AS a, h[length(replace(o[1:i], 'D', ''))] AS b,
    length(replace(o[greatest(1, i - 4):i + 4], 'E', '')) > 0 AS near FROM s
),
v AS (
  SELECT *, CASE WHEN NOT near THEN '…' WHEN t = 'E' THEN a WHEN t = 'R' THEN '{' || a || '|' || b || '}' WHEN t = 'D' THEN '[-' || a || '-]' ELSE '[+' || b || '+]' END AS x,
    lag(near) OVER (PARTITION BY k ORDER BY i) AS before FROM u
)
SELECT p.k // 1000 AS meeting_id, p.k % 1000 AS seg_idx, coalesce(string_agg(v.x, ' ' ORDER BY i) FILTER (near OR before IS NULL OR before), '') AS diff
FROM path p LEFT JOIN v USING (k) GROUP BY 1, 2"""
)
def diff_context(spark: SparkSession, d: str) -> DataFrame:
    """Readable differences with four words around each."""
    p = pairs(spark, d).withColumn("ops", distance.aligned(text.tokens(F.col("ref_text")), text.tokens(F.col("hyp_text"))))
    return p.select("meeting_id", "seg_idx", distance.marked_errors(F.col("ops")).alias("diff"))


# ---- speakers: three roles at most, so all six permutations are spelled out

_PERMS = "perms AS (SELECT * FROM (VALUES (1, [1, 2, 3]), (2, [1, 3, 2]), (3, [2, 1, 3]), (4, [2, 3, 1]), (5, [3, 1, 2]), (6, [3, 2, 1])) t(p, o))"
_SWAP = "CASE speaker WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE speaker END"
_CP = f""", rs AS (
  SELECT meeting_id, speaker, {norm("string_agg(trim(text), ' ' ORDER BY seg_idx)")} AS w, row_number() OVER (PARTITION BY meeting_id ORDER BY min(seg_idx)) AS i
  FROM seg WHERE trim(text) <> '' GROUP BY 1, 2
),
hs AS (
  SELECT meeting_id, {_SWAP} AS speaker, {norm("string_agg(array_to_string(w, ' '), ' ' ORDER BY seg_idx)")} AS w, row_number() OVER (PARTITION BY meeting_id ORDER BY min(seg_idx)) AS i
  FROM ctc WHERE len(w) > 0 GROUP BY 1, 2
),
pair AS (SELECT rs.meeting_id * 100 + rs.i * 10 + hs.i AS k, rs.w AS r, hs.w AS h FROM rs JOIN hs USING (meeting_id))"""
_CP_MATCH = f""", grid AS (SELECT meeting_id, i, j FROM (SELECT DISTINCT meeting_id FROM seg) CROSS JOIN (SELECT unnest([1, 2, 3]) AS i) CROSS JOIN (SELECT unnest([1, 2, 3]) AS j)),
price AS (
  SELECT g.meeting_id, g.i, g.j, CASE WHEN rs.i IS NULL THEN coalesce(len(hs.w), 0) WHEN hs.i IS NULL THEN len(rs.w) ELSE e.edits END AS cost
  FROM grid g LEFT JOIN rs ON rs.meeting_id = g.meeting_id AND rs.i = g.i LEFT JOIN hs ON hs.meeting_id = g.meeting_id AND hs.i = g.j LEFT JOIN edit e ON e.k = g.meeting_id * 100 + g.i * 10 + g.j
),
{_PERMS},
cp AS (SELECT meeting_id, min(cost)::BIGINT AS edits FROM (SELECT meeting_id, p, sum(cost) AS cost FROM price, perms WHERE o[i] = j GROUP BY 1, 2) GROUP BY 1),
total AS (SELECT meeting_id, sum(len(w))::BIGINT AS ref_words FROM rs GROUP BY 1),
cpw AS (SELECT meeting_id, edits, ref_words, CASE WHEN ref_words = 0 THEN (edits > 0)::INT::DOUBLE ELSE round_even(edits::DOUBLE / ref_words, 6) END AS cp_wer FROM cp JOIN total USING (meeting_id))"""


def swapped(s: DataFrame) -> DataFrame:
    swap = F.when(F.col("speaker") == "user", "assistant").when(F.col("speaker") == "assistant", "user").otherwise(F.col("speaker"))
    return roles.ctc(s).withColumn("speaker", swap)


@query(using("seg", "ctc", recursive=True) + _CP + DP + _CP_MATCH + " SELECT * FROM cpw")
def cpwer_exact(spark: SparkSession, d: str) -> DataFrame:
    """Concatenated minimum-permutation word error rate against the edited transcript with two roles swapped."""
    s = roles.segments(spark, d)
    return scoring.cp_wer(s, swapped(s)).select("meeting_id", "edits", "ref_words", "cp_wer")


def _der(hypothesis: str) -> str:
    """SQL of diarization error of the segments, by (meeting_id, speaker, s, e) of ``hypothesis``."""
    return f""", both_ AS (SELECT meeting_id, speaker, s, e, 'r' AS side FROM seg WHERE s < e UNION ALL SELECT meeting_id, speaker, s, e, 'h' FROM ({hypothesis}) WHERE s < e),
edge AS (SELECT meeting_id, s AS t FROM both_ UNION SELECT meeting_id, e FROM both_),
atom AS (SELECT * FROM (SELECT meeting_id, t, lead(t) OVER (PARTITION BY meeting_id ORDER BY t) AS u FROM edge) WHERE u IS NOT NULL),
active AS (SELECT DISTINCT a.meeting_id, t, u, u - t AS d, side, speaker FROM atom a JOIN both_ b ON b.meeting_id = a.meeting_id AND b.s <= a.t AND b.e >= a.u),
count_ AS (SELECT meeting_id, t, d, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 'h') AS h FROM active GROUP BY 1, 2, 3),
sums AS (SELECT meeting_id, sum(greatest(r - h, 0) * d)::BIGINT AS miss, sum(greatest(h - r, 0) * d)::BIGINT AS false_alarm, sum(least(r, h) * d)::BIGINT AS both_, sum(r * d)::BIGINT AS total FROM count_ GROUP BY 1),
name AS (SELECT meeting_id, side, speaker, row_number() OVER (PARTITION BY meeting_id, side ORDER BY speaker) AS i FROM (SELECT DISTINCT meeting_id, side, speaker FROM active)),
gain AS (
  SELECT x.meeting_id, m.i, n.i AS j, sum(x.d) AS g FROM active x JOIN active y ON y.meeting_id = x.meeting_id AND y.t = x.t AND x.side = 'r' AND y.side = 'h'
  JOIN name m ON m.meeting_id = x.meeting_id AND m.side = 'r' AND m.speaker = x.speaker JOIN name n ON n.meeting_id = y.meeting_id AND n.side = 'h' AND n.speaker = y.speaker GROUP BY 1, 2, 3
),
orders AS (SELECT * FROM (VALUES ([1, 2, 3]), ([1, 3, 2]), ([2, 1, 3]), ([2, 3, 1]), ([3, 1, 2]), ([3, 2, 1])) t(o)),
best AS (SELECT meeting_id, max(g) AS g FROM (SELECT meeting_id, o, sum(g) AS g FROM gain, orders WHERE o[i] = j GROUP BY 1, 2) GROUP BY 1),
der AS (
  SELECT meeting_id, miss, false_alarm, (both_ - coalesce(g, 0))::DOUBLE AS confusion, total, round_even((miss + false_alarm + both_ - coalesce(g, 0))::DOUBLE / total, 6) AS der
  FROM sums LEFT JOIN best USING (meeting_id) WHERE total > 0
)"""


#: Speaker intervals that drift: every third is cut, and every fifth is another speaker's.
_DRIFT = "SELECT meeting_id, CASE WHEN seg_idx % 5 = 2 THEN 'system' ELSE speaker END AS speaker, s + 900 AS s, CASE WHEN seg_idx % 3 = 0 THEN e ELSE e + 900 END AS e FROM seg"


def drifted(s: DataFrame) -> DataFrame:
    k = F.col("seg_idx")
    return s.select("meeting_id", F.when(k % 5 == 2, "system").otherwise(F.col("speaker")).alias("speaker"), (F.col("start") + 900).alias("start"), F.when(k % 3 == 0, F.col("end")).otherwise(F.col("end") + 900).alias("end"))


@query(using("seg") + _der(_DRIFT) + " SELECT * FROM der")
def der_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Diarization error of turns that drift by 0.9 s, some cut short and some given to another speaker."""
    s = roles.segments(spark, d).select("meeting_id", "seg_idx", "start", "end", "speaker")
    return intervals.der_sweep(s.drop("seg_idx"), drifted(s), BUCKET)


_WHOLE = f""", w AS (
  SELECT meeting_id, {norm("string_agg(trim(text), ' ' ORDER BY seg_idx) FILTER (trim(text) <> '')")} AS r FROM seg GROUP BY 1
),
v AS (SELECT meeting_id, {norm("string_agg(array_to_string(w, ' '), ' ' ORDER BY seg_idx) FILTER (len(w) > 0)")} AS h FROM ctc GROUP BY 1),
x AS (SELECT meeting_id, coalesce(r, []) AS r, coalesce(h, []) AS h, array_to_string(coalesce(r, []), '') AS a, array_to_string(coalesce(h, []), '') AS b FROM w JOIN v USING (meeting_id)),
y AS (SELECT meeting_id, length(a)::BIGINT AS ref_chars, length(b)::BIGINT AS hyp_chars, {char_edits('a', 'b')} AS char_edits FROM x)"""


@query(
    using("seg", "ctc", recursive=True) + _CP.replace("pair AS (", "pair AS (SELECT meeting_id * 100 AS k, r, h FROM x UNION ALL ").replace(", rs AS", _WHOLE + ", rs AS", 1) + DP + _CP_MATCH + _der("SELECT meeting_id, " + _SWAP + " AS speaker, s, e FROM ctc") + f"""
SELECT y.meeting_id, ref_chars, hyp_chars, char_edits, e.n AS ref_words, e.m AS hyp_words, e.edits AS word_edits, {rate('e.edits', 'e.n', 'e.m')} AS wer, {rate('char_edits', 'ref_chars', 'hyp_chars')} AS cer, cp_wer, der, '' AS skipped
FROM y JOIN edit e ON e.k = y.meeting_id * 100 JOIN cpw USING (meeting_id) LEFT JOIN der USING (meeting_id)"""
)
def score_transcript(spark: SparkSession, d: str) -> DataFrame:
    """All scores of whole meetings against the edited transcript with two roles swapped."""
    s = roles.segments(spark, d)
    return scoring.score_transcripts(s, swapped(s), bucket=BUCKET).withColumn("skipped", F.array_join("skipped", "; "))
