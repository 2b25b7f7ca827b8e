"""Queries of web-page clean-up and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus
from . import roles
from .registry import BUCKET, query
from .roles import content, using


def _plain_sql(x: str) -> str:
    """SQL of a page's sentences: the same steps in DuckDB's patterns, templates and tables up to two within each other."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&euml;", "ë"), ("&eacute;", "é")):
        x = f"replace({x}, '{entity}', '{char}')"
    x = f"regexp_replace({x}, '&amp;?', '&', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '(?si)<ref[^>/]*?>.*?</ref>|<ref[^>]*/>', ' ', 'g')"
    blocks = "|".join(f"<{t}[^>]*?>.*?</{t}>" for t in ("math", "code", "nowiki", "gallery", "timeline", "syntaxhighlight", "table"))
    x = f"regexp_replace({x}, '(?si){blocks}', ' ', 'g')"
    for mark in (r"\{\{[^{}]*\}\}", r"\{\|[^{}]*\|\}"):  # the inner ones first
        x = f"regexp_replace(regexp_replace({x}, '{mark}', '', 'g'), '{mark}', '', 'g')"
    x = rf"regexp_replace({x}, '\[(https?://[^\s\]]+)(?:\s+([^\]]+))?\]', ' \2 ', 'g')"
    x = rf"regexp_replace({x}, '\[\[(?:[^\[\]]*\|)?\s*([^\[\]|]*?)\s*\]\]', '\1', 'g')"
    x = rf"""regexp_replace(regexp_replace({x}, '=+\s*(.*?)\s*=+', ' \1. ', 'g'), '''''+', '', 'g')"""
    x = rf'''regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '([,.;:!?()«»"“”„])', ' \1 ', 'g')'''
    x = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    return rf"list_filter(string_split(regexp_replace({x}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda q: length(q) >= 3)"


#: Put behind each page: templates and tables within each other.
_NESTED = " {{x|{{y|1}} z {{w}}}} kept text. {| a {| b |} c |} and more {{t}}kept. "


@query(f"WITH h AS (SELECT page_id, html || '{_NESTED}' AS html FROM pages), p AS (SELECT page_id, {_plain_sql('html')} AS s FROM h) SELECT page_id, len(s)::INTEGER AS n, array_to_string(s, chr(10)) AS text FROM p")
def markup_clean(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of web pages without their markup."""
    p = roles.table(spark, d, "pages").select("page_id", text.plain_sentences(F.concat("html", F.lit(_NESTED))).alias("s"))
    return p.select("page_id", F.size("s").alias("n"), F.array_join("s", "\n").alias("text"))


def _over(base: str, other: str, name: str) -> str:
    """SQL of the text of ``other`` over each segment of ``base``."""
    return f"""{name} AS (
  SELECT b.meeting_id, b.seg_idx, string_agg(array_to_string(x.w, ' '), ' ' ORDER BY x.s, x.e) FILTER (len(x.w) > 0) AS t
  FROM {base} b JOIN {other} x ON x.meeting_id = b.meeting_id AND x.s < b.e AND b.s < x.e GROUP BY 1, 2
)"""


_SPLIT_AT = r"list_filter(list_transform(string_split(regexp_replace(clean, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda q: trim(q)), lambda q: q <> '')"


@query(
    using("seg", "ctc", "whisper") + f""", {_over('whisper', 'ctc', 'oc')}, {_over('whisper', 'seg', 'og')},
base AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY s, e, seg_idx) - 1 AS n, array_to_string(w, ' ') AS whisper FROM whisper),
tri AS (SELECT base.*, oc.t AS ctc, og.t AS clean FROM base JOIN oc USING (meeting_id, seg_idx) JOIN og USING (meeting_id, seg_idx) WHERE base.whisper <> '' AND oc.t <> '' AND og.t <> ''),
fact AS (
  SELECT meeting_id, n, s, e, ctc, whisper, clean, {_SPLIT_AT} AS parts, list_distinct(list_concat({content('ctc')}, {content('whisper')})) AS src,
    greatest(len({content('ctc')}), len({content('whisper')}), 1) AS target FROM tri
),
first_ AS (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM fact WHERE len(parts) > 1 AND len(src) > 0),
both_ AS (SELECT *, unnest(range(i, len(parts) + 1)) AS j FROM first_),
word_ AS (SELECT meeting_id, n, i, j, src, target, t, {content('t')} AS tok FROM (SELECT *, array_to_string(parts[i:j], ' ') AS t FROM both_)),
score AS (SELECT *, len(list_intersect(list_distinct(tok), src))::DOUBLE / len(list_distinct(tok)) - 0.25::DOUBLE * abs(len(tok) - target) / greatest(len(tok), 1) AS score FROM word_ WHERE len(tok) > 0),
best AS (SELECT meeting_id, n, arg_max(t, struct_pack(a := score, b := -i, c := -j)) AS t FROM score GROUP BY 1, 2),
cut AS (SELECT f.*, coalesce(best.t, f.clean) AS picked FROM fact f LEFT JOIN best USING (meeting_id, n)),
size AS (SELECT *, {content('whisper')} AS a, {content('ctc')} AS b, {content('picked')} AS c FROM cut)
SELECT meeting_id, 'segment_' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INTEGER, '0') AS chunk_id, s AS start, e AS "end", ctc, whisper, picked AS clean FROM size
WHERE len(a) > 0 AND len(b) > 0 AND len(c) > 0 AND len(c) <= greatest(len(a), len(b)) + 6 AND len(list_intersect(list_distinct(c), list_concat(a, b)))::DOUBLE / len(list_distinct(c)) >= 0.35"""
)
def training_pairs_primary(spark: SparkSession, d: str) -> DataFrame:
    """Training pairs on segments, each with the run of sentences that its sources support best."""
    s = roles.segments(spark, d)
    return corpus.primary_pairs(roles.whisper(s), roles.ctc(s), s, BUCKET)
