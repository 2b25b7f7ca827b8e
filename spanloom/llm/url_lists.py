"""URL filters by temporal list join.

A block list is a log of dated entries: from its date on, a rule (a host, with all hosts below it, or a host and path) is
``on`` or off. Each entry holds until the rule's next one, which makes validity intervals that never overlap within a
rule. A capture is judged by the entries active when it was fetched: its host, the hosts above that, and each of these
with the path's leading directories are looked up as of the fetch day.

Intervals are laid out by ``span``-day periods, so that the as-of join is an equality join on (rule, period) with only the
entries of one period behind it: a rule with a long history, or one that a third of all captures ask for, multiplies
nothing. Ties: the last entry in ``seq`` of a rule and day holds. Of several active rules the longest is reported.

A URL is looked up only as deep as the list has rules: of hosts and paths with more parts than any rule, the other parts
are not spelled out, so work on a URL grows with its length, not with its square. Two numbers tell how deep that is.

Null, empty or unparsable URLs have a null host and are never blocked, nor is a capture without a day. Entries without a
rule or a day are left out. An empty list blocks nothing. Columns besides those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where there is none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path, from its slash to the query or fragment."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(rule, day_from, day_to, action) of ``entries`` (rule, day, seq, action); day_to is excluded, null is open."""
    last = entries.where("rule is not null and day is not null").groupBy("rule", "day").agg(F.max_by("action", F.struct("seq", "action")).alias("action"))
    w = Window.partitionBy("rule").orderBy("day")
    return last.select("rule", F.col("day").alias("day_from"), F.lead("day").over(w).alias("day_to"), "action")


def rules_of(url: Column, labels: int, heads: int) -> Column:
    """All rules of up to ``labels`` host labels and ``heads`` directories that could match.

    These are each host suffix of two labels or more (a host's only label, if it has one), alone and with each leading path.
    """
    split = F.split(host_of(url), r"\.")
    least = F.least(F.lit(2), F.size(split))
    sizes = F.when(F.lit(labels) >= least, F.sequence(least, F.least(F.size(split), F.lit(labels))))
    hosts = F.transform(sizes, lambda k: F.array_join(F.slice(split, -k, k), "."))
    parts = F.slice(F.filter(F.split(path_of(url), "/"), lambda p: p != ""), 1, heads) if heads else F.array().cast("array<string>")
    paths = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.when(k == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"))))
    return F.when(host_of(url).isNotNull(), F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))


def depth_of(rules: DataFrame) -> tuple[int, int]:
    """The most host labels and the most directories of ``rules`` (rule)."""
    parts = F.split("rule", "/")
    row = rules.agg(F.max(F.size(F.split(F.get(parts, F.lit(0)), r"\."))), F.max(F.size(parts) - 1)).first()
    return row[0] or 0, row[1] or 0


def judged(captures: DataFrame, entries: DataFrame, span: int = 64) -> DataFrame:
    """``captures`` (capture_id, url, day) as (capture_id, url, day, host, blocked, rule, since).

    rule: the longest rule that is on at the day, since: its entry's day; null and -1 where the capture isn't blocked. day
    counts days. Rows that repeat all three columns are one capture.
    """
    captures = captures.select(F.col("capture_id").cast("long").alias("capture_id"), F.col("url").cast("string").alias("url"), F.col("day").cast("long").alias("day"))
    end = captures.agg(F.max("day")).first()[0] or 0  # an open interval need not be laid out any further
    valid = intervals(entries).where("action = 'on'")
    until = F.greatest(F.coalesce(F.col("day_to") - 1, F.lit(end).cast("long")), F.col("day_from"))
    laid = valid.select("rule", "day_from", "day_to", F.explode(F.sequence(F.floor(F.col("day_from") / span), F.floor(until / span))).alias("period"))
    keys = captures.select("*", F.explode_outer(rules_of(F.col("url"), *depth_of(valid))).alias("key"), F.floor(F.col("day") / span).alias("at"))
    active = (F.col("key") == F.col("rule")) & (F.col("at") == F.col("period")) & (F.col("day") >= F.col("day_from")) & (F.col("day_to").isNull() | (F.col("day") < F.col("day_to")))
    met = keys.join(bounded(laid), active, "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", F.col("day_from").alias("since"))))
    out = met.groupBy("capture_id", "url", "day").agg(best.alias("best"))
    return out.select("capture_id", "url", "day", host_of(F.col("url")).alias("host"), F.col("best").isNotNull().alias("blocked"), F.col("best.rule").alias("rule"), F.coalesce("best.since", F.lit(-1)).alias("since"))


def sample_list(urls: DataFrame) -> DataFrame:
    """A dated list (rule, day, seq, action) for ``urls`` (url), made by rule from hosts and first directories.

    Stands in for a real list: every third host length is listed, delisted and listed again; every fifth has its first
    directories listed.
    """
    seen = urls.select(host_of(F.col("url")).alias("host"), F.regexp_extract(path_of(F.col("url")), "^/+([^/]+)", 1).alias("head")).where("host is not null").distinct()
    hosts = seen.select("host").distinct().withColumn("n", F.length("host")).where("n % 3 = 0")
    days = F.array(*(F.struct(((F.col("n") * 37) % 300 + plus).cast("long").alias("day"), F.lit(seq).alias("seq"), F.lit(action).alias("action")) for plus, seq, action in ((0, 0, "on"), (40, 1, "off"), (90, 2, "on"))))
    of_hosts = hosts.select(F.col("host").alias("rule"), F.explode(days).alias("e")).select("rule", "e.*")
    heads = seen.where("head <> '' and length(host) % 5 = 0").select(F.concat("host", F.lit("/"), "head").alias("rule"), ((F.length("host") * 11) % 300).cast("long").alias("day"), F.lit(0).alias("seq"), F.lit("on").alias("action"))
    return of_hosts.unionByName(heads)


def op5(pages: DataFrame) -> DataFrame:
    """Per page (page_id, host, day, blocked, rule, since): fetched on day page_id modulo 365, judged by ``sample_list``."""
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", (F.col("page_id") % 365).alias("day"))
    return judged(captures, sample_list(pages.select("url"))).select(F.col("capture_id").alias("page_id"), "host", "day", "blocked", "rule", "since")


#: DuckDB's account of ``op5``.
SQL = r"""
WITH u AS (
  SELECT DISTINCT page_id, url, page_id % 365 AS day,
    nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', ''), '') AS host,
    rtrim(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/') AS path
  FROM pages
),
hosts AS (SELECT DISTINCT host, length(host) AS n FROM u WHERE host IS NOT NULL),
heads AS (SELECT DISTINCT host, regexp_extract(path, '^/+([^/]+)', 1) AS head FROM u WHERE host IS NOT NULL),
entries AS (
  SELECT host AS rule, unnest([(n * 37) % 300, (n * 37) % 300 + 40, (n * 37) % 300 + 90]) AS day, unnest(['on', 'off', 'on']) AS action FROM hosts WHERE n % 3 = 0
  UNION ALL SELECT host || '/' || head, (length(host) * 11) % 300, 'on' FROM heads WHERE head <> '' AND length(host) % 5 = 0
),
valid AS (SELECT rule, day AS day_from, lead(day) OVER (PARTITION BY rule ORDER BY day) AS day_to, action FROM entries),
m AS (
  SELECT u.page_id, v.rule, v.day_from, row_number() OVER (PARTITION BY u.page_id ORDER BY length(v.rule) DESC, v.rule DESC) AS k
  FROM u JOIN valid v ON v.action = 'on' AND u.day >= v.day_from AND (v.day_to IS NULL OR u.day < v.day_to)
    AND (u.host = split_part(v.rule, '/', 1) OR suffix(u.host, '.' || split_part(v.rule, '/', 1)))
    AND (v.rule NOT LIKE '%/%' OR u.path = '/' || split_part(v.rule, '/', 2) OR prefix(u.path, '/' || split_part(v.rule, '/', 2) || '/'))
)
SELECT u.page_id, u.host, u.day, m.rule IS NOT NULL AS blocked, m.rule, CAST(coalesce(m.day_from, -1) AS BIGINT) AS since
FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.k = 1
"""
