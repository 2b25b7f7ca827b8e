"""Personal data by bootstrapped contextual extraction: seeds by form, then whatever stands where seeds stand.

Seeds are spans of four fixed forms: e-mail, IP and card numbers, phones. They are found, left to right and without overlap,
by splitting a text at a form and taking the matches between the pieces, so lengths of pieces and matches give places; the
forms are written so that a long run of letters or digits is passed over once (possessive, and begun only where a run
begins). Matches that fail their test (parts of an address, check digit, number of digits) are dropped, not tried again.

Candidates are the other words with an @ or ``digits`` digits, stripped of punctuation. Every mention has three lexical
patterns: two words before it, the words on both sides, two words after it. Patterns and instances (seed and candidate
strings) make a bipartite graph, scored in rounds. A pattern is trusted for the kind that most of its instances are known to
be, if they are ``support`` or more and ``precise`` in a hundred of all of its instances; strings of unknown kind count
against it. A candidate with a trusted pattern is scored over all its patterns, trusted or not: known instances of the kind
among all instances. From ``certain`` in a hundred on it is known itself, everywhere, and helps to trust patterns in the
next round. All counts are of different strings, so that a group of copies of any size has no more say than one.

All of it is DataFrame functions. Texts are read once; the rows shuffled are mentions and one marker a row. Counts are summed
within tasks first, so a pattern or string may be in any part of all mentions; trusted patterns and new instances are
broadcast only if counted few. A row's own mentions meet in one task. Rows are judged each on its own, repeated or not, null
ids included; null and empty texts hold nothing; a longer text costs memory in proportion (its pieces, in the executor).
Other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stages, bounded, parts_for

KINDS = ("email", "ip", "card", "phone")
_WORD = len(KINDS)  # the kind of a candidate
_ROW = -1  # and of a row's marker
# Fixed forms, as given; (?<!...) and ++ only spare the engine starts and retreats that can't succeed.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_LIKE = r"(?<![^\x09-\x0D\x20])[^\x09-\x0D\x200-9@]*+[0-9@][^\x09-\x0D\x20]*+"
#: For a quick look, what a text with a match has in any case.
_SIGNS = ("@", "[0-9]\\.[0-9]", "[0-9][\\x20-]?[0-9]", "\\+[0-9]", "[0-9@]")
_GAP = " \t\n\x0b\x0c\r"
_EDGE = "\"'`()[]{}<>.,;:!?*#$%&|="
_NEAR = 80  # characters on either side that words of patterns are taken from
_FOLD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")


def _digits(value: Column) -> Column:
    return F.length(value) - F.length(F.translate(value, "0123456789", ""))


def _valid(kind: Column, value: Column, digits: int) -> Column:
    """Whether a match of a form passes that form's test."""
    parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    bare = F.translate(value, " -", "")
    n = _digits(value)
    return (
        F.when(kind == 1, small)
        .when(kind == 2, F.length(bare).between(14, 19) & F.call_function("luhn_check", bare))
        .when(kind == 3, n.between(10, 15))
        .when(kind == _WORD, (n >= digits) | F.contains(value, F.lit("@")))
        .otherwise(True)
    )


def _words(near: Column) -> Column:
    folded = F.translate(F.trim(near, F.lit(_GAP)), *_FOLD)
    return F.filter(F.split(folded, r"[\x09-\x0D\x20]+"), lambda w: w != "")


def _context(piece: Column, nth: int, edge: Column) -> Column:
    """The nth word of a piece, from its end if negative; ``edge`` beyond the last."""
    return F.coalesce(F.try_element_at(piece, F.lit(nth)), edge)


def mentions(docs: DataFrame, digits: int = 4) -> DataFrame:
    """(row, doc_id, kind, start, end, value, patterns): seeds and candidates, and a row of kind -1 for each row of ``docs``.

    ``row`` numbers the rows, which have to come in the same order when a task is run again, as those of files do. Places
    are in code points, ``end`` exclusive. Seeds come first: a candidate that shares a character with one is none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    forms = []
    for kind, (form, sign) in enumerate(zip((_EMAIL, _IP, _CARD, _PHONE, _LIKE), _SIGNS, strict=True)):
        pieces, hits = F.split("text", form, -1), F.regexp_extract_all("text", F.lit(form), F.lit(0))
        zipped = F.arrays_zip(pieces.alias("before"), hits.alias("value"), F.slice(pieces, 2, 2_000_000_000).alias("after"))
        forms.append(F.when(F.col("text").rlike(sign), F.struct(F.lit(kind).alias("kind"), zipped.alias("hits"))))
    mark = F.struct(F.lit(_ROW).alias("kind"), F.array(F.struct(F.lit("").alias("before"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("after"))).alias("hits"))
    each = numbered.select("row", "doc_id", F.explode(F.array_compact(F.array(mark, *forms))).alias("form"))
    each = each.select("row", "doc_id", "form.kind", "form.hits")  # apart, so that no hit carries the others
    hit = each.select("row", "doc_id", "kind", F.posexplode("hits").alias("nth", "hit"))
    hit = hit.where((F.col("kind") == _ROW) | F.col("hit.value").isNotNull())
    left, right = _words(F.right(F.col("hit.before"), F.lit(_NEAR))), _words(F.left(F.col("hit.after"), F.lit(_NEAR)))
    hit = hit.select(
        "row", "doc_id", "kind", "nth", F.col("hit.value").alias("value"), F.length("hit.before").alias("gap"), F.length("hit.value").alias("size"),
        left.alias("left"), right.alias("right"),
    )
    hit = hit.repartition(parts_for(docs, 32), "row")
    walked = Window.partitionBy("row", "kind").orderBy("nth")
    placed = hit.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(walked)).withColumn("last", F.lead("nth").over(walked).isNull())
    seen = F.col("kind") == _WORD  # candidates are stripped
    bare = F.ltrim(F.col("value"), F.lit(_EDGE))
    core = F.rtrim(bare, F.lit(_EDGE))
    start = F.col("end") - F.col("size")
    shift = F.col("size") - F.length(bare)
    before, after = F.when(F.col("nth") == 0, "^").otherwise("#"), F.when(F.col("last"), "$").otherwise("#")
    l1, l2, r1, r2 = (_context(F.col(c), k, e) for c, k, e in (("left", -1, before), ("left", -2, before), ("right", 1, after), ("right", 2, after)))
    patterns = F.array(F.concat_ws(" ", l2, l1, F.lit("_")), F.concat_ws(" ", l1, F.lit("_"), r1), F.concat_ws(" ", F.lit("_"), r1, r2))
    own = placed.select(
        "row", "doc_id", "kind", F.when(seen, start + shift).otherwise(start).alias("start"),
        F.when(seen, start + shift + F.length(core)).otherwise(F.col("end")).alias("end"),
        F.when(seen, core).otherwise(F.col("value")).alias("value"), F.when(F.col("kind") != _ROW, patterns).alias("patterns"),
    )
    own = own.where((F.col("kind") == _ROW) | _valid(F.col("kind"), F.col("value"), digits))
    seed = F.col("kind").between(0, _WORD - 1)
    row = Window.partitionBy("row").orderBy("start")
    reach = F.max(F.when(seed, F.col("end"))).over(row.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(seed, F.col("start"))).over(row.rowsBetween(0, Window.unboundedFollowing))
    marked = own.withColumn("reach", reach).withColumn("ahead", ahead)
    free = (F.coalesce(F.col("reach"), F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("ahead"), F.col("end")) >= F.col("end"))
    return marked.where((F.col("kind") != _WORD) | free).drop("reach", "ahead")


def discovered(found: DataFrame, stages: Stages, support: int = 3, precise: int = 80, certain: int = 60, rounds: int = 3) -> DataFrame:
    """(value, kind): candidate strings of ``found`` (mentions) that ``rounds`` rounds over the graph have come to know."""
    spark = found.sparkSession
    known = F.when(F.col("kind") < _WORD, F.col("kind"))
    edges = found.where(F.col("kind") != _ROW).select("value", F.explode("patterns").alias("pattern"), known.alias("kind"))
    edges = stages.write(edges.groupBy("value", "pattern").agg(F.min("kind").alias("kind")), "edges")
    # a string that is a seed somewhere is known everywhere
    named = edges.where("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("k"))
    edges = stages.write(edges.join(named, "value", "left").select("value", "pattern", F.col("k").alias("kind")), "edges")
    out = spark.createDataFrame([], "value string, kind int")
    for _ in range(rounds):
        per = [F.count_if(F.coalesce(F.col("kind") == k, F.lit(False))) for k in range(_WORD)]
        stats = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.array(*per).alias("per")).where(F.array_max("per") > 0)
        best = (F.array_position("per", F.array_max("per")) - 1).cast("int")
        stats = stages.write(stats.select("pattern", "n", "per", best.alias("k"), F.array_max("per").alias("most")), "patterns")
        trusted = stats.where((F.col("most") >= support) & (F.col("most") * 100 >= F.col("n") * precise))
        open_ = edges.where("kind IS NULL")
        asked = stages.write(open_.join(bounded(trusted.select("pattern", "k")), "pattern").select("value", "k").distinct(), "asked")
        # every pattern of a string that is asked about counts; one without known instances counts as those it has
        reach = open_.select("value", "pattern").join(bounded(asked), "value")
        sizes = edges.join(bounded(reach.select("pattern").distinct()), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("n"), F.array(*per).alias("per"))
        scored = reach.join(bounded(stages.write(sizes, "sizes")), "pattern").groupBy("value", "k").agg(F.sum(F.expr("per[k]")).alias("for"), F.sum("n").alias("all"))
        sure = scored.where(F.col("for") * 100 >= F.col("all") * certain)
        first = Window.partitionBy("value").orderBy(F.desc("for"), "k")
        new = stages.write(sure.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("value", F.col("k").alias("kind")), "new")
        if new.isEmpty():
            break
        out = out.unionByName(new)
        edges = stages.write(edges.join(bounded(new.withColumnRenamed("kind", "k")), "value", "left").select("value", "pattern", F.coalesce("kind", "k").alias("kind")), "edges")
    return out


def personal(docs: DataFrame, digits: int = 4, support: int = 3, precise: int = 80, certain: int = 60, rounds: int = 3) -> DataFrame:
    """(doc_id, base, found) of each row of ``docs`` (doc_id, text): arrays of (start, kind, end), sorted; kind by number in ``KINDS``."""
    stages = Stages(docs.sparkSession, "pii")
    every = stages.write(mentions(docs, digits), "mentions")
    new = bounded(stages.write(discovered(every, stages, support, precise, certain, rounds), "known").select("value", F.col("kind").alias("k")))
    more = every.where(F.col("kind") == _WORD).join(new, "value").select("row", "doc_id", F.struct("start", F.col("k").alias("kind"), "end").alias("span"), F.lit(False).alias("base"))
    seed = F.col("kind") != _ROW
    base = every.where(F.col("kind") < _WORD).select("row", "doc_id", F.when(seed, F.struct("start", "kind", "end")).alias("span"), F.when(seed, True).alias("base"))
    spans = lambda base: F.array_sort(F.collect_list(F.when(F.col("base") == base, F.col("span"))))
    return base.unionByName(more).groupBy("row", "doc_id").agg(spans(True).alias("base"), spans(False).alias("found")).drop("row")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each of the sorted ``spans`` (start, kind, end) put in square brackets as its kind; of overlapping ones the first."""
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))
    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.element_at(names, s["kind"] + 1)).alias("out"), s["end"].cast("bigint").alias("at")))
    return F.aggregate(spans, first, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))


def op11(docs: DataFrame) -> DataFrame:
    """Digests of ``personal``; n_found: spans that the method adds."""
    names = F.array(*map(F.lit, KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = F.array_sort(F.concat("base", "found"))
    return personal(docs).select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"), F.size("found").cast("long").alias("n_found"))


def sql(digits: int = 4, support: int = 3, precise: int = 80, certain: int = 60, rounds: int = 3) -> str:
    """DuckDB's account of ``op11``, rounds written out one after the other."""
    forms = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]", r"[^\x09-\x0D\x200-9@]*[0-9@][^\x09-\x0D\x20]*",
    )
    gap = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    edge = _EDGE.replace("'", "''")
    words = lambda near: rf"list_filter(string_split_regex(translate(trim({near}, {gap}), '{_FOLD[0]}', '{_FOLD[1]}'), '[\x09-\x0D\x20]+'), lambda w: w <> '')"
    found = "\n  UNION ALL ".join(f"SELECT doc_id, {k} AS kind, string_split_regex(text, '{x}') AS g, regexp_extract_all(text, '{x}') AS h FROM d" for k, x in enumerate(forms))
    n_digits = "len(value) - len(translate(value, '0123456789', ''))"
    out = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
i AS (SELECT doc_id, kind, g, h, unnest(range(1, len(h) + 1)) AS i FROM f),
m AS (
  SELECT doc_id, kind, h[i] AS value, list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: len(x))), 0) AS start,
    {words(f"right(g[i], {_NEAR})")} AS l, {words(f"left(g[i + 1], {_NEAR})")} AS r, CASE WHEN i = 1 THEN '^' ELSE '#' END AS b, CASE WHEN i = len(h) THEN '$' ELSE '#' END AS a FROM i
),
p AS (
  SELECT doc_id, kind, CASE WHEN kind = {_WORD} THEN trim(value, '{edge}') ELSE value END AS value,
    CASE WHEN kind = {_WORD} THEN start + len(value) - len(ltrim(value, '{edge}')) ELSE start END AS start,
    [coalesce(l[-2], b) || ' ' || coalesce(l[-1], b) || ' _', coalesce(l[-1], b) || ' _ ' || coalesce(r[1], a), '_ ' || coalesce(r[1], a) || ' ' || coalesce(r[2], a)] AS patterns FROM m
),
v AS (
  SELECT *, start + len(value) AS stop FROM p WHERE CASE kind
    WHEN 1 THEN len(list_filter(string_split(value, '.'), lambda x: len(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) > 255)) = 0
    WHEN 2 THEN {n_digits} BETWEEN 14 AND 19 AND list_sum(list_transform(list_reverse(string_split(translate(value, ' -', ''), '')), lambda x, j:
      CASE WHEN j % 2 = 1 THEN CAST(x AS INT) WHEN CAST(x AS INT) > 4 THEN 2 * CAST(x AS INT) - 9 ELSE 2 * CAST(x AS INT) END)) % 10 = 0
    WHEN 3 THEN {n_digits} BETWEEN 10 AND 15
    WHEN {_WORD} THEN {n_digits} >= {digits} OR contains(value, '@') ELSE true END
),
u AS (SELECT * FROM v c WHERE kind < {_WORD} OR NOT EXISTS (FROM v s WHERE s.kind < {_WORD} AND s.doc_id = c.doc_id AND s.start < c.stop AND s.stop > c.start)),
w AS (SELECT value, unnest(patterns) AS pattern, CASE WHEN kind < {_WORD} THEN kind END AS kind FROM u),
e0 AS (SELECT DISTINCT value, pattern, min(kind) OVER (PARTITION BY value) AS kind FROM w)"""
    for r in range(rounds):
        out += f""",
c{r} AS (SELECT pattern, kind, count(*) AS n FROM e{r} GROUP BY ALL),
t{r} AS (SELECT pattern, kind, n, sum(n) OVER (PARTITION BY pattern) AS every, row_number() OVER (PARTITION BY pattern ORDER BY kind IS NULL, n DESC, kind) AS nth FROM c{r}),
q{r} AS (SELECT DISTINCT e.value, t.kind FROM e{r} e JOIN t{r} t USING (pattern) WHERE e.kind IS NULL AND t.nth = 1 AND t.kind IS NOT NULL AND t.n >= {support} AND t.n * 100 >= t.every * {precise}),
s{r} AS (
  SELECT q.value, q.kind, sum(coalesce(k.n, 0)) AS yes, sum(x.every) AS every FROM q{r} q JOIN e{r} e USING (value) JOIN (SELECT pattern, sum(n) AS every FROM c{r} GROUP BY 1) x USING (pattern)
  LEFT JOIN c{r} k ON k.pattern = e.pattern AND k.kind = q.kind GROUP BY ALL
),
b{r} AS (SELECT value, kind FROM s{r} WHERE yes * 100 >= every * {certain} QUALIFY row_number() OVER (PARTITION BY value ORDER BY yes DESC, kind) = 1),
e{r + 1} AS (SELECT e.value, e.pattern, coalesce(e.kind, b.kind) AS kind FROM e{r} e LEFT JOIN b{r} b USING (value))"""
    new = " UNION ALL ".join(f"SELECT value, kind FROM b{r}" for r in range(rounds))
    names = ", ".join(f"'{k}'" for k in KINDS)
    return out + f""",
k AS ({new}),
spans AS (
  SELECT doc_id, kind, start, stop, true AS base FROM u WHERE kind < {_WORD}
  UNION ALL SELECT doc_id, k.kind, start, stop, false FROM u JOIN k USING (value) WHERE u.kind = {_WORD}
)
SELECT d.doc_id, count(*) FILTER (base AND kind = 0) AS n_email, count(*) FILTER (base AND kind = 1) AS n_ip, count(*) FILTER (base AND kind = 2) AS n_card,
  count(*) FILTER (base AND kind = 3) AS n_phone, count(*) FILTER (NOT base) AS n_found,
  sha256(coalesce(string_agg([{names}][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) FILTER (base), '')) AS base_sha256,
  coalesce(string_agg([{names}][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop), '') AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""


SQL = sql()
