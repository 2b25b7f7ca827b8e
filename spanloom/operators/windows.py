"""Operators on neighbouring rows of a meeting: inferred ends, merges, detectors, labels, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import joined
from ..model import UNKNOWN
from .scans import WIDTH, Scan, slot_of


def infer_ends(items: DataFrame) -> DataFrame:
    """``items`` (meeting_id, pos, start, end) with missing ends filled, and ``inferred``.

    In input order, the end is the next start if that is later, else start plus the meeting's mean positive length, which
    is 2 where none is known.
    """
    m = Window.partitionBy("meeting_id")
    following = F.lead("start").over(m.orderBy("pos"))
    typical = F.coalesce(F.avg(F.when(F.col("end") > F.col("start"), F.col("end") - F.col("start"))).over(m), F.lit(2.0))
    filled = F.when(F.col("end").isNotNull(), F.col("end").cast("double")).when(following > F.col("start"), following.cast("double")).otherwise(F.col("start") + typical)
    return items.withColumn("inferred", F.col("end").isNull()).withColumn("end", filled)


def review_ends(items: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Reviewed segments sorted by start, with missing ends filled.

    The end is the next start, at the last row the meeting's own end (``ends``: meeting_id, end_sec) if that is later, else
    start plus the median positive gap, held to 2 to 15 seconds, 5 without gaps. Rows without start or text have a
    ``problem`` instead of stopping the rest.
    """
    order = Window.partitionBy("meeting_id").orderBy("start", "pos")
    gaps = items.where("start is not null").withColumn("gap", F.lead("start").over(order) - F.col("start")).where("gap > 0")
    span = gaps.groupBy("meeting_id").agg(F.least(F.lit(15.0), F.greatest(F.lit(2.0), F.percentile("gap", F.lit(0.5)))).alias("span"))
    out = items.withColumn("next", F.lead("start").over(order)).join(span, "meeting_id", "left")
    out = out.join(ends.select("meeting_id", "end_sec"), "meeting_id", "left") if ends is not None else out.withColumn("end_sec", F.lit(None).cast("double"))
    filled = F.coalesce(F.col("end").cast("double"), F.col("next").cast("double"), F.when(F.col("end_sec") > F.col("start"), F.col("end_sec").cast("double")), F.col("start") + F.coalesce("span", F.lit(5.0)))
    problem = F.when(F.col("start").isNull(), "no start").when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text")
    return out.withColumn("end", filled).withColumn("problem", problem).drop("next", "span", "end_sec")


def uniform_words(words: DataFrame, least: int = 4, low: float = 0.4, high: float = 1.2, variance: float = 0.05) -> DataFrame:
    """(meeting_id, seg_idx, flagged): ``least`` words in a row, each of ``low`` to ``high`` seconds, of nearly one length.

    Words without times stay as rows that break a run.
    """
    length = F.col("end") - F.col("start")
    run = Window.partitionBy("meeting_id", "seg_idx").orderBy("word_idx").rowsBetween(1 - least, 0)
    marked = words.withColumn("__ok", F.coalesce(length.between(low, high), F.lit(False))).withColumn("__length", length)
    hit = (F.count_if(F.col("__ok")).over(run) == least) & (F.var_pop("__length").over(run) < variance)
    return marked.withColumn("__hit", hit).groupBy("meeting_id", "seg_idx").agg(F.bool_or(F.coalesce("__hit", F.lit(False))).alias("flagged"))


def record_order(*ties: str) -> list[Column]:
    """Records by start, missing ones last, then end, which is the start where it is missing, then speaker."""
    return [F.asc_nulls_last("start"), F.coalesce("end", "start"), F.coalesce("speaker", F.lit(UNKNOWN)), *(F.col(t) for t in ties)]


def sorted_words(words: Column) -> Column:
    """An array of words in the order of records; equal ones stay as they were."""
    ranked = F.transform(words, lambda w, k: F.struct(w.start.isNull().alias("z"), w.start.alias("s"), F.coalesce(w.end, w.start).alias("e"), F.coalesce(w.speaker, F.lit(UNKNOWN)).alias("p"), k.alias("k"), w.alias("w")))
    return F.transform(F.array_sort(ranked), lambda x: x.w)


def merge_turns(segments: DataFrame, gap: float = 0.35, width: float = WIDTH) -> DataFrame:
    """Consecutive segments of one speaker as one, where the next starts ``gap`` or less after the furthest end so far.

    Sorted by (start, end, speaker). Texts are joined, dashes that begin the right one dropped; ``words``, if there are any,
    are put together and sorted; confidence low and source ctc_fallback win, else the first that there is. Gaps and islands:
    runs of a speaker first, then breaks within them, each by a scan over slots of ``width``, so that a meeting's segments may
    be in many tasks; only those of one turn meet.
    """
    return put_together(in_turns(segments, gap, width))


def in_turns(segments: DataFrame, gap: float, width: float = WIDTH) -> DataFrame:
    """``segments`` with ``__island``, the turn that ``merge_turns`` puts each into; of theirs it reads times, speakers and seg_idx."""
    s = segments.withColumn("speaker", F.coalesce("speaker", F.lit(UNKNOWN))).withColumn("__slot", slot_of(F.col("start"), width))
    order = record_order("seg_idx")
    near = Window.partitionBy("meeting_id", "__slot").orderBy(*order)
    s = s.withColumn("__last", F.lag("speaker").over(near))
    s = s.withColumn("__own", F.sum(F.coalesce((F.col("__last") != F.col("speaker")).cast("int"), F.lit(0))).over(near))  # runs within the slot, from 0
    before = Window.partitionBy("meeting_id", "__slot", "__own").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__reach", F.max("end").over(before))
    # a row for each slot: its first and last run's speakers, how many runs it adds, how far the last one reaches, and the last
    # start in the first run that is a break unless what comes from before reaches further
    wide = F.col("start") - F.col("__reach") > gap
    slots = s.groupBy("meeting_id", "__slot").agg(F.min_by("speaker", "__own").alias("first"), F.max_by("speaker", "__own").alias("last"), F.max("__own").alias("more"), F.max(F.struct("__own", "end"))["end"].alias("tail"), F.max(F.when((F.col("__own") == 0) & F.coalesce(wide, F.lit(True)), F.col("start"))).alias("breaks"), F.coalesce(F.bool_or((F.col("__own") == 0) & wide), F.lit(False)).alias("broken"))
    along = Window.partitionBy("meeting_id").orderBy("__slot")
    slots = slots.withColumn("__new", F.coalesce((F.lag("last").over(along) != F.col("first")).cast("int"), F.lit(1)))
    slots = slots.withColumn("run", F.sum(F.col("__new") + F.col("more")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    slots = slots.withColumn("far", F.max("tail").over(Window.partitionBy("meeting_id", "run").orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0)))
    slots = slots.withColumn("__carried", F.when(F.col("__new") == 0, F.lag("far").over(along)))
    opens = (F.col("__new") == 1) | (F.col("more") > 0) | F.coalesce(F.col("breaks") - F.col("__carried") > gap, F.col("broken"))
    home = F.last(F.when(opens, F.col("__slot")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    s = s.join(slots.select("meeting_id", "__slot", "__new", "__carried", home.alias("__home")), ["meeting_id", "__slot"], "left")
    s = s.withColumn("__reach", F.greatest("__reach", F.when(F.col("__own") == 0, F.col("__carried"))))
    new = F.when(F.col("__last").isNull(), F.col("__new")).otherwise((F.col("__last") != F.col("speaker")).cast("int"))
    s = s.withColumn("__break", F.when(F.col("start") - F.col("__reach") > gap, 1).otherwise(new))
    s = s.withColumn("__so_far", F.sum("__break").over(near)).withColumn("__all", F.sum("__break").over(Window.partitionBy("meeting_id", "__slot")))
    # a turn is known by the slot that it begins in and its number there from the end, so that the last one is 0 wherever it goes on
    s = s.withColumn("__island", F.when(F.col("__so_far") > 0, F.struct(F.col("__slot").alias("slot"), (F.col("__all") - F.col("__so_far")).alias("k"))).otherwise(F.struct(F.col("__home").alias("slot"), F.lit(0).cast("long").alias("k"))))
    return s.select(*segments.columns, "__island")


def put_together(segments: DataFrame) -> DataFrame:
    """Segments of one ``__island`` as one."""
    s = segments.withColumn("__n", F.struct(F.col("start").isNull().alias("z"), "start", F.coalesce("end", "start").alias("e"), "seg_idx"))
    one = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__n")))
    inner = F.coalesce("words", F.array().cast(segments.schema["words"].dataType)) if "words" in segments.columns else F.lit(None)
    parts = F.array_sort(F.collect_list(F.struct("__n", F.coalesce("text", F.lit("")).alias("t"), inner.alias("w"))))
    extra = [c for c in ("confidence", "source") if c in segments.columns]
    wins = {"confidence": "low", "source": "ctc_fallback"}
    out = s.groupBy("meeting_id", "__island").agg(F.min("seg_idx").alias("seg_idx"), F.first("speaker").alias("speaker"), F.min_by("start", "__n").alias("start"), F.max("end").alias("end"), parts.alias("__parts"), F.count("*").alias("n_merged"), *(F.when(F.bool_or(F.coalesce(F.col(c) == wins[c], F.lit(False))), wins[c]).otherwise(one(c)).alias(c) for c in extra))
    out = out.withColumn("text", F.aggregate(F.transform("__parts", lambda x: x.t), F.lit(""), joined))
    if "words" in segments.columns:
        out = out.withColumn("words", sorted_words(F.flatten(F.transform("__parts", lambda x: x.w))))
    return out.select("meeting_id", "seg_idx", "speaker", "start", "end", "text", *(["words"] if "words" in segments.columns else []), "n_merged", *extra)


def alpha_name(n: Column) -> Column:
    """A to Z, AA to ZZ, AAA to ZZZ, of 0, 1, ..."""
    letter = lambda x: F.char(F.pmod(x, F.lit(26)) + 65)
    two, three = n - 26, n - 702
    return F.when(n < 26, letter(n)).when(n < 702, F.concat(letter(F.floor(two / 26)), letter(two))).otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26)), letter(three)))


def alpha_labels(segments: DataFrame) -> DataFrame:
    """``segments`` with ``label``: A, B, ..., Z, AA, ... by first appearance; the unknown speaker keeps its name.

    Segments come in the order of seg_idx, a segment's speaker before those of its ``words``, if it has any, whose speakers
    are replaced by their labels. A meeting's speakers and labels, not its segments, are gathered as one map.
    """
    own = F.array(F.coalesce("speaker", F.lit(UNKNOWN)))
    if "words" in segments.columns:  # one array, so that the segments' plan is read once for both
        own = F.concat(own, F.coalesce(F.transform("words", lambda w: w.speaker), F.array().cast("array<string>")))
    said = segments.select("meeting_id", "seg_idx", F.posexplode(own).alias("at", "who"))
    first = said.where(F.col("who") != UNKNOWN).groupBy("meeting_id", "who").agg(F.min(F.struct("seg_idx", "at")).alias("first"))
    named = first.select("meeting_id", "who", alpha_name(F.row_number().over(Window.partitionBy("meeting_id").orderBy("first")) - 1).alias("label"))
    maps = named.groupBy("meeting_id").agg(F.map_from_entries(F.collect_list(F.struct("who", "label"))).alias("__map"))
    out = segments.join(maps, "meeting_id", "left")
    label = lambda who: F.coalesce(F.try_element_at("__map", who), who)
    out = out.withColumn("label", label(F.coalesce("speaker", F.lit(UNKNOWN))))
    if "words" in segments.columns:
        out = out.withColumn("words", F.transform("words", lambda w: w.withField("speaker", label(w.speaker))))
    return out.drop("__map")


def fixed_windows(meetings: DataFrame, width: float) -> DataFrame:
    """(meeting_id, window_id, start, end): [0, duration) of each meeting in steps of ``width``, the last one short."""
    if width <= 0:
        raise ValueError(f"a window's width must be positive, not {width}")
    n = F.ceil(F.col("duration") / width).cast("int")
    rows = meetings.where("duration > 0").select("meeting_id", "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("window_id"))
    end = F.least(F.col("duration").cast("double"), (F.col("window_id") + 1) * F.lit(float(width)))
    return rows.select("meeting_id", "window_id", F.bround(F.col("window_id") * F.lit(float(width)), 3).alias("start"), F.bround(end, 3).alias("end"))


def within_budget(rows: DataFrame, eligible: Column, budget: int, *order: str, width: float = WIDTH) -> DataFrame:
    """``rows`` with ``calls``: whether a row is one of the first ``budget`` eligible ones of its meeting.

    ``order``: columns, the first of them a number; it is cut into slots of ``width``, each counted by itself.
    """
    marked = rows.withColumn("__may", F.coalesce(eligible, F.lit(False))).withColumn("__slot", slot_of(F.col(order[0]), width))
    nulls_last = [F.asc_nulls_last(order[0]), *order[1:]]
    counted = Scan(["meeting_id"], "__slot", nulls_last).summed(marked, F.col("__may").cast("int"), "__so_far")
    return counted.withColumn("calls", F.col("__may") & (F.col("__so_far") <= budget)).drop("__may", "__slot", "__so_far")


def carried_prompt(chunks: DataFrame, most: int = 200) -> DataFrame:
    """``chunks`` (meeting_id, chunk, text) with ``prompt``: the last sentence of the chunk before, its last characters."""
    from ..functions.text import sentences

    last = F.regexp_replace(F.element_at(F.when(F.size(sentences(F.col("text"), ".!?…")) > 0, sentences(F.col("text"), ".!?…")), -1), r"^[\p{P}\s]+", "")
    return chunks.withColumn("prompt", F.lag(F.right(last, F.lit(most))).over(Window.partitionBy("meeting_id").orderBy("chunk")))


def sanitize(segments: DataFrame) -> DataFrame:
    """Segments with ``words`` put right: word ends not before starts, segments grown to cover their words.

    A missing start is the first word's, or 0; an end before the start becomes the start.
    """
    words = F.transform(F.filter("words", lambda w: w.start.isNotNull() & w.end.isNotNull()), lambda w: w.withField("end", F.greatest(w.start, w.end)))
    low, high = F.array_min(F.transform(words, lambda w: w.start)), F.array_max(F.transform(words, lambda w: w.end))
    start = F.least(F.coalesce("start", low, F.lit(0.0)), F.coalesce(low, "start", F.lit(0.0)))
    return segments.withColumn("start", start).withColumn("end", F.greatest(F.coalesce("end", "start"), "start", F.coalesce(high, "start"))).withColumn("words", words)
