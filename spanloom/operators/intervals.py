"""Joins of time intervals within meetings.

Every join has the meeting and a bucket of time as its equality keys, so it is a hash or sort-merge join with the overlap
as a condition, and a meeting of any length is compared piece by piece. ``bucket`` is a length of time in the unit of the
tables, seconds by default; None compares whole meetings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, squeeze
from ..model import UNKNOWN
from .scans import WIDTH, Scan, slot_of


def overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end, other_end) - F.greatest(start, other_start))


BUCKET = 60.0


def _slots(start: str, end: str, bucket: float) -> Column:
    return F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket)))


def overlapping(left: DataFrame, right: DataFrame, key: list[str], bucket: float | None = None, touching: bool = False) -> DataFrame:
    """Rows of ``left`` (key, start, end) with each row of ``right`` (key, r_start, r_end) that overlaps for more than 0.

    Pairs that share several buckets are kept in the first one only. ``touching``: also those that share but a point.
    """
    if touching:
        left, right = left.where("start <= end"), right.where("r_start <= r_end")
        meets = (F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end"))
    else:
        left, right = left.where("start < end"), right.where("r_start < r_end")
        meets = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    if bucket is None:
        return left.join(right, [left[k] == right[k] for k in key] + [meets]).drop(*(right[k] for k in key))
    l, r = left.withColumn("__slot", _slots("start", "end", bucket)), right.withColumn("__r_slot", _slots("r_start", "r_end", bucket))
    first = F.floor(F.greatest("start", "r_start") / bucket) == F.col("__slot")
    met = l.join(r, [l[k] == r[k] for k in key] + [F.col("__slot") == F.col("__r_slot"), meets, first])
    return met.drop(*(r[k] for k in key)).drop("__slot", "__r_slot")


def window_text(windows: DataFrame, segments: DataFrame, words: DataFrame | None = None, bucket: float | None = BUCKET) -> DataFrame:
    """``windows`` (meeting_id, window_id, start, end) with ``text``: that of all overlapping segments, in order.

    A segment (meeting_id, seg_idx, start, end, text) gives its overlapping timed words (meeting_id, seg_idx, word_idx,
    start, end, word) if there are any, else its whole text. Windows without text have an empty one.
    """
    seg = segments.select("meeting_id", "seg_idx", F.coalesce("start", F.lit(0)).alias("r_start"), F.coalesce("end", "start", F.lit(0)).alias("r_end"), squeeze(F.col("text")).alias("r_text"))
    if words is not None:  # a segment's words as one array beside its text, so that no row is a word with a text of its own
        w = words.where("start < end").select("meeting_id", "seg_idx", F.struct("word_idx", squeeze(F.col("word")).alias("word"), "start", "end").alias("w")).where("w.word <> ''")
        seg = seg.join(w.groupBy("meeting_id", "seg_idx").agg(F.array_sort(F.collect_list("w")).alias("r_words")), ["meeting_id", "seg_idx"], "left")
    met = overlapping(windows.select("meeting_id", "window_id", "start", "end"), seg, ["meeting_id"], bucket)
    if words is not None:
        inside = F.filter("r_words", lambda w: (w.start < F.col("end")) & (F.col("start") < w.end))
        spoken = F.array_join(F.transform(inside, lambda w: w.word), " ")
        met = met.withColumn("r_text", F.coalesce(F.nullif(spoken, F.lit("")), "r_text")).drop("r_words")
    pieces = F.array_sort(F.collect_list(F.when(F.col("r_text") != "", F.struct("r_start", "r_end", "r_text", "seg_idx"))))
    text = met.groupBy("meeting_id", "window_id").agg(F.array_join(F.transform(pieces, lambda p: p.r_text), " ").alias("text"))
    return windows.join(text, ["meeting_id", "window_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def _named(diarization: DataFrame) -> DataFrame:
    return diarization.select("meeting_id", F.coalesce("speaker", F.lit(UNKNOWN)).alias("who"), F.coalesce("start", F.lit(0)).alias("r_start"), F.coalesce("end", "start", F.lit(0)).alias("r_end"))


def speakers(spans: DataFrame, diarization: DataFrame, bucket: float | None = BUCKET) -> DataFrame:
    """``spans`` (meeting_id, span_id, start, end) with ``speaker``: who overlaps longest, ties to the last name.

    Overlap of 0 is nobody's. A span without length takes the first record, by (start, end, speaker), that holds its point.
    """
    d = _named(diarization)
    s = spans.select("meeting_id", "span_id", "start", "end")
    total = overlapping(s, d, ["meeting_id"], bucket).groupBy("meeting_id", "span_id", "who").agg(F.sum(overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).alias("share"))
    best = total.where("share > 0").groupBy("meeting_id", "span_id").agg(F.max_by("who", F.struct("share", "who")).alias("speaker"))
    inside = (F.col("start") >= F.col("r_start")) & (F.col("start") <= F.col("r_end"))
    point = _within(s.where("end <= start"), "start", d.where("r_start <= r_end"), "r_start", "r_end", inside, bucket)
    held = point.groupBy("meeting_id", "span_id").agg(F.min_by("who", F.struct("r_start", "r_end", "who")).alias("speaker"))
    return spans.join(best.unionByName(held), ["meeting_id", "span_id"], "left").withColumn("speaker", F.coalesce("speaker", F.lit(UNKNOWN)))


def _within(points: DataFrame, at: str, spans: DataFrame, start: str, end: str, inside: Column, bucket: float | None) -> DataFrame:
    """Rows of ``points`` with each row of ``spans`` of the same meeting that holds their time, by ``inside``."""
    p, q = points, spans
    on = [p["meeting_id"] == q["meeting_id"]]
    if bucket is not None:
        p, q = points.withColumn("__p", F.floor(F.col(at) / bucket)), spans.withColumn("__q", _slots(start, end, bucket))
        on = [p["meeting_id"] == q["meeting_id"], F.col("__p") == F.col("__q")]
    return p.join(q, [*on, inside]).drop(q["meeting_id"]).drop("__p", "__q")


def segment_speakers(segments: DataFrame, words: DataFrame, diarization: DataFrame, bucket: float | None = BUCKET) -> DataFrame:
    """``segments`` with ``speaker``: of its timed words' speakers the one with the longest words, else by ``speakers``.

    Unknown competes like others; ties go to the last name.
    """
    listed, speaker = spoken_words(words.select("meeting_id", "seg_idx", "word_idx", "start", "end"), diarization, bucket)
    told = F.transform("words", lambda w: F.struct(speaker(w).alias("speaker"), lasts(w).alias("lasts")))
    return _by_words(segments, listed.select("meeting_id", "seg_idx", told.alias("words")), diarization, bucket).drop("words")


def lasts(w: Column) -> Column:
    return F.greatest(w["end"] - w["start"], F.lit(0))


def spoken_words(words: DataFrame, diarization: DataFrame, bucket: float | None = BUCKET) -> tuple[DataFrame, Callable[[Column], Column]]:
    """(meeting_id, seg_idx, words, near) with each segment's words as an array by word_idx, and the speaker of such a word, by
    the rule of ``speakers``, as a column of these rows; null without both times.

    A word is never a row of a shuffle of its own: the words of a segment that start in one bucket are a piece, of which only
    the span is joined with intervals; a word is held against those of its piece.
    """
    keys = ["meeting_id", "seg_idx"]
    piece = lambda start: F.lit(0).cast("long") if bucket is None else F.floor(start / bucket)
    listed = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*(c for c in ("word_idx", "word", "start", "end", "score") if c in words.columns)))).alias("words"))
    timed = words.where("start is not null and end is not null")
    pieces = timed.groupBy(*keys, piece(F.col("start")).alias("piece")).agg(F.min("start").alias("start"), F.max(F.greatest("start", "end")).alias("end"))
    met = overlapping(pieces, _named(diarization), ["meeting_id"], bucket, touching=True)
    total = met.agg(F.sum(overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")))).schema[0].dataType
    near = met.groupBy(*keys, "piece").agg(F.array_sort(F.collect_list(F.struct("r_start", "r_end", "who"))).alias("near"))
    near = near.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("piece", "near"))).alias("near"))

    def longest(w: Column, met: Column) -> Column:
        share = lambda who: F.aggregate(met, F.lit(0).cast(total), lambda sum_, x: (sum_ + F.when(x.who == who, overlap(w.start, w.end, x.r_start, x.r_end)).otherwise(0)).cast(total))
        shares = F.transform(F.array_distinct(F.transform(met, lambda x: x.who)), lambda who: F.struct(share(who).alias("share"), who.alias("who")))
        return F.when(F.size(met) < 2, F.get(met, F.lit(0))["who"]).otherwise(F.array_max(shares)["who"])

    def speaker(w: Column) -> Column:
        held = F.try_element_at("near", piece(w.start))
        over = F.filter(held, lambda x: (x.r_start < x.r_end) & (w.start < x.r_end) & (x.r_start < w.end))
        point = F.filter(held, lambda x: (x.r_start <= w.start) & (w.start <= x.r_end))
        best = F.when(w.start < w.end, bound(over, lambda met: longest(w, met))).otherwise(F.get(point, F.lit(0))["who"])
        return F.when(w.start.isNotNull() & w.end.isNotNull(), F.coalesce(best, F.lit(UNKNOWN)))

    return listed.join(near, keys, "left"), speaker


def _by_words(segments: DataFrame, told: DataFrame, diarization: DataFrame, bucket: float | None) -> DataFrame:
    """``segments`` with ``speaker``, and ``words`` of ``told`` (meeting_id, seg_idx, words with speaker and lasts)."""
    total = told.select(F.inline("words")).agg(F.sum("lasts")).schema[0].dataType
    timed = F.filter("words", lambda w: w.speaker.isNotNull())
    share = lambda who, own: F.aggregate(own, F.lit(0).cast(total), lambda sum_, w: (sum_ + F.when(w.speaker == who, w.lasts).otherwise(0)).cast(total))
    top = bound(timed, lambda own: F.array_max(F.transform(F.array_distinct(F.transform(own, lambda w: w.speaker)), lambda who: F.struct(share(who, own).alias("share"), who.alias("speaker")))))
    best = told.select("meeting_id", "seg_idx", "words", bound(top, lambda x: F.when(x.share > 0, x.speaker)).alias("by_words"))
    whole = speakers(segments.drop("speaker").withColumn("span_id", F.col("seg_idx")), diarization, bucket).drop("span_id")
    return whole.join(best, ["meeting_id", "seg_idx"], "left").withColumn("speaker", F.coalesce("by_words", "speaker")).drop("by_words")


def contained(segments: DataFrame, words: DataFrame, bucket: float | None = BUCKET) -> DataFrame:
    """``segments`` with ``text`` from the words wholly inside where it is blank."""
    w = words.select("meeting_id", "word_idx", F.col("start").alias("w_start"), F.col("end").alias("w_end"), "word").where("w_start is not null")
    spans = segments.select("meeting_id", "seg_idx", "start", "end").where("start <= end")
    inside = (F.col("w_start") >= F.col("start")) & (F.col("w_end") <= F.col("end"))
    met = _within(w, "w_start", spans, "start", "end", inside, bucket)
    said = met.groupBy("meeting_id", "seg_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w_start", "word_idx", "word"))), lambda x: x.word), " ").alias("said"))
    text = squeeze(F.col("text"))
    return segments.join(said, ["meeting_id", "seg_idx"], "left").withColumn("text", F.when(text != "", text).otherwise(F.coalesce("said", F.lit("")))).drop("said")


def segments_from_words(texts: DataFrame, segments: DataFrame, words: DataFrame, bucket: float | None = BUCKET) -> DataFrame:
    """Segments (meeting_id, seg_idx, start, end, text) of recognizer output: ``contained``, without those that stay blank.

    A meeting of ``texts`` (meeting_id, text) without any gets one from its first word's start to its last word's end, with
    its text or that of its words; without words one from 0 to 0, if it has a text.
    """
    own = contained(segments, words, bucket).where("text <> ''").select("meeting_id", "seg_idx", "start", "end", "text")
    order = F.struct("start", "word_idx")
    timed = words.where("start is not null and end is not null").groupBy("meeting_id").agg(F.min_by("start", order).alias("start"), F.max_by("end", order).alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "word_idx", "word"))), lambda x: F.trim(x.word)), " ").alias("said"))
    bare = texts.join(own.select("meeting_id").distinct(), "meeting_id", "left_anti").join(timed, "meeting_id", "left")
    made = bare.select("meeting_id", F.lit(0).cast(dict(own.dtypes)["seg_idx"]).alias("seg_idx"), F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce("end", F.lit(0.0)).alias("end"), F.coalesce(F.nullif("text", F.lit("")), "said", F.lit("")).alias("text"))
    return own.unionByName(made.where("text <> ''"))


def solid(intervals: DataFrame, width: float = WIDTH) -> DataFrame:
    """(meeting_id, side, speaker, start, end): each speaker's intervals with those that overlap or touch as one.

    ``width``: the slots of the scan, so that a speaker's intervals may be in many tasks.
    """
    scan = Scan(["meeting_id", "side", "speaker"], "slot", ["start", "end"])
    rows = scan.highest_before(intervals.withColumn("slot", slot_of(F.col("start"), width)), "end", "reach")
    new = (F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int")
    marked = scan.summed(rows, new, "run")
    return marked.groupBy("meeting_id", "side", "speaker", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def der_sweep(reference: DataFrame, hypothesis: DataFrame, bucket: float | None = BUCKET, width: float = WIDTH) -> DataFrame:
    """(meeting_id, miss, false_alarm, confusion, total, der) of speaker intervals (meeting_id, start, end, speaker).

    Between neighbouring borders, r reference and h hypothesis speakers are active: missed is max(0, r - h), false alarm
    max(0, h - r), confused min(r, h) less the matched ones. Speakers are matched one to one to give the longest joint time.
    No collar, overlap counted. Numbers of active speakers are running sums over borders, scanned in slots of ``width``,
    joint times an overlap join of both sides; a meeting's collected rows are its pairs of speakers that overlap. Meetings without a reference are left out.
    """
    from .scoring import best_total  # scores build on intervals

    clean = lambda df, side: df.where("start < end").select("meeting_id", "start", "end", F.coalesce("speaker", F.lit("UNKNOWN")).alias("speaker"), F.lit(side).alias("side"))
    both = solid(clean(reference, "r").unionByName(clean(hypothesis, "h")), width)
    step = lambda side, by: F.sum(F.when(F.col("side") == side, by).otherwise(0)).alias(side)
    borders = both.select("meeting_id", F.col("start").alias("t"), "side", F.lit(1).alias("by")).union(both.select("meeting_id", "end", "side", F.lit(-1)))
    sums = borders.groupBy("meeting_id", "t").agg(step("r", F.col("by")), step("h", F.col("by")))
    scan = Scan(["meeting_id"], "slot", ["t"])
    rows = scan.together(sums.withColumn("slot", slot_of(F.col("t"), width)), {"upto_r": F.col("r"), "upto_h": F.col("h")}, {"since": "t"})
    for side in ("r", "h"):  # as many as are active before each border
        rows = rows.withColumn(side, F.col(f"upto_{side}") - F.col(side))
    spans = rows.select("meeting_id", (F.col("t") - F.col("since")).alias("d"), "r", "h").where("d is not null")
    r, h, d = F.col("r"), F.col("h"), F.col("d")
    parts = spans.groupBy("meeting_id").agg(F.sum(F.greatest(r - h, F.lit(0)) * d).alias("miss"), F.sum(F.greatest(h - r, F.lit(0)) * d).alias("false_alarm"), F.sum(F.least(r, h) * d).alias("both"), F.sum(r * d).alias("total"))
    mine = both.where("side = 'r'").select("meeting_id", "start", "end", F.col("speaker").alias("ref"))
    other = both.where("side = 'h'").select("meeting_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("speaker").alias("hyp"))
    joint = overlapping(mine, other, ["meeting_id"], bucket).groupBy("meeting_id", "ref", "hyp").agg(F.sum(overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).alias("weight"))
    out = parts.join(best_total(joint), "meeting_id", "left").withColumn("confusion", F.col("both") - F.coalesce("best", F.lit(0)))
    return out.where("total > 0").select("meeting_id", "miss", "false_alarm", "confusion", "total", F.bround((F.col("miss") + F.col("false_alarm") + F.col("confusion")) / F.col("total"), 6).alias("der"))
