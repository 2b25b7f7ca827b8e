"""Error rates of transcripts: per pair, per speaker permutation, and over a corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import edit_counts, rate, word_distance
from ..functions.text import tokens
from .intervals import BUCKET, der_sweep

EXACT_SPEAKERS = 6

#: Fixed value: unless asked for all, pairs with more cells than this have no split of their edits, only a distance.
CELLS = 5_000_000


KINDS = ("hits", "substitutions", "deletions", "insertions")


def _rates(pairs: DataFrame, profile: str | None, edits: Callable[[str, Column, Column], Column]) -> DataFrame:
    r, h = tokens(F.col("ref_text"), profile), tokens(F.col("hyp_text"), profile)
    out = pairs.withColumn("__r", r).withColumn("__h", h)
    out = out.withColumn("ref_words", F.size("__r").cast("long")).withColumn("hyp_words", F.size("__h").cast("long")).withColumn("word_edits", edits("word", F.col("__r"), F.col("__h")))
    a, b = F.array_join("__r", ""), F.array_join("__h", "")
    out = out.withColumn("ref_chars", F.length(a).cast("long")).withColumn("hyp_chars", F.length(b).cast("long")).withColumn("char_edits", edits("char", a, b))
    out = out.withColumn("wer", rate(F.col("word_edits"), F.col("ref_words"), F.col("hyp_words"))).withColumn("cer", rate(F.col("char_edits"), F.col("ref_chars"), F.col("hyp_chars")))
    return out.drop("__r", "__h")


def error_rates(pairs: DataFrame, profile: str | None = None) -> DataFrame:
    """``pairs`` (ref_text, hyp_text) with word and character edits, lengths and rates.

    From the number of edits alone substitutions, deletions and insertions don't follow; ``error_counts`` has them.
    """
    return _rates(pairs, profile, lambda _, a, b: word_distance(a, b))


def error_counts(pairs: DataFrame, profile: str | None = None, cells: int | None = CELLS) -> DataFrame:
    """``error_rates`` with the split of edits: word_hits, word_substitutions, ..., char_insertions.

    Null of pairs with more than ``cells`` cells, as of characters of longer texts; with None every pair has its split, and
    the number of edits is its sum.
    """
    r, h = tokens(F.col("ref_text"), profile), tokens(F.col("hyp_text"), profile)
    sides = {"word": (r, h), "char": (F.array_join(r, ""), F.array_join(h, ""))}
    if cells is None:
        split = pairs.withColumns({f"__{side}": edit_counts(a, b) for side, (a, b) in sides.items()})
        total = lambda side: sum((F.col(f"__{side}.{k}") for k in KINDS[2:]), F.col(f"__{side}.{KINDS[1]}"))
        out = _rates(split, profile, lambda side, *_: total(side))
    else:
        few = {side: F.col(f"ref_{side}s") * F.col(f"hyp_{side}s") <= cells for side in sides}
        out = error_rates(pairs, profile).withColumns({f"__{side}": F.when(few[side], edit_counts(F.when(few[side], a), F.when(few[side], b))) for side, (a, b) in sides.items()})
    return out.withColumns({f"{side}_{k}": F.col(f"__{side}.{k}") for side in sides for k in KINDS}).drop("__word", "__char")


def corpus_aggregate(items: DataFrame, *by: str) -> DataFrame:
    """Macro means of wer and cer, and micro rates of pooled edits and lengths; micro is null if an item has no edits."""
    micro = lambda e, n: F.when(F.count_if(F.col(e).isNull()) == 0, F.bround(F.sum(e) / F.nullif(F.sum(n), F.lit(0)), 6))
    return items.groupBy(*by).agg(F.count("*").alias("n_items"), _mean("wer").alias("macro_wer"), _mean("cer").alias("macro_cer"), micro("word_edits", "ref_words").alias("micro_wer"), micro("char_edits", "ref_chars").alias("micro_cer"))


def _mean(c: str) -> Column:
    """Over whole millionths, so that no order of summing changes a digit; null of no values."""
    return F.bround(F.sum(F.round(F.col(c) * 1_000_000).cast("long")) / F.count(c), 0) / 1_000_000


def corpus_scores(items: DataFrame, *by: str) -> DataFrame:
    """Whole-corpus scores of items with ``error_counts`` and, where known, cp_wer and der.

    Macro means; micro rates of pooled substitutions, deletions and insertions, null if an item lacks the split; the pooled
    counts themselves; means of cp_wer and der over the items that have them, null if none has.
    """
    for c in ("cp_wer", "der"):
        items = items if c in items.columns else items.withColumn(c, F.lit(None).cast("double"))
    kinds = KINDS[1:]
    edits = lambda side: sum((F.sum(f"{side}_{k}") for k in kinds[1:]), F.sum(f"{side}_{kinds[0]}"))
    whole = lambda side: F.count_if(F.col(f"{side}_substitutions").isNull()) == 0
    micro = lambda side: F.when(whole(side), F.bround(edits(side) / F.nullif(F.sum(f"ref_{side}s"), F.lit(0)), 6))
    pooled = [F.when(whole(side), F.sum(f"{side}_{k}")).alias(f"{side}_{k}") for side in ("word", "char") for k in kinds]
    return items.groupBy(*by).agg(F.count("*").alias("n_items"), _mean("wer").alias("macro_wer"), _mean("cer").alias("macro_cer"), micro("word").alias("micro_wer"), micro("char").alias("micro_cer"), *pooled, F.sum("ref_words").alias("ref_words"), F.sum("ref_chars").alias("ref_chars"), _mean("cp_wer").alias("macro_cp_wer"), _mean("der").alias("mean_der"))


def by_speaker(segments: DataFrame) -> DataFrame:
    """(meeting_id, speaker, text, first): trimmed, non-empty texts of each speaker in order, joined by spaces."""
    clean = segments.withColumn("text", F.trim("text")).where("text <> ''").withColumn("speaker", F.coalesce(F.nullif("speaker", F.lit("")), F.lit("UNKNOWN")))
    return clean.groupBy("meeting_id", "speaker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x.text), " ").alias("text"), F.min("seg_idx").alias("first"))


def flat_text(segments: DataFrame) -> DataFrame:
    """(meeting_id, text): all texts of a meeting in order."""
    return segments.where("trim(text) <> ''").groupBy("meeting_id").agg(F.expr("listagg(trim(text), ' ') WITHIN GROUP (ORDER BY seg_idx)").alias("text"))


def cp_wer(reference: DataFrame, hypothesis: DataFrame, profile: str | None = None) -> DataFrame:
    """(meeting_id, edits, ref_words, cp_wer, exact, mapping): least edits over all ways to match speakers.

    Inputs are segments. Speakers, in order of appearance, are padded to as many on each side; up to six are searched
    exactly, the first minimum in order of permutations winning; beyond, each reference speaker in turn takes the cheapest
    hypothesis speaker left. Meetings with texts on one side only count, too.
    """
    r = by_speaker(reference).select("meeting_id", F.col("speaker").alias("ref"), tokens(F.col("text"), profile).alias("rw"), F.col("first").alias("rf"))
    h = by_speaker(hypothesis).select("meeting_id", F.col("speaker").alias("hyp"), tokens(F.col("text"), profile).alias("hw"), F.col("first").alias("hf"))
    pairs = r.join(h, "meeting_id").select("meeting_id", "ref", "hyp", word_distance(F.col("rw"), F.col("hw")).alias("cost"))
    sides = r.select("meeting_id", F.lit("r").alias("side"), F.col("ref").alias("name"), F.col("rf").alias("first"), F.size("rw").alias("n")).union(h.select("meeting_id", F.lit("h"), "hyp", "hf", F.size("hw")))
    costs = pairs.groupBy("meeting_id").agg(F.collect_list(F.struct("ref", "hyp", "cost")).alias("costs"))
    packed = sides.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("side", "first", "name", "n"))).alias("sides")).join(costs, "meeting_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for meeting, sides, costs in zip(pdf.meeting_id, pdf.sides, pdf.costs, strict=True):
                ref, hyp = ([s for s in sides if s["side"] == c] for c in "rh")
                cost = {(c["ref"], c["hyp"]): c["cost"] for c in (costs if costs is not None else [])}
                out.append((meeting, *match(ref, hyp, cost)))
            yield pd.DataFrame(out, columns=["meeting_id", "edits", "ref_words", "cp_wer", "exact", "mapping"])

    kind = dict(packed.dtypes)["meeting_id"]
    return packed.mapInPandas(run, f"meeting_id {kind}, edits long, ref_words long, cp_wer double, exact boolean, mapping map<string,string>")


def match(ref: list, hyp: list, cost: dict) -> tuple[int, int, float, bool, dict[str, str]]:
    size = max(len(ref), len(hyp))
    words = int(sum(s["n"] for s in ref))

    def price(i: int, j: int) -> int:
        if i < len(ref) and j < len(hyp):
            return int(cost[ref[i]["name"], hyp[j]["name"]])
        return int(ref[i]["n"]) if i < len(ref) else int(hyp[j]["n"]) if j < len(hyp) else 0

    exact = size <= EXACT_SPEAKERS
    if exact:
        order = min(permutations(range(size)), key=lambda p: sum(price(i, j) for i, j in enumerate(p)))
    else:
        left, order = list(range(size)), []
        for i in range(size):
            order.append(min(left, key=lambda j: price(i, j)))
            left.remove(order[-1])
    edits = sum(price(i, j) for i, j in enumerate(order))
    names = {hyp[j]["name"]: ref[i]["name"] if i < len(ref) else "" for i, j in enumerate(order) if j < len(hyp)}
    return edits, words, round(edits / words, 6) if words else float(edits > 0), exact, names


def best_total(weights: DataFrame) -> DataFrame:
    """(meeting_id, best): the largest sum of weights (meeting_id, ref, hyp, weight) with each ref and hyp used once.

    By shortest augmenting paths (Hungarian method), so time grows with the cube of a meeting's speakers.
    """
    packed = weights.groupBy("meeting_id").agg(F.collect_list(F.struct("ref", "hyp", F.col("weight").cast("double").alias("weight"))).alias("w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for meeting, w in zip(pdf.meeting_id, pdf.w, strict=True):
                refs, hyps = ({name: k for k, name in enumerate(sorted({x[side] for x in w}))} for side in ("ref", "hyp"))
                gain = np.zeros((len(refs), len(hyps)))
                for x in w:
                    gain[refs[x["ref"]], hyps[x["hyp"]]] += x["weight"]
                out.append((meeting, assignment(gain)))
            yield pd.DataFrame(out, columns=["meeting_id", "best"])

    return packed.mapInPandas(run, f"meeting_id {dict(packed.dtypes)['meeting_id']}, best double")


def assignment(gain: np.ndarray) -> float:
    """The largest sum of non-negative gains with each row and column used once.

    Rows are added one by one. Each looks for the cheapest way to a free column, over columns that are taken and whose rows
    would move on; prices of rows and columns keep all costs at 0 or more.
    """
    if gain.shape[0] > gain.shape[1]:
        gain = gain.T
    cost = gain.max(initial=0.0) - gain
    n, m = cost.shape
    row_price, column_price, taken = np.zeros(n), np.zeros(m), np.full(m, -1)
    for new in range(n):
        far, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, column, reached = new, -1, 0.0
        while True:
            way = reached + cost[row] - row_price[row] - column_price
            shorter = ~done & (way < far)
            far[shorter], before[shorter] = way[shorter], column
            column = int(np.argmin(np.where(done, np.inf, far)))
            reached, done[column] = far[column], True
            if taken[column] < 0:
                break
            row = taken[column]
        seen = np.flatnonzero(done & (taken >= 0))
        row_price[new] += reached
        row_price[taken[seen]] += reached - far[seen]
        column_price[done] -= reached - far[done]
        while column >= 0:
            taken[column] = taken[before[column]] if before[column] >= 0 else new
            column = before[column]
    used = taken >= 0
    return float(gain[taken[used], np.flatnonzero(used)].sum())


def score_transcripts(reference: DataFrame, hypothesis: DataFrame, profile: str | None = None, bucket: float | None = BUCKET, split: bool = False) -> DataFrame:
    """Each meeting's wer and cer over whole texts, cp_wer, der, and why any of these was left out.

    Inputs: segments (meeting_id, seg_idx, speaker, start, end, text). Meetings of ``reference`` without a hypothesis have
    an empty one. With ``split``, also the counts of ``error_counts``, of texts of any length.
    """
    able = reference.groupBy("meeting_id").agg(F.bool_or(F.coalesce(F.col("speaker") != "", F.lit(False))).alias("has_speakers"), F.bool_and(F.col("start").isNotNull()).alias("has_times"))
    texts = able.join(flat_text(reference).withColumnRenamed("text", "ref_text"), "meeting_id", "left").join(flat_text(hypothesis).withColumnRenamed("text", "hyp_text"), "meeting_id", "left")
    texts = texts.join(hypothesis.groupBy("meeting_id").agg(F.lit(True).alias("heard")), "meeting_id", "left")
    texts = texts.fillna("", ["ref_text", "hyp_text"])
    scores = (error_counts(texts, profile, cells=None) if split else error_rates(texts, profile)).drop("ref_text", "hyp_text")
    cp = cp_wer(reference, hypothesis, profile).select("meeting_id", "cp_wer")
    named = lambda df: df.withColumn("speaker", F.coalesce(F.nullif("speaker", F.lit("")), F.lit("UNKNOWN")))
    sweep = der_sweep(named(reference), named(hypothesis), bucket).select("meeting_id", "der")
    out = scores.join(cp, "meeting_id", "left").join(sweep, "meeting_id", "left")
    talk = F.col("has_speakers") & F.coalesce("heard", F.lit(False))
    out = out.withColumn("cp_wer", F.when(talk, F.coalesce("cp_wer", F.lit(0.0)))).withColumn("der", F.when(F.col("has_times"), F.col("der")))
    why = F.array_compact(F.array(
        F.when(~F.col("has_speakers"), "cp_wer: reference has no speaker labels").when(~talk, "cp_wer: empty hypothesis"),
        F.when(~F.col("has_times"), "der: reference has no segment timings").when(F.col("der").isNull(), "der: empty reference"),
    ))
    return out.withColumn("skipped", why).drop("has_speakers", "has_times", "heard")
