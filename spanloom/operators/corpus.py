"""Weighted text corpora, vocabularies and training pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import VOCABULARY, content_tokens, plain_sentences, sentences, source_ratio, squeeze
from .intervals import BUCKET, window_text
from .windows import fixed_windows


def corpus_sentences(texts: DataFrame, limit: int | None = None) -> DataFrame:
    """Sentences (label, weight, doc_id, pos, sentence) of texts (label, weight, doc_id, text); weights must be positive.

    limit: the first sentences over all groups, by (label, doc_id, pos): one top-n, not a sort of all.
    """
    checked = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.raise_error(F.concat(F.lit("weight not positive: "), F.col("label"))).cast("int"))
    out = texts.select("label", checked.alias("weight"), "doc_id", F.posexplode(plain_sentences(F.col("text"))).alias("pos", "sentence"))
    return out if limit is None else out.orderBy("label", "doc_id", "pos").limit(limit)


def group_stats(sentences_: DataFrame) -> DataFrame:
    return sentences_.groupBy("label").agg(F.max("weight").alias("weight"), F.count("*").alias("raw_sentences"), F.sum("weight").cast("long").alias("weighted_sentences"))


def repeated(sentences_: DataFrame) -> DataFrame:
    """Each sentence as often as its weight."""
    return sentences_.select("label", "doc_id", "pos", "sentence", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))).alias("copy"))


def vocabulary(sentences_: DataFrame, top: int | None = None) -> DataFrame:
    """(token, n): words and punctuation counted by weight; ``top``: the most frequent, ties by token."""
    counts = sentences_.select("weight", F.explode(F.regexp_extract_all("sentence", F.lit(VOCABULARY), 0)).alias("token")).groupBy("token").agg(F.sum("weight").cast("long").alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), "token").limit(top)


def fixed_pairs(meetings: DataFrame, whisper: DataFrame, ctc: DataFrame, clean: DataFrame, width: float = 30.0, bucket: float | None = BUCKET) -> DataFrame:
    """Three texts of each fixed window in which none is empty."""
    w = fixed_windows(meetings, width)
    out = w
    for name, segments in (("whisper", whisper), ("ctc", ctc), ("clean", clean)):
        out = out.join(window_text(w, segments, bucket=bucket).select("meeting_id", "window_id", F.col("text").alias(name)), ["meeting_id", "window_id"])
    return out.where("whisper <> '' and ctc <> '' and clean <> ''")


#: Runs of sentences that are scored at a time.
_RUNS = 65_536


def best_run(lengths: np.ndarray, words: np.ndarray, source: np.ndarray, target: int) -> tuple[int, int] | None:
    """The run (first, last) of sentences whose words ``source`` has most of, less a quarter of the relative difference of
    their number from ``target``; the first of equal runs, None without words.

    Words are numbers, those of all sentences after each other. A word counts in a run that begins behind the last sentence
    before with the same word, so different words of all runs are running sums, and no run's words are gone through.
    """
    n, at = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
    if not len(words):
        return None
    order = np.argsort(words, kind="stable")
    w, s = words[order], at[order]
    before = np.where(np.append(False, w[1:] == w[:-1]), np.append(-1, s[:-1]), -1)
    first = before < s  # not of a word's second place in a sentence
    begin, place, known = before[first] + 1, s[first], np.isin(w[first], source)
    upto, carried, top, best = np.append(0, np.cumsum(lengths)), np.zeros((2, n), np.int64), -np.inf, None
    for i in range(0, n, max(1, _RUNS // n)):
        rows = np.arange(i, min(n, i + max(1, _RUNS // n)))
        here, runs = (begin >= i) & (begin <= rows[-1]), np.arange(n) >= rows[:, None]
        sums = []
        for k, which in enumerate((here, here & known)):
            new = np.bincount((begin[which] - i) * n + place[which], minlength=len(rows) * n).reshape(len(rows), n)
            new[0] += carried[k]
            new = np.cumsum(new, axis=0)
            carried[k] = new[-1]
            sums.append(np.cumsum(np.where(runs, new, 0), axis=1))
        total = upto[1:] - upto[rows][:, None]
        score = sums[1] / np.maximum(sums[0], 1) - 0.25 * np.abs(total - target) / np.maximum(total, 1)
        score = np.where(runs & (total > 0), score, -np.inf)
        x, y = np.unravel_index(np.argmax(score), score.shape)
        if score[x, y] > top:
            top, best = score[x, y], (int(rows[x]), int(y))
    return best


def _best_runs(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    kind = pa.struct([("i", pa.int32()), ("j", pa.int32())])
    ends = lambda lists: np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    for words, source, target in batches:  # texts' words as numbers, the same for the same word
        parts = words.flatten()
        said, known = parts.flatten(), source.flatten()
        ids = pa.concat_arrays([said, known]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        of_text, of_part, of_source, ids, known = ends(words), ends(parts), ends(source), ids[: len(said)], ids[len(said) :]
        out = []
        for r, t in enumerate(target.to_pylist()):
            cut = of_part[of_text[r] : of_text[r + 1] + 1]
            out.append(best_run(np.diff(cut), ids[cut[0] : cut[-1]], known[of_source[r] : of_source[r + 1]], t))
        yield pa.array([{"i": x[0], "j": x[1]} if x else None for x in out], kind)


def best_slice(texts: DataFrame) -> DataFrame:
    """``texts`` (clean, ctc, whisper) with ``clean`` as the run of its sentences that the sources support best, less a quarter
    of the relative difference in length, and the content words of all three as ``clean_words``, ``ctc_words``, ``whisper_words``.

    The first of equal runs; the whole text if it has one sentence, or the sources no words. Words are found once for each
    text, and runs are scored by an Arrow UDF.
    """
    out = texts.withColumns({"ctc_words": content_tokens(F.col("ctc")), "whisper_words": content_tokens(F.col("whisper")), "__parts": sentences(F.col("clean"), ".!?…")})
    out = out.withColumn("__words", F.transform("__parts", content_tokens))
    source = F.array_distinct(F.concat("ctc_words", "whisper_words"))
    scored = F.arrow_udf(_best_runs, "struct<i:int,j:int>").asNondeterministic()  # else conditions on the text work it out again
    some = (F.size("__parts") > 1) & ((F.size("ctc_words") > 0) | (F.size("whisper_words") > 0))
    out = out.withColumn("__run", scored(F.when(some, F.col("__words")), source, F.greatest(F.size("ctc_words"), F.size("whisper_words"), F.lit(1))))
    picked = lambda x: F.slice(x, F.col("__run.i") + 1, F.col("__run.j") - F.col("__run.i") + 1)
    none = F.col("__run").isNull()
    clean = F.when(none, squeeze(F.col("clean"))).otherwise(F.array_join(picked("__parts"), " "))
    words = F.flatten(F.when(none, F.col("__words")).otherwise(picked("__words")))
    return out.withColumns({"clean": clean, "clean_words": words}).drop("__parts", "__words", "__run")


def primary_pairs(whisper: DataFrame, ctc: DataFrame, clean: DataFrame, bucket: float | None = BUCKET) -> DataFrame:
    """Training pairs on the first transcript's segments, filtered by length and support; ids count all its segments."""
    base = whisper.withColumn("n", F.row_number().over(Window.partitionBy("meeting_id").orderBy("start", "end", "seg_idx")) - 1)
    w = base.select("meeting_id", F.col("seg_idx").alias("window_id"), "start", "end", "n", squeeze(F.col("text")).alias("whisper"))
    out = w
    for name, segments in (("ctc", ctc), ("clean", clean)):
        out = out.join(window_text(w.select("meeting_id", "window_id", "start", "end"), segments, bucket=bucket).select("meeting_id", "window_id", F.col("text").alias(name)), ["meeting_id", "window_id"])
    out = best_slice(out.where("whisper <> '' and ctc <> '' and clean <> ''"))
    a, b, c = (F.col(f"{x}_words") for x in ("whisper", "ctc", "clean"))
    good = (F.size(a) > 0) & (F.size(b) > 0) & (F.size(c) > 0) & (F.size(c) <= F.greatest(F.size(a), F.size(b)) + 6) & (source_ratio(F.array_distinct(c), a, b) >= 0.35)
    return out.where(good).select("meeting_id", F.format_string("segment_%04d", "n").alias("chunk_id"), "start", "end", "ctc", "whisper", "clean")
