"""Experiments, reports, readers' errors and long inputs, on literal cases."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import distance
from spanloom.operators import experiments, intervals, prompts, quality, scoring, speakers, windows
from spanloom.sources import readers, reviews, writers


def test_word_distance_of_many_words(spark):
    """More distinct words in a pair than characters before the surrogates."""
    words = [f"v{k}" for k in range(55_000)]
    far = spark.createDataFrame([(words, ["v54999", "u"]), (words[54_000:], ["x", *words[54_100:], "y"])], "a array<string>, b array<string>")
    assert [r.d for r in far.select(distance.word_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [55_000, 101]


def test_split_of_edits(spark):
    """Ties go across, then to a deletion; no split of huge pairs."""
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 7))] for _ in range(2))
        ops = distance.align(a, b)

        def best(i, j, memo={}):  # noqa: B006
            key = (tuple(a[:i]), tuple(b[:j]))
            if key not in memo:
                memo[key] = i + j if not i or not j else min(best(i - 1, j - 1) + (a[i - 1] != b[j - 1]), best(i - 1, j) + 1, best(i, j - 1) + 1)
            return memo[key]

        i, j, want = len(a), len(b), []
        while i or j:
            if i and j and best(i, j) == best(i - 1, j - 1) + (a[i - 1] != b[j - 1]):
                i, j = i - 1, j - 1
                want.append("equal" if a[i] == b[j] else "replace")
            elif i and best(i, j) == best(i - 1, j) + 1:
                i -= 1
                want.append("delete")
            else:
                j -= 1
                want.append("insert")
        assert [o[0] for o in ops] == want[::-1]
    rows = spark.createDataFrame([("one two three four", "one two four five"), ("", "x y"), ("a " * 2300, "b " * 2300)], "ref_text string, hyp_text string")
    got = [(x.word_hits, x.word_substitutions, x.word_deletions, x.word_insertions, x.word_edits) for x in scoring.error_counts(rows).collect()]
    assert got == [(2, 2, 0, 0, 2), (0, 0, 0, 2, 2), (None, None, None, None, 2300)]
    whole = scoring.corpus_scores(scoring.error_counts(rows).withColumn("k", F.lit(1)), "k").first()
    assert whole.micro_wer is None and whole.macro_wer == pytest.approx((0.5 + 1 + 1) / 3, abs=1e-6) and whole.macro_cp_wer is None


def test_assignment():
    """Against all permutations, and at a size that they don't reach."""
    from itertools import permutations

    r = np.random.default_rng(2)
    for _ in range(60):
        gain = r.integers(0, 9, (r.integers(1, 6), r.integers(1, 6))).astype(float)
        n, m = gain.shape
        wide = gain if n <= m else gain.T
        want = max(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(wide.shape[1]), wide.shape[0]))
        assert scoring.assignment(gain) == want
    big = np.eye(80)[r.permutation(80)] * 5 + 1
    assert scoring.assignment(big) == 80 * 6 and scoring.assignment(np.zeros((0, 0))) == 0


def test_assigned_words_and_labels(spark):
    """Words keep their speakers through labels and merges; untimed words have none and stay."""
    s = spark.createDataFrame([(1, 0, 0.0, 1.0, "a b"), (1, 1, 1.1, 2.0, "— c d"), (1, 2, 5.0, 6.0, "e")], "meeting_id long, seg_idx long, start double, end double, text string")
    w = spark.createDataFrame([(1, 0, 0, "a", 0.0, 0.5), (1, 0, 1, "b", None, None), (1, 1, 0, "c", 1.1, 1.5), (1, 1, 1, "d", 1.5, 2.0), (1, 2, 0, " e ", 5.0, 6.0)], "meeting_id long, seg_idx long, word_idx long, word string, start double, end double")
    d = spark.createDataFrame([(1, "zed", 0.0, 2.0), (1, "amy", 5.0, 6.0)], "meeting_id long, speaker string, start double, end double")
    kept = speakers.assigned(s, w, d, merge=True, label_style="alpha").orderBy("start").collect()
    assert [(r.speaker, r.text, [(x.word, x.speaker) for x in r.words]) for r in kept] == [("A", "a b c d", [("a", "A"), ("c", "A"), ("d", "A"), ("b", None)]), ("B", "e", [(" e ", "B")])]
    done = speakers.assign_and_build(s, w, d).orderBy("start").collect()
    assert [(r.speaker, [x.word for x in r.words]) for r in done] == [("zed", ["a"]), ("zed", ["c", "d"]), ("amy", ["e"])] and done[0].words[0].score == 0.0
    for bad in ({"strategy": "other"}, {"label_style": "other"}):
        with pytest.raises(ValueError):
            speakers.assigned(s, w, d, **bad)


def drifting(seed=8):
    """Segments with one key twice, words without times, length or order, one word twice; intervals of any length."""
    r = np.random.default_rng(seed)
    s, w, d = [], [], []
    for m in range(3):
        for k in range(9):
            at = float(r.integers(0, 40))
            s.append((m, k, at, at + float(r.integers(0, 12)), f"t{m}.{k}"))
            for i in range(r.integers(0, 14)):
                start = at + i + float(r.integers(-1, 2))
                w.append((m, k, i, f"w{i}", None if r.random() < 0.1 else start, None if r.random() < 0.1 else start + float(r.choice([-1, 0, 0, 0.5, 1, 25]))))
            for _ in range(2):
                start = float(r.integers(0, 45))
                d.append((m, r.choice(["ann", "bob", "eve", None]), start, start + float(r.choice([0, 1, 3, 30]))))
    return s + [(0, 2, s[2][2], s[2][3], "again")], w + [x for x in w if x[1] == 4][:1], d


def plain_speaker(start, end, d):
    named = [(a, b, who or "SPEAKER_UNKNOWN") for _, who, a, b in d]
    if end > start:
        shares = {}
        for a, b, who in named:
            shares[who] = shares.get(who, 0) + max(0, min(end, b) - max(start, a))
        return max(((n, who) for who, n in shares.items() if n > 0), default=(0, "SPEAKER_UNKNOWN"))[1]
    return min((x for x in named if x[0] <= start <= x[1]), default=(0, 0, "SPEAKER_UNKNOWN"))[2]


@pytest.mark.parametrize("bucket", [None, 4.0, 60.0])
def test_assigned_equals_plain_rule(spark, bucket):
    s, w, d = drifting()
    want = []
    for m, k, start, end, text in s:
        own = sorted((x for x in w if x[:2] == (m, k)), key=lambda x: x[2])
        told = [(x[3], plain_speaker(x[4], x[5], [y for y in d if y[0] == m]) if None not in x[4:6] else None, x) for x in own]
        shares = {}
        for _, who, x in told:
            if who:
                shares[who] = shares.get(who, 0) + max(0, x[5] - x[4])
        share, who = max(((n, who) for who, n in shares.items()), default=(0, None))
        want.append((m, text, who if share > 0 else plain_speaker(start, end, [y for y in d if y[0] == m]), tuple(sorted((x, p or "-") for x, p, _ in told))))
    frames = (
        spark.createDataFrame(s, "meeting_id long, seg_idx long, start double, end double, text string"),
        spark.createDataFrame(w, "meeting_id long, seg_idx long, word_idx long, word string, start double, end double"),
        spark.createDataFrame([(m, who if who is None else str(who), a, b) for m, who, a, b in d], "meeting_id long, speaker string, start double, end double"),
    )
    got = speakers.assigned(*frames, bucket=bucket).collect()
    assert sorted((r.meeting_id, r.text, r.speaker, tuple(sorted((x.word, x.speaker or "-") for x in r.words))) for r in got) == sorted(want)
    assert sorted((r.meeting_id, r.seg_idx) for r in got) == [(m, k) for m in range(3) for k in range(10 if m == 0 else 9)]
    alone = intervals.segment_speakers(*frames, bucket).collect()
    assert sorted((r.meeting_id, r.text, r.speaker) for r in alone) == sorted(x[:3] for x in want)


def test_assignment_shuffles_no_single_words(spark):
    s, w, d = drifting()
    frames = spark.createDataFrame(s, "meeting_id long, seg_idx long, start double, end double, text string"), spark.createDataFrame(w, "meeting_id long, seg_idx long, word_idx long, word string, start double, end double"), spark.createDataFrame([(m, "a", a, b) for m, _, a, b in d], "meeting_id long, speaker string, start double, end double")
    for out in (speakers.assigned(*frames, merge=True, label_style="alpha"), intervals.segment_speakers(*frames)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange" in x and "word_idx" in x]


def test_alpha_names(spark):
    frame = spark.range(20_000).select("id", windows.alpha_name(F.col("id")).alias("n"))

    def name(k):
        out = ""
        while True:
            k, rest = divmod(k, 26)
            out = chr(65 + rest) + out
            if not k:
                return out
            k -= 1

    assert all(r.n == name(r.id) for r in frame.where("id < 18278").collect())


def test_prompts(spark):
    asked = spark.createDataFrame([("a", "", "c")], "canary_text string, ctc_text string, whisper_text string")
    row = prompts.prompts(asked, F.lit("uk"), "model", "Default").first()
    assert "one Ukrainian transcript" in row.prompt and "Truth anchor [CTC]: [empty]" in row.prompt and "Instruction profile [baseline_v1]:" in row.prompt
    call = json.loads(row.payload)
    assert call["prompt"] == row.prompt and call["think"] is False and call["options"] == {"temperature": 0, "top_k": 1, "num_predict": 96}
    with pytest.raises(ValueError, match="baseline_v1"):
        prompts.resolved("none such")


def test_run_manifest(spark):
    variants = spark.createDataFrame([("a", None), ("b", 30.0)], "preset_id string, duration_limit double")
    items = spark.createDataFrame([(1, 10.0), (2, None)], "item_id long, duration_limit double")
    plan, none = experiments.run_manifest(variants, items, None, None, dry=True)
    assert none is None and sorted((r.preset_id, r.item_id, r.duration_limit) for r in plan.collect()) == [("a", 1, 10.0), ("a", 2, None), ("b", 1, 10.0), ("b", 2, 30.0)]

    def runner(p):
        status = F.when((F.col("preset_id") == "b") & (F.col("item_id") == 2), "failed").otherwise("completed")
        return p.select("preset_id", "item_id", status.alias("status"), F.lit(0.5).alias("realtime_factor"), F.lit(2.0).alias("wall_clock_sec"), F.lit(1).alias("fallback_count"), F.lit(0.5).alias("proxy_quality_score"))

    score = lambda r: r.select("preset_id", "item_id", F.when(F.col("preset_id") == "a", 0.25).otherwise(0.125).alias("wer"), F.lit(0.1).alias("cer"), F.lit(None).cast("double").alias("cp_wer"), F.lit(None).cast("double").alias("der"))
    rows, board = experiments.run_manifest(variants, items, runner, score)
    assert rows.where("status = 'failed'").first().wer is None
    text = writers.leaderboard_report(board, "Board")
    assert text.splitlines()[0] == "## Board" and "| 1 | a       | 2/2  | 0.2500 | 0.1000 | -     | -   | 0.5000 | 0.5000 | 2         |" in text


def test_stopwatch():
    ticks = iter([0.0, 1.5, 2.0, 2.25, 3.0, 4.0])
    watch = experiments.Stopwatch(lambda: next(ticks))
    for name in ("asr", "align", "asr"):
        with watch.stage(name):
            pass
    assert watch.seconds == {"asr": 2.5, "align": 0.25}


def test_reports(spark):
    score = {"wer": 0.25, "cer": 0.5, "cp_wer": None, "der": 0.125, "word_substitutions": 1, "word_deletions": 0, "word_insertions": 2, "ref_words": 12, "skipped": ["cp_wer: reference has no speaker labels"], "inferred_ends": True}
    text = writers.score_report(score, "T", "a {b|c}")
    assert text.startswith("## T\n| WER    | CER    | DER    |") and "1 sub, 0 del, 2 ins over 12 ref words" in text and "Skipped: cp_wer (reference has no speaker labels)" in text and "inferred" in text and text.endswith("```\na {b|c}\n```")
    items = spark.createDataFrame([("i", 0.25, 0.5, None, None, 4)], "item_id string, wer double, cer double, cp_wer double, der double, ref_words long")
    missing = spark.createDataFrame([("m",)], "item_id string")
    aggregate = spark.createDataFrame([(0.25, 0.5, None, 0.5, None, None)], "macro_wer double, macro_cer double, micro_wer double, micro_cer double, macro_cp_wer double, mean_der double")
    whole = writers.corpus_report("c", items, missing, aggregate)
    assert "Scored 1/2 items." in whole and "Missing hypotheses: m" in whole and "| i    | 0.2500 | 0.5000 | -     | -   | 4         |" in whole and "| -      | micro_wer |" in whole and "mean_der" not in whole


def test_report_sections(spark):
    runs = spark.createDataFrame([(1, "no gpu", None, None, False, None, False, None, 10.0, 5.0)], "meeting_id long, asr_fallback string, alignment_fallback string, diarization_fallback string, skip_alignment boolean, alignment_skip_reason string, skip_diarization boolean, diarization_mode string, duration_sec double, wall_clock_sec double")
    s = spark.createDataFrame([(1, 0, "A", 0.0, 1.0, "one two")], "meeting_id long, seg_idx long, speaker string, start double, end double, text string")
    w = spark.createDataFrame([(1, 0.0, 0.5, 1.0)], "meeting_id long, start double, end double, score double")
    tables = {"runs": runs, "segments": s, "words": w}
    assert quality.default_checks(tables) == ["performance", "stability", "proxy_transcript_quality"]
    out = quality.report_sections(tables | {"reference": s}).first()
    assert out.performance.realtime_factor == 0.5 and out.stability.fallback_count == 1 and out.metrics.wer == 0.0 and out.metrics.timed_word_ratio == 1.0


def test_presets_that_are_wrong(spark, tmp_path):
    good = {"id": "p", "pipeline": {"language": "ru"}, "backend": {"id": "b"}}
    for wrong, why in (({"id": None}, "lacks its id"), ({"pipeline": {"speed": 1}}, "unknown pipeline keys in p: speed"), ({"pipeline": {"content_mode": "x"}}, "no content mode x"), ({"backend": {"options": {}}}, "no backend id")):
        (tmp_path / "a.json").write_text(json.dumps({k: v for k, v in (good | wrong).items() if v is not None}))
        with pytest.raises(ValueError, match=why):
            readers.read_presets(spark, str(tmp_path))
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(good))
    with pytest.raises(ValueError, match="two presets"):
        readers.read_presets(spark, str(tmp_path))


def test_audio_that_is_wrong(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_audio(spark, str(tmp_path / "none.wav"))
    for name, why in (("a.txt", "isn't one of"), ("a.mp3", "registered audio stage")):
        (tmp_path / name).write_text("x")
        with pytest.raises(ValueError, match=why):
            readers.read_audio(spark, str(tmp_path / name))


def test_groups(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "1.txt").write_text("First line here. Second one there.")
    (tmp_path / "a.txt").write_text("Third of all.")
    got = readers.read_groups(spark, [(" ", 2, str(tmp_path / "b"))], [str(tmp_path / "a.txt")], limit=2)
    assert [(r.label, r.weight) for r in got.collect()] == [("group_1", 2)] * 2
    with pytest.raises(ValueError):
        readers.read_groups(spark, [("x", 0, str(tmp_path / "b"))])


def test_saved_run_without_meta(spark, tmp_path):
    language, stages = reviews.read_saved_run(spark, str(tmp_path))
    assert language == "ru" and all(t.count() == 0 for t in stages.values())


def test_experiment_on_disk(spark, tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("id: e\naudio: a.wav\nvariants:\n  - {id: v, extends: w}\n  - {id: w, extends: v}\n")
    with pytest.raises(ValueError, match="parent"):
        readers.read_experiment(spark, str(p))
