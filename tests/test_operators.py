"""Behaviours on literal cases and against small models in plain Python."""

from __future__ import annotations

import random
import wave
from itertools import permutations
from statistics import pvariance

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import distance, text
from spanloom.operators import corpus, intervals, merge, quality, ranking, scoring, windows
from spanloom.plans import roles
from spanloom.sources import readers, writers


def one(spark, *columns, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return tuple(frame.select(*columns).first())


def test_profiles(spark):
    c = F.col("t")
    assert one(spark, text.normalize(c), text.normalize(c, "ru_fold"), text.normalize(c, "ru_fold_repeats"), t="  Ёж, ёж — ЕЩЁ  раз! Straße") == ("ёж ёж ещё раз strasse", "еж еж еще раз strasse", "еж еще раз strasse")
    assert one(spark, text.normalize(c), F.size(text.tokens(c)), t=None) == ("", 0)
    with pytest.raises(ValueError):
        text.profile("none such")


def test_scripts_and_ratios(spark):
    t, ru, en, de = F.col("t"), F.lit("ru"), F.lit("en"), F.lit("de")
    assert one(spark, text.has_script(t, ru), text.has_script(t, en), text.has_script(t, de), text.has_script(t, de, True), t="мир word") == (True, True, False, True)
    assert one(spark, text.looks_foreign(t, ru), text.looks_foreign(t, en), t="plain words") == (True, False)
    a, b = text.content_set(F.col("a")), text.content_set(F.col("b"))
    assert one(spark, text.overlap_ratio(a, b), text.source_ratio(a, b), text.unsupported(a, b), a="one two three a", b="two four") == (pytest.approx(1 / 3), pytest.approx(1 / 3), 2)


def test_cleaning(spark):
    c = F.col("t")
    assert one(spark, text.clean_decoded(c), t="▁a▁⁇▁ b ,  ( c )") == ("a b, (c)",)
    assert one(spark, text.without_nested(c, "{{", "}}"), t="x {{a {{b}} c}} y }} z") == ("x  y }} z",)
    page = "== Head ==\n<!-- no -->It is '''bold''' <ref>r</ref>and [[File:x.png|t]] [[Target|shown]] {{drop {{this}}}}. [http://a.b label] &lt;b&gt;end&lt;/b&gt;!"
    assert one(spark, F.array_join(text.plain_sentences(c), "|"), t=page) == ("Head .|It is bold and shown .|label end !",)
    assert one(spark, text.slug(c), t="..a b/c..") == ("a_b_c",) and one(spark, text.slug(c), t="--") == ("case",)
    assert one(spark, text.clock(F.col("x")), x=3661.5) == ("01:01:01.50",)
    assert one(spark, text.joined(F.col("a"), F.col("b")), a=" x ", b="— y") == ("x y",)


def test_unescaped(spark):
    from html import unescape

    texts = ["&lt;b&gt; &amp;lt; &amp", "&copy 2020 &copyx &notin; &notit; &mdash;&#160;&#xA9;&#x1F600; &#0; &#xD800; &#99999999;", "a & b &; &unknown; && &#; &#x;", "&#150;&#x80;&#129;&#1;&#11;&#13;&#xFFFF;|", "none", "", "&Aacute;&eacute &NotEqualTilde; &#0065;x &#x41x"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for k, got in frame.select("k", text.unescaped(F.col("t"))).collect():
        assert got == unescape(texts[k]), texts[k]


def test_sentences_keep_their_digits(spark):
    """Only white space is trimmed, whatever a sentence's position."""
    t = "0 is first. 1 is next 1. 2 and 2. Ten times 3"
    assert one(spark, F.array_join(text.sentences(F.col("t")), "|"), t=t) == ("0 is first.|1 is next 1.|2 and 2.|Ten times 3",)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_distances(spark):
    r = random.Random(1)
    pairs = [([r.choice("abcd") for _ in range(r.randint(0, 9))], [r.choice("abcd") for _ in range(r.randint(0, 9))]) for _ in range(80)]
    frame = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    ops = distance.aligned(F.col("a"), F.col("b"))
    for row in frame.select("a", "b", distance.word_distance(F.col("a"), F.col("b")).alias("d"), ops.alias("o")).collect():
        assert row.d == levenshtein(row.a, row.b) == sum(o.tag != "equal" for o in row.o)
        assert [o.reference for o in row.o if o.reference is not None] == row.a
        assert [o.hypothesis for o in row.o if o.hypothesis is not None] == row.b


def test_error_rates(spark):
    rows = [("One two, three four", "one two three"), ("a b", "a x b"), ("", "x"), ("", "")]
    out = scoring.error_rates(spark.createDataFrame(rows, "ref_text string, hyp_text string")).orderBy("ref_text", "hyp_text").collect()
    assert [r.wer for r in out] == [0.0, 1.0, 0.25, 0.5]
    items = spark.createDataFrame([("c", 0.5, 0.5, 1, 2, 1, 2), ("c", 0.0, 0.0, 0, 8, 0, 8)], "k string, wer double, cer double, word_edits long, ref_words long, char_edits long, ref_chars long")
    assert tuple(scoring.corpus_aggregate(items, "k").select("macro_wer", "micro_wer").first()) == (0.25, 0.1)


def test_diff(spark):
    frame = spark.createDataFrame([(list("abcdefghij"), list("abcdXfghij"))], "a array<string>, b array<string>")
    ops = distance.aligned(F.col("a"), F.col("b"))
    assert frame.select(distance.marked(ops).alias("m")).first().m == "a b c d {e|X} f g h i j"
    assert frame.withColumn("o", ops).select(distance.marked_errors(F.col("o"), 1).alias("m")).first().m == "… d {e|X} f …"


def test_merge_turns(spark):
    r, rows = random.Random(2), []
    for m in range(60):
        for k in range(r.randint(1, 8)):
            s = r.randint(0, 20)
            rows.append((m, k, r.choice("AB"), float(s), float(s + r.randint(0, 5)), f"t{k}"))
    got = {}
    for x in windows.merge_turns(spark.createDataFrame(rows, "meeting_id long, seg_idx long, speaker string, start double, end double, text string"), 1.0).collect():
        got.setdefault(x.meeting_id, []).append((x.start, x.end, x.speaker, x.text))
    for m in range(60):
        want = []
        for _, k, sp, s, e, t in sorted((x for x in rows if x[0] == m), key=lambda x: (x[3], x[4], x[2], x[1])):
            if want and want[-1][2] == sp and s - want[-1][1] <= 1.0:
                want[-1] = (want[-1][0], max(want[-1][1], e), sp, f"{want[-1][3]} {t}")
            else:
                want.append((s, e, sp, t))
        assert sorted(got[m]) == sorted(want)


def test_uniform_words(spark):
    r, rows = random.Random(3), []
    for m in range(80):
        for k in range(r.randint(1, 9)):
            d = r.choice([0.3, 0.5, 0.6, 0.9, 1.3, None])
            rows.append((m, 0, k, 0.0 if d else None, d))
    got = {x.meeting_id: x.flagged for x in windows.uniform_words(spark.createDataFrame(rows, "meeting_id long, seg_idx long, word_idx long, start double, end double")).collect()}
    for m in got:
        run, hit = [], False
        for *_, d in sorted(x for x in rows if x[0] == m) if False else [x for x in rows if x[0] == m]:
            run = [*run, d] if d is not None and 0.4 <= d <= 1.2 else []
            hit |= len(run) >= 4 and pvariance(run[-4:]) < 0.05
        assert got[m] == hit


def test_speakers(spark):
    d = spark.createDataFrame([(1, "A", 0.0, 1.0), (1, "B", 1.0, 2.0), (1, "B", 5.0, 6.0)], "meeting_id long, speaker string, start double, end double")
    spans = spark.createDataFrame([(1, 0, 0.5, 1.5), (1, 1, 0.0, 1.2), (1, 2, 3.0, 4.0), (1, 3, 5.5, 5.5), (1, 4, 1.0, 1.0)], "meeting_id long, span_id long, start double, end double")
    assert [x.speaker for x in intervals.speakers(spans, d).orderBy("span_id").collect()] == ["B", "A", "SPEAKER_UNKNOWN", "B", "A"]


def test_bucketed_join_equals_plain(spark):
    r = random.Random(4)
    make = lambda a, b: spark.createDataFrame([(r.randint(0, 2), k, s := r.uniform(0, 50), s + r.uniform(0, 9)) for k in range(60)], f"meeting_id long, {a} long, {b}start double, {b}end double")
    x, y = make("i", ""), make("j", "r_")
    plain = {(p.i, p.j) for p in intervals.overlapping(x, y, ["meeting_id"]).collect()}
    laid = [(p.i, p.j) for p in intervals.overlapping(x, y, ["meeting_id"], bucket=4.0).collect()]
    assert len(laid) == len(set(laid)) and set(laid) == plain


def test_window_text(spark):
    w = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 2.0, 3.0), (1, 2, 9.0, 9.5)], "meeting_id long, window_id long, start double, end double")
    s = spark.createDataFrame([(1, 0, 0.0, 2.5, "whole text")], "meeting_id long, seg_idx long, start double, end double, text string")
    words = spark.createDataFrame([(1, 0, 0, 0.1, 0.2, "first"), (1, 0, 1, 1.0, 1.5, "mid")], "meeting_id long, seg_idx long, word_idx long, start double, end double, word string")
    assert [x.text for x in intervals.window_text(w, s, words).orderBy("window_id").collect()] == ["first", "whole text", ""]


def test_labels_and_windows(spark):
    rows = [(1, k, f"s{k:04d}", 0.0, 1.0) for k in range(730)] + [(1, 999, "SPEAKER_UNKNOWN", 0.0, 1.0)]
    out = {x.speaker: x.label for x in windows.alpha_labels(spark.createDataFrame(rows, "meeting_id long, seg_idx long, speaker string, start double, end double")).collect()}
    assert [out[f"s{k:04d}"] for k in (0, 25, 26, 701, 702, 729)] == ["A", "Z", "AA", "ZZ", "AAA", "ABB"] and out["SPEAKER_UNKNOWN"] == "SPEAKER_UNKNOWN"
    meetings = spark.createDataFrame([(1, 65.0), (2, 0.0)], "meeting_id long, duration double")
    assert [(x.start, x.end) for x in windows.fixed_windows(meetings, 30).orderBy("start").collect()] == [(0.0, 30.0), (30.0, 60.0), (60.0, 65.0)]
    with pytest.raises(ValueError):
        windows.fixed_windows(meetings, 0)


def test_ends(spark):
    items = spark.createDataFrame([(1, 0, 0.0, 4.0), (1, 1, 5.0, None), (1, 2, 5.0, None), (2, 0, 1.0, None)], "meeting_id long, pos long, start double, end double")
    assert [x.end for x in windows.infer_ends(items).orderBy("meeting_id", "pos").collect()] == [4.0, 9.0, 9.0, 3.0]
    review = spark.createDataFrame([(1, 0, 0.0, None, "a"), (1, 1, 30.0, None, ""), (1, 2, None, None, "c")], "meeting_id long, pos long, start double, end double, text string")
    got = {x.pos: (x.end, x.problem) for x in windows.review_ends(review).collect()}
    assert got[0] == (30.0, None) and got[1] == (45.0, "no text") and got[2][1] == "no start"


CASES = [
    ("", "слово", "", "missing_canary_ctc_anchor", "слово"), ("", "word", "слово", "missing_canary_whisper_fallback", "слово"), ("", "", "", "missing_canary_transcript", ""), ("word", "слово", "", "canary_script_guard_ctc_anchor", "слово"),
    ("word", "", "слово", "canary_script_guard_whisper_fallback", "слово"), ("word", "", "", "language_script_guard_drop", ""), ("слово", "", "", "missing_ctc_canary_base", "слово"), ("слово", "word", "", "unexpected_ctc_script_canary_base", "слово"),
    ("слово", "слово", "", "canary_ctc_consensus", "слово"), ("слово", "дело", "дело", "ctc_whisper_consensus_override", "дело"), ("слово", "дело", "тело", "rule_based_canary_base", "слово"),
]


def test_decisions(spark):
    frame = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(CASES)], "k int, c string, t string, w string")
    out = frame.select("k", merge.decide(F.col("c"), F.col("t"), F.col("w"), F.lit("ru")).alias("d")).orderBy("k").collect()
    assert [(x.d.note, x.d.text) for x in out] == [c[3:] for c in CASES]


def test_replies(spark):
    asked = spark.createDataFrame([(1, k, float(k), k + 1.0, "раз два три", "раз два пять", "шесть семь") for k in range(4)], "meeting_id long, seg_idx long, start double, end double, canary_text string, ctc_text string, whisper_text string")
    replies = spark.createDataFrame([(1, 0, "раз два пять", False), (1, 1, "plain foreign words", False), (1, 2, None, True)], "meeting_id long, seg_idx long, reply string, failed boolean")
    out = merge.with_replies(asked, F.lit("ru"), budget=3, replies=replies).orderBy("seg_idx").collect()
    assert [(x.calls, x.note, x.text) for x in out] == [(True, None, "раз два пять"), (True, "language_script_guard_ollama", "раз два три"), (True, "ollama_fallback", "раз два три"), (False, "ollama_call_budget_canary_base", "раз два три")]


def test_cpwer(spark):
    r, rows, both = random.Random(5), [], []
    for m in range(25):
        for side, to in (("r", rows), ("h", both)):
            for k in range(r.randint(1, 6)):
                to.append((m, k, r.choice("XYZ" if side == "r" else "PQR"), " ".join(r.choice("abcde") for _ in range(r.randint(1, 5))), 0.0, 1.0))
    schema = "meeting_id long, seg_idx long, speaker string, text string, start double, end double"
    for x in scoring.cp_wer(spark.createDataFrame(rows, schema), spark.createDataFrame(both, schema)).collect():
        def sides(data):
            out = {}
            for row in data:
                if row[0] == x.meeting_id:
                    out.setdefault(row[2], []).extend(row[3].split())
            return list(out.values())

        a, b = sides(rows), sides(both)
        n = max(len(a), len(b))
        a, b = a + [[]] * (n - len(a)), b + [[]] * (n - len(b))
        assert x.edits == min(sum(levenshtein(p, q) for p, q in zip(a, o)) for o in permutations(b)) and x.exact


def test_der(spark):
    schema = "meeting_id long, start double, end double, speaker string"
    ref = spark.createDataFrame([(1, 0.0, 5.0, "A"), (1, 5.0, 10.0, "B")], schema)
    same = spark.createDataFrame([(1, 0.0, 5.0, "x"), (1, 5.0, 10.0, "y")], schema)
    swallowed = spark.createDataFrame([(1, 0.0, 10.0, "x")], schema)
    assert intervals.der_sweep(ref, same).first().der == 0.0 and intervals.der_sweep(ref, swallowed).first().der == 0.5


def test_best_total(spark):
    r, rows = random.Random(6), []
    for m in range(20):
        rows += [(m, f"r{i}", f"h{j}", float(r.randint(0, 9))) for i in range(r.randint(1, 4)) for j in range(r.randint(1, 4))]
    for x in scoring.best_total(spark.createDataFrame(rows, "meeting_id long, ref string, hyp string, weight double")).collect():
        w = {(a, b): c for m, a, b, c in rows if m == x.meeting_id}
        a, b = sorted({k for k, _ in w}), sorted({k for _, k in w})
        a += [None] * (len(b) - len(a))
        assert x.best == max(sum(w.get((i, j), 0) for i, j in zip(a, p)) for p in permutations(b + [None] * (len(a) - len(b))))


def test_quality_and_stability(spark):
    s = spark.createDataFrame([(1, 0, "A", 0.0, 1.0, "one one two"), (1, 1, "SPEAKER_UNKNOWN", 1.0, 1.1, "")], "meeting_id long, seg_idx long, speaker string, start double, end double, text string")
    w = spark.createDataFrame([(1, 0.0, 0.5, 1.0), (1, None, None, 0.0)], "meeting_id long, start double, end double, score double")
    x = quality.report({"segments": s, "words": w}).first()
    assert (x.timed_word_ratio, x.mean_word_score, x.labeled_speaker_ratio, x.empty_or_short_segment_ratio, x.repetition_ratio) == (0.5, 0.5, 0.5, 0.5, 0.333333)
    assert x.proxy_quality_score == round(0.5 * 0.35 + 0.5 * 0.25 + 0.5 * 0.2 + 0.5 * 0.1 + (1 - 0.333333) * 0.1, 6)
    runs = spark.createDataFrame([("no gpu", None, "", True, None, False, "synthetic_single_speaker", 10.0, 5.0)], "asr_fallback string, alignment_fallback string, diarization_fallback string, skip_alignment boolean, alignment_skip_reason string, skip_diarization boolean, diarization_mode string, duration_sec double, wall_clock_sec double")
    y = quality.stability(runs).first()
    assert (y.fallback_reasons, y.skipped_stages, y.realtime_factor) == (["no gpu"], ["alignment", "diarization"], 0.5)


def test_rankings(spark):
    rows = [("b", 1, "completed", 0.2, None, 1.0, 0.5, 0), ("a", 1, "failed", 0.0, 0.0, 1.0, 0.9, 2), ("c", 1, "completed", 0.1, None, None, 0.1, 0)]
    out = ranking.leaderboard(spark.createDataFrame(rows, "variant string, item_id long, status string, wer double, cer double, realtime_factor double, proxy_quality_score double, fallback_count long")).orderBy("rank").collect()
    assert [x.variant for x in out] == ["c", "b", "a"]
    assert ranking.grid_values("1, 2,,3", int) == [1, 2, 3]
    with pytest.raises(ValueError):
        ranking.grid_values(" , ")


def test_weighted_corpus(spark):
    texts = spark.createDataFrame([("spoken", 3, 1, "First line here. Second line there."), ("other", 1, 2, "Third one.")], "label string, weight int, doc_id long, text string")
    s = corpus.corpus_sentences(texts)
    assert {(x.label, x.raw_sentences, x.weighted_sentences) for x in corpus.group_stats(s).collect()} == {("spoken", 2, 6), ("other", 1, 1)}
    assert corpus.repeated(s).count() == 7 and corpus.vocabulary(s, 1).first().token == "." and corpus.corpus_sentences(texts, 1).count() == 1


def test_best_run_against_all_runs(monkeypatch):
    r = random.Random(5)

    def plain(words, source, target):
        runs = []
        for i in range(len(words)):
            for j in range(i, len(words)):
                w = [x for s in words[i : j + 1] for x in s]
                if w:
                    runs.append((len(set(w) & set(source)) / len(set(w)) - 0.25 * abs(len(w) - target) / len(w), -i, -j))
        return (lambda best: (-best[1], -best[2]))(max(runs)) if runs else None

    def found(words, source, target):
        ids = {x: k for k, x in enumerate(dict.fromkeys([x for s in words for x in s] + source))}
        number = lambda some: np.array([ids[x] for x in some], np.int64)
        return corpus.best_run(np.array([len(s) for s in words], np.int64), number([x for s in words for x in s]), number(source), target)

    monkeypatch.setattr(corpus, "_RUNS", 20)  # so that runs are scored in several parts
    for _ in range(400):
        words = [[r.choice("abcdefgh") for _ in range(r.choice([0, 1, 2, 3, 5]))] for _ in range(r.randrange(9))]
        source, target = r.sample("abcdefgh", r.randrange(1, 6)), r.randrange(1, 12)
        assert found(words, source, target) == plain(words, source, target)
    monkeypatch.undo()
    many = [[f"w{(i * 7 + k) % 900}" for k in range(8)] for i in range(3000)]  # all runs together: 36 billion words
    assert found(many, [f"w{k}" for k in range(900)], 24000) == (0, 2999)


def test_a_texts_runs_are_scored_once(spark):
    s = roles.segments(spark, "/root/testdata/sf0.001")
    plan = corpus.primary_pairs(roles.whisper(s), roles.ctc(s), s, 60_000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_best_runs(") == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"speaker": "A", "start_sec": 0.5, "text": "x"}, {"speaker": "B", "start": "bad", "text": "y"}]')
    (tmp_path / "b.json").write_text('{"language": "en", "segments": [{"speaker": "A", "start": 1, "end": 2, "text": "x"}]}')
    (tmp_path / "c.txt").write_text("[00:00:00.00 -> 00:00:01.00] A: hello: there\n\nno speaker\n")
    out = {(x.meeting_id, x.pos): (x.speaker, x.start, x.text, x.kind) for x in readers.read_references(spark, str(tmp_path)).collect()}
    assert out == {("a", 0): ("A", 0.5, "x", "list"), ("a", 1): ("B", None, "y", "list"), ("b", 0): ("A", 1.0, "x", "transcript"), ("c", 0): ("A", None, "hello: there", "text"), ("c", 1): (None, None, "no speaker", "text")}


def test_transcript_round_trip(spark, tmp_path):
    doc = '{"language": "en", "duration": 2.0, "segments": [{"speaker": "A", "start": 0.0, "end": 1.0, "text": "hi", "words": [{"word": "hi", "start": 0.0, "end": 1.0}]}]}'
    (tmp_path / "m.json").write_text(doc)
    t = readers.read_transcripts(spark, str(tmp_path / "m.json"))
    back = writers.nested(readers.segments_of(t), readers.words_of(t), t)
    writers.write_transcripts(back, str(tmp_path / "out"))
    assert back.first().segments[0].words[0].score == 0.0 and "confidence" not in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert writers.transcript_texts(readers.segments_of(t)).first().text == "[00:00:00.00 -> 00:00:01.00] A: hi"


def test_audio(spark, tmp_path):
    x = np.array([0, 16384, -32768, 100], "<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(x.tobytes())
    a = readers.read_wav(spark, str(tmp_path / "a.wav"))
    row = a.select("samples", readers.voiced(F.col("samples")).alias("v")).first()
    assert row.samples[1] == 0.5 and row.v and len(writers.wav_bytes(a).first().content) == 44 + 8
    assert [c.end for c in readers.audio_chunks(a, 3 / 16000).orderBy("chunk").collect()] == [0.0, 0.0]


def test_manifests(spark, tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("name: n\ndefaults: {language: ru}\nitems:\n  - {id: a, reference: r.json}\n")
    assert readers.read_corpus(spark, str(p)).first().language == "ru"
    for bad in ("name: n\nitems: []\n", "name: n\nextra: 1\nitems: [{id: a, reference: r}]\n", "items: [{id: a, reference: r}, {id: a, reference: r}]\n"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            readers.read_corpus(spark, str(p))
    p.write_text("id: e\naudio: a.wav\ndefaults: {backend: {id: x, options: {k: 1}}}\nvariants:\n  - {id: v}\n  - {id: w, extends: v, backend: {options: {k: 2}}}\n")
    assert [r.backend for r in readers.read_experiment(spark, str(p)).orderBy("preset_id").collect()] == ['{"id": "x", "options": {"k": 1}}', '{"id": "x", "options": {"k": 2}}']


def test_wiki_and_chunks(spark, tmp_path):
    page = lambda ns, extra, body: f"<page><title>T{ns}</title><ns>{ns}</ns>{extra}<revision><text>{body}</text></revision></page>"
    (tmp_path / "w.xml").write_text(f"<mediawiki>{page(0, '', 'Body one.')}{page(1, '', 'No.')}{page(0, '<redirect title=' + chr(34) + 'x' + chr(34) + '/>', 'No.')}</mediawiki>")
    assert [r.text for r in readers.read_wiki(spark, str(tmp_path / "w.xml")).collect()] == ["Body one."]
    (tmp_path / "k.json").write_text('{"meta": {"chunk_seconds": 10}, "chunks": [{"chunk": "a", "text": "x"}, {"text": " "}, {"text": "z"}], "timestamps": [{"chunk": "a", "timestamp": {"word": [{"start": 1.0, "end": 2.0}, {"start": 3.0, "end": 4.5}]}}]}')
    assert [(r.start, r.end, r.text) for r in readers.read_chunked(spark, str(tmp_path / "k.json")).orderBy("seg_idx").collect()] == [(1.0, 4.5, "x"), (20.0, 30.0, "z")]


def test_report():
    assert writers.markdown(["a", "b"], [[1.0, None]]) == "| a      | b |\n| ------ | - |\n| 1.0000 | - |" and writers.markdown(["a"], []) == "_(no rows)_"


def test_stream(spark, tmp_path):
    from spanloom.streaming import progress

    (tmp_path / "e.json").write_text("\n".join('{"run_id": "r", "seq": %d, "ts": "2024-01-01T00:0%d:00", "status": "run", "percent": %d, "stage": "asr"}' % x for x in ((1, 1, 5), (1, 1, 5), (2, 7, 50))))
    q = progress.per_window(progress.read_events(spark, str(tmp_path))).writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.events, r.furthest) for r in spark.table("progress").collect()) == [(1, 5.0), (1, 50.0)]


def test_stages(spark):
    from spanloom.operators import stages

    t = F.col("t")
    for raw, want in (('{"text": "", "prediction": " x "}', "x"), ('{"chunks": [{"text": "a"}, {"prediction": "b"}]}', "a b"), (" plain ", "plain"), ('[{"text": "l"}]', "l")):
        assert one(spark, stages.output_text(t), t=raw) == (want,)
    assert one(spark, stages.decoder_labels(F.col("p"), F.lit(4)), p=["<unk>", " ", "a"]) == (["▁⁇▁", "▁", "a", ""],)
    with pytest.raises(Exception, match="don't fit"):
        one(spark, stages.decoder_labels(F.col("p"), F.lit(9)), p=["a"])
    runs = spark.createDataFrame([(None, 5, "multi-speaker", "hybrid", False), (None, None, "single-speaker", "hybrid", False)], "min_speakers int, max_speakers int, content_mode string, backend_id string, skip_diarization boolean")
    assert [(x.min_speakers, x.max_speakers) for x in stages.speaker_bounds(runs).collect()] == [(2, 5), (None, None)]
    stages.register("diarize", "one", stages.synthetic_diarization, "meeting_id long, speaker string, start double, end double")
    assert stages.apply("diarize", "one", spark.createDataFrame([(1, 3.0)], "meeting_id int, duration double")).first().speaker == "SPEAKER_00"
    with pytest.raises(ValueError):
        stages.apply("diarize", "none", runs)
    a = spark.createDataFrame([("p", [0.0, 1.0, 2.0, 3.0])], "path string, samples array<float>")
    assert stages.resampled(a, 4, 8).first().samples[:4] == [0.0, 0.5, 1.0, 1.5]


def test_cosine_in_blocks(spark):
    """More probes than fit one block give what one block gives."""
    from spanloom.operators import search

    v = spark.createDataFrame([(k, [float(k % 7), float(k % 11) + 1, float(k % 5)]) for k in range(60)], "vec_id long, embedding array<float>")
    probes = v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe"))
    whole, blocks = (sorted(map(tuple, search.cosine(v, probes, 4, most).collect())) for most in (1000, 6))
    assert len(whole) == 80 and blocks == whole
