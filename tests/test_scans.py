"""Two-level scans, distances, SQL functions, manifests that extend each other, runs as a stream."""

from __future__ import annotations

import datetime as dt
import json
import os
import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import DATA, by_spark, by_sql
from pyspark.sql import functions as F

from spanloom.functions import distance as edits
from spanloom.functions import sql
from spanloom.functions.distance import align, distance, word_distance
from spanloom.operators import intervals, manifests, scoring, windows
from spanloom.plans.catalog import ORACLES, QUERIES
from spanloom.sources import writers
from spanloom.streaming import runs

# scans


def talk(seed=3, n=900):
    """A meeting with half of all rows, some starts and ends missing, many ties."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        meeting = 0 if k % 2 == 0 else r.randrange(1, 6)
        start = None if r.random() < 0.02 else float(r.randrange(400))
        end = None if start is None or r.random() < 0.02 else start + r.choice([0, 1, 2, 30])
        rows.append((meeting, k, r.choice(["a", "b", "b", None]), start, end, f"t{k}"))
    return rows


SEGMENTS = "meeting_id long, seg_idx long, speaker string, start double, end double, text string"


def plain_turns(rows, gap):
    out = []
    for meeting in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == meeting), key=lambda r: (r[3] is None, r[3] or 0, r[4] is not None or r[3] is not None, r[4] if r[4] is not None else r[3] or 0, r[2] or "SPEAKER_UNKNOWN", r[1]))
        turn, reach, who = [], None, None
        for r in own:
            name = r[2] or "SPEAKER_UNKNOWN"
            if turn and (name != who or (reach is not None and r[3] is not None and r[3] - reach > gap)):
                out.append((meeting, who, tuple(x[5] for x in turn)))
                turn, reach = ([], None) if name != who else ([], reach)
            turn.append(r)
            who = name
            reach = max((x for x in (reach, r[4]) if x is not None), default=None)
        out.append((meeting, who, tuple(x[5] for x in turn)))
    return sorted(out)


@pytest.mark.parametrize("width", [1.0, 50.0, 3600.0])
def test_turns_over_many_slots(spark, width):
    rows = talk()
    got = windows.merge_turns(spark.createDataFrame(rows, SEGMENTS), 1.0, width).collect()
    assert sorted((r.meeting_id, r.speaker, tuple(r.text.split(" "))) for r in got) == plain_turns(rows, 1.0)


@pytest.mark.parametrize("width", [1.0, 3600.0])
def test_budget_over_many_slots(spark, width):
    rows = talk(4)
    df = spark.createDataFrame(rows, SEGMENTS)
    got = {r.seg_idx for r in windows.within_budget(df, F.col("speaker") == "b", 7, "start", "end", "seg_idx", width=width).where("calls").collect()}
    want = set()
    for meeting in range(6):
        own = sorted((r for r in rows if r[0] == meeting and r[2] == "b"), key=lambda r: (r[3] is None, r[3] or 0, r[4] is not None, r[4] or 0, r[1]))
        want |= {r[1] for r in own[:7]}
    assert got == want


def test_speaker_error_over_many_slots(spark):
    rows = [r for r in talk(5) if r[3] is not None and r[4] is not None]
    a, b = spark.createDataFrame(rows[::2], SEGMENTS), spark.createDataFrame(rows[1::2], SEGMENTS)
    whole = intervals.der_sweep(a, b, width=1e9).orderBy("meeting_id").collect()
    assert whole and whole == intervals.der_sweep(a, b, width=1.0).orderBy("meeting_id").collect()
    plan = windows.merge_turns(a, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(meeting_id" in plan and plan.count("__slot") > 3


# distances


def table(r, h):
    rows = [list(range(len(h) + 1))]
    for i, x in enumerate(r, 1):
        rows.append([i])
        for j, y in enumerate(h, 1):
            rows[i].append(min(rows[i - 1][j - 1] + (x != y), rows[i - 1][j] + 1, rows[i][j - 1] + 1))
    return rows


def way_back(r, h):
    d, i, j, out = table(r, h), len(r), len(h), []
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (r[i - 1] != h[j - 1]):
            i, j = i - 1, j - 1
            out.append(("equal" if r[i] == h[j] else "replace", r[i], h[j]))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append(("delete", r[i], None))
        else:
            j -= 1
            out.append(("insert", None, h[j]))
    return out[::-1]


def test_distances_and_alignments():
    r = random.Random(1)
    for _ in range(800):
        k = r.choice([1, 2, 3, 8])
        a, b = ([str(r.randrange(k)) for _ in range(r.randint(0, 25))] for _ in range(2))
        if r.random() < 0.5:
            b = [x for x in a if r.random() < 0.8]
        assert distance(a, b) == table(a, b)[-1][-1] and align(a, b) == way_back(a, b)


def test_long_distances(spark):
    """More distinct words than there are characters, and longer than any table would do."""
    a = [f"w{k}" for k in range(30_000)]
    b = a[100:20_000] + ["x"] * 50 + a[20_000:]
    assert distance(a, b) == 150
    ops = align(a, b)
    assert sum(op[0] != "equal" for op in ops) == 150 and [op[1] for op in ops if op[1]] == a and [op[2] for op in ops if op[2]] == b
    got = spark.createDataFrame([(a, b), ([], ["x"]), (None, ["x"])], "r array<string>, h array<string>").select(word_distance(F.col("r"), F.col("h")).alias("n")).collect()
    assert [x.n for x in got] == [150, 1, None]


def test_functions_in_sql(spark):
    sql.register(spark)
    spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "c", "d"]), (2, [], []), (3, None, ["z"])], "id int, r array<string>, h array<string>").createOrReplaceTempView("sides")
    got = spark.sql("SELECT s.id, a.pos, a.tag, a.reference, a.hypothesis FROM sides s, LATERAL align(s.r, s.h) a ORDER BY 1, 2").collect()
    assert [tuple(x) for x in got] == [(1, 0, "equal", "a", "a"), (1, 1, "replace", "b", "x"), (1, 2, "equal", "c", "c"), (1, 3, "insert", None, "d"), (3, 0, "insert", None, "z")]
    one = spark.sql("SELECT word_distance(r, h) AS n, edit_counts(r, h) AS c FROM sides WHERE id = 1").first()
    assert one.n == 2 and one.c.asDict() == {"hits": 2, "substitutions": 1, "deletions": 0, "insertions": 1}


def test_edits_are_handed_on_in_parts():
    """Few of a batch's rows are Python objects at a time, whatever its size."""
    words = [[f"w{(i * 7 + k) % 50}" for k in range(900)] for i in range(150)]
    pairs = [(w, w[:100] + w[103:500] + ["new"] + w[500:]) for w in words] + [(None, ["a"]), ([], [])]
    batch = tuple(pa.array(x, pa.list_(pa.string())) for x in zip(*pairs, strict=True))
    parts = list(edits._aligned(iter([batch])))
    assert len(parts) > 1 and max(len(p.flatten()) for p in parts) <= edits.HELD + 1000
    ops = [[tuple(o.values()) for o in row] for p in parts for row in p.to_pylist()]
    assert ops == [edits.align(a or [], b or []) for a, b in pairs]
    assert pa.concat_arrays(list(edits._distances(iter([batch])))).to_pylist() == [4] * 150 + [None, 0]
    assert pa.concat_arrays(list(edits._split(iter([batch])))).to_pylist()[0] == {"hits": 897, "substitutions": 0, "deletions": 3, "insertions": 1}


def test_corpus_scores_count_the_edits_of_long_turns(spark, tmp_path):
    """A turn whose characters make more than five million cells, against the SQL."""
    for t in Path(DATA).iterdir():
        if t.stem != "conversations":
            (tmp_path / t.name).symlink_to(t)
    given = pq.read_table(f"{DATA}/conversations.parquet")
    text = " ".join(f"{k * k % 991:03d}" * 4 for k in range(250))
    long = pa.Table.from_pylist([{"conv_id": 900_001, "turn": 0, "role": "user", "text": text}], given.schema)
    pq.write_table(pa.concat_tables([given, long]), tmp_path / "conversations.parquet")
    got = by_spark(spark, QUERIES["corpus_scores"], str(tmp_path))
    assert got == by_sql(ORACLES["corpus_scores"], str(tmp_path)) and "None" not in "".join(r for r in got[1] if r.startswith("(4,"))


def test_every_pair_has_its_split(spark):
    rows = spark.createDataFrame([("a " * 2300, "b " * 2300), ("c " * 3000 + "d", "d " + "c " * 2990)], "ref_text string, hyp_text string")
    got = [(x.word_hits, x.word_substitutions, x.word_deletions, x.word_insertions, x.char_substitutions) for x in scoring.error_counts(rows, cells=None).collect()]
    assert got == [(0, 2300, 0, 0, 2300), (2990, 1, 10, 0, 1)]


def test_ways_back_hold_few_columns(monkeypatch):
    """Starts on several levels and masks made again give the same way back."""
    r = random.Random(4)
    for held in (0, 450, 3000):
        monkeypatch.setattr(edits, "COLUMNS", held)
        monkeypatch.setattr(edits, "MASKS", held)
        for _ in range(150):
            a, b = ([str(r.randrange(4)) for _ in range(r.randint(0, 60))] for _ in range(2))
            assert align(a, b) == way_back(a, b) and distance(a, b) == table(a, b)[-1][-1]


def test_window_text_shuffles_no_word_with_its_segments_text(spark):
    s = spark.createDataFrame([(1, 0, 0, 4, "a b  c d"), (1, 1, 4, 8, "whole text")], "meeting_id int, seg_idx int, start int, end int, text string")
    w = spark.createDataFrame([(1, 0, k, k, k + 1, x) for k, x in enumerate("abcd")] + [(1, 0, 9, None, 3, "x"), (1, 0, 5, 2, 2, "y")], "meeting_id int, seg_idx int, word_idx int, start int, end int, word string")
    windows_ = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 6), (1, 2, 8, 9)], "meeting_id int, window_id int, start int, end int")
    out = intervals.window_text(windows_, s, w, 5)
    assert sorted((r.window_id, r.text) for r in out.collect()) == [(0, "a b"), (1, "c d whole text"), (2, "")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate(key" in x and "r_text" in x.split("functions=")[0]]


# manifests


def test_variants_that_extend_each_other(spark):
    rows = [
        ("m", "a", None, {"backend.id": "x", "backend.options.beam": "5"}), ("m", "b", "a", {"backend.options.beam": "9"}), ("m", "c", "b", {"backend.options": "[]"}),
        ("m", "lost", "nobody", {}), ("m", "p", "q", {}), ("m", "q", "p", {}), ("m", "r", "p", {}), ("m", "me", "me", {}), ("n", "a", None, {"k": "1"}), ("n", "two", None, {}), ("n", "two", "a", {}), ("n", "b", "a", None),
    ]
    v = spark.createDataFrame(rows, "manifest string, id string, extends string, options map<string,string>")
    base = spark.createDataFrame([("m", {"pipeline.mode": "one", "backend.id": "y"})], "manifest string, options map<string,string>")
    got = {(r.manifest, r.id): r for r in manifests.resolved(v, base).collect()}
    of = lambda m, i: (got[m, i].options, got[m, i].lineage, got[m, i].problem)
    assert of("m", "a") == ({"pipeline.mode": "one", "backend.id": "x", "backend.options.beam": "5"}, ["a"], None)
    assert of("m", "b")[0]["backend.options.beam"] == "9" and of("m", "b")[1] == ["b", "a"]
    assert of("m", "c") == ({"pipeline.mode": "one", "backend.id": "x", "backend.options": "[]"}, ["c", "b", "a"], None)
    assert of("m", "lost")[2] == "lost extends unknown nobody" and of("m", "lost")[0] is None
    assert [of("m", i)[2] for i in ("p", "q", "r", "me")] == ["cycle at p", "cycle at q", "cycle at p", "cycle at me"]
    assert of("n", "a")[0] == {"k": "1"} and of("n", "two")[2] == "duplicate id two" and of("n", "b")[0] == {"k": "1"}
    assert len(got) == 11


def test_variants_beyond_the_recursion_limit(spark):
    rows = [("m", f"v{k}", f"v{k - 1}" if k else None, {"k": str(k)}) for k in range(70)] + [("m", f"c{k}", f"c{(k + 1) % 8}", {}) for k in range(8)] + [("m", "into", "c3", {}), ("m", None, "v1", {})]
    v = spark.createDataFrame(rows, "manifest string, id string, extends string, options map<string,string>")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "60")
    try:
        got = {r.id: r for r in manifests.resolved(v).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert len(got) == 79 and got["v69"].lineage == [f"v{k}" for k in range(69, -1, -1)] and got["v69"].options == {"k": "69"}
    assert (got["into"].lineage, got["into"].problem) == (["into", "c3", "c4", "c5", "c6", "c7", "c0", "c1", "c2"], "cycle at c3")
    assert [got[f"c{k}"].problem for k in range(8)] == [f"cycle at c{k}" for k in range(8)]


# runs as a stream


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def put(folder, number, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{number}.json", "w") as f:
        for run, seq, minute, status in rows:
            f.write(json.dumps({"run_id": run, "seq": seq, "ts": at(minute).isoformat(), "status": status, "percent": 1.0, "stage": "s"}) + "\n")


def test_stream_restarts_and_stalls(spark, tmp_path):
    events, out, checkpoint = (str(tmp_path / x) for x in ("events", "out", "checkpoint"))
    go = lambda: runs.write_states(runs.states(runs.read_arrivals(spark, events, files=1)), out, checkpoint).awaitTermination()
    now = lambda: {r.run_id: (r.seq, r.status, r.events) for r in runs.latest_states(spark, out).collect()}
    put(events, 1, [("a", 1, 0, "running"), ("a", 2, 1, "running"), ("a", 1, 0, "running"), ("b", 1, 0, "running"), ("c", 1, 0, "completed")])
    go()
    assert now() == {"a": (2, "running", 2), "b": (1, "running", 1), "c": (1, "completed", 1)}
    put(events, 2, [("a", 2, 1, "running"), ("a", 1, 0, "running"), ("d", 1, 60, "running")])  # repeated ones, and time goes on
    go()  # from the checkpoint
    put(events, 3, [("d", 2, 61, "running"), ("b", 2, 2, "running")])  # b's is too late by now
    go()
    assert now() == {"a": (2, "stalled", 2), "b": (1, "stalled", 1), "c": (1, "completed", 1), "d": (2, "running", 2)}
    put(events, 4, [("a", 3, 62, "running")])
    go()
    assert now()["a"] == (3, "running", 3)
    folders = sorted(os.listdir(out))
    again = spark.read.schema(runs.STATE).parquet(f"{out}/{folders[0]}").count()
    assert again == 3 and len(folders) == len(set(folders))


def test_stream_of_runs_in_many_frames(spark, tmp_path):
    """A run's rows reach its state in frames that no order of time goes with."""
    events, out = str(tmp_path / "events"), str(tmp_path / "out")
    put(events, 1, [("a", k, (k * 7) % 40, "running") for k in range(40)] + [("a", k, (k * 7) % 40, "running") for k in range(0, 40, 3)])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 3)
    try:
        runs.write_states(runs.states(runs.read_arrivals(spark, events)), out, str(tmp_path / "checkpoint")).awaitTermination()
    finally:
        spark.conf.set(key, before)
    last = runs.latest_states(spark, out).first()
    assert (last.seq, last.events) == (17, 40)


def test_recorded_stage(spark, tmp_path):
    df = spark.createDataFrame([(k, "text") for k in range(50)], "k int, t string").repartition(3)
    event = writers.write_recorded(df, str(tmp_path), "stage", "run", 30).first()
    details = json.loads(event.details)
    size = sum(os.path.getsize(tmp_path / "stage" / f) for f in os.listdir(tmp_path / "stage") if f.startswith("part-"))
    assert (event.run_id, event.stage, event.percent, details["rows"], details["bytes"]) == ("run", "stage", 30.0, 50, size)
    assert spark.read.json(str(tmp_path / "stage")).count() == 50
    assert json.loads(writers.write_recorded(df.limit(0), str(tmp_path), "none", "run", 40).first().details)["rows"] == 0
