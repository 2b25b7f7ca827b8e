"""Search by index, language models and files of their own: against plain versions, on small and uneven tables."""

from __future__ import annotations

import math
import os
import random
import shutil
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.operators import keyword_index, language_model, search, vector_cells
from spanloom.operators.keyword_index import KeywordIndex
from spanloom.operators.vector_cells import VectorCells
from spanloom.plans.catalog import QUERIES
from spanloom.sources import readers, single_files, writers

TENTH = "/root/testdata/sf0.1"


# keywords


def turns(seed, n, start=0):
    r = random.Random(seed)
    words = ["common"] * 12 + [f"w{k}" for k in range(40)] + [f"rare{k}" for k in range(200)]
    return [(k // 7 + start, k % 7, r.choice(["user", "agent"]), " ".join(r.choice(words) for _ in range(r.choice([0, 3, 9, 30])))) for k in range(n)]


SEGMENTS = "meeting_id long, seg_idx int, speaker string, text string"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "keywords")
    made = KeywordIndex(spark, path, block=4, split=40)  # so that frequent words have many blocks, in several parts
    batches = [turns(1, 300), turns(2, 150, 1000)]
    for b in batches:
        made.add(spark.createDataFrame(b, SEGMENTS))
    return made, spark.createDataFrame([x for b in batches for x in b], SEGMENTS), path


@pytest.fixture(scope="module")
def asked(spark):
    r = random.Random(9)
    rows = [(k, [r.choice(["common", "w1", "w2", "w3", "rare5", "rare6", f"rare{r.randrange(200)}", "nowhere"]) for _ in range(r.choice([1, 2, 5, 9]))]) for k in range(30)] + [(99, []), (98, ["nowhere"])]
    return spark.createDataFrame(rows, "query_id int, terms array<string>")


def rows_of(df):
    return sorted((r.query_id, r.rank, r.meeting_id, r.seg_idx, r.score) for r in df.collect())


@pytest.mark.parametrize("top", [1, 5, 400])
def test_index_finds_what_the_scan_finds(index, asked, top):
    made, all_, _ = index
    assert rows_of(made.search(asked, top)) == rows_of(search.bm25(all_, asked, top))


def test_index_with_a_condition(spark, index, asked):
    made, all_, _ = index
    got = rows_of(made.search(asked, 5, keep=(F.col("speaker") == "user") & (F.col("meeting_id") >= 1000)))
    every = search.bm25(all_, asked, 10_000).join(all_.where("speaker = 'user' AND meeting_id >= 1000").select("meeting_id", "seg_idx"), ["meeting_id", "seg_idx"], "left_semi")
    assert got == rows_of(search.ranked(every.drop("rank"), 5, "meeting_id", "seg_idx"))


def test_index_reads_a_part(index, asked):
    made, _, _ = index
    got = made.read_share(asked, 1).agg(F.sum("postings").alias("p"), F.sum("read").alias("r")).first()
    assert 0 < got.r < 0.6 * got.p


def test_search_deals_each_posting_once(spark, tmp_path, monkeypatch):
    made = KeywordIndex(spark, str(tmp_path / "keywords"), block=4)
    made.add(spark.createDataFrame(turns(4, 200), SEGMENTS))
    asked = spark.createDataFrame([(k, ["common", "w1", f"w{k}"]) for k in range(20)], "query_id int, terms array<string>")
    monkeypatch.setattr(keyword_index, "PAIRS", 100)
    step = keyword_index._Search(made, asked, 5, 1.2, 0.75, None)
    met = step.partial(step.wanted.withColumn("bar", F.lit(-1.0)), step.promised, None)
    plan = met._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "meeting_id" in x]
    pairs = step.promised.agg(F.sum("n")).first()[0]
    assert len(dealt) == 1 and f", {-(-pairs // 100)}), REPARTITION_BY_NUM" in dealt[0] and "query_id" not in dealt[0]
    assert met.agg(F.sum("n")).first()[0] == pairs


def test_share_of_reads_sums_no_postings(spark, index, asked, monkeypatch):
    done = []
    partial = keyword_index._Search.partial
    monkeypatch.setattr(keyword_index._Search, "partial", lambda self, terms, read, level: (done.append(level), partial(self, terms, read, level))[1])
    index[0].read_share(asked, 5).collect()
    assert done == [0]  # only the first blocks, for the threshold


def test_index_batches_stay(spark, tmp_path):
    made = KeywordIndex(spark, str(tmp_path / "i"))
    assert made.batches() == [] and made.search(spark.createDataFrame([(1, ["x"])], "query_id int, terms array<string>")).collect() == []
    first = made.add(spark.createDataFrame(turns(3, 40), SEGMENTS))
    before = {p: os.stat(p).st_mtime_ns for p in files_below(first)}
    made.add(spark.createDataFrame(turns(4, 40, 500), SEGMENTS))
    assert before == {p: os.stat(p).st_mtime_ns for p in files_below(first)}
    torn = made.add(spark.createDataFrame(turns(5, 40, 900), SEGMENTS))
    os.remove(f"{torn.removeprefix('file:')}/sizes/_SUCCESS")  # as if it had been interrupted
    assert len(made.batches()) == 2


def files_below(folder):
    return [f"{d}/{x}" for d, _, names in os.walk(folder.removeprefix("file:")) for x in names]


# vectors


def test_cells_recall(spark):
    """Ids that 20 divides against all vectors: at least nine in ten of the five nearest."""
    exact = {(r.query_id, r.vec_id) for r in QUERIES["cosine_topk"](spark, TENTH).collect()}
    near = {(r.query_id, r.vec_id) for r in QUERIES["vector_cells_near"](spark, TENTH).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_cells_split_and_certain(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, [r.gauss(0, 1) + (5 if k % 3 == 0 else 0) for _ in range(8)]) for k in range(300)] + [(300, [0.0] * 8), (301, [1.0] * 8), (302, [1.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 10 = 0 OR vec_id > 299").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe"))
    cells = VectorCells(spark, str(tmp_path / "cells"))
    cells.build(v, cells=7, sample=100, split=20)
    assert cells._table("sizes").agg(F.max("parts")).first()[0] > 1
    want = by_rank(search.cosine(v, q, 4, rows=64))
    assert by_rank(cells.search(q, 4, near=2, certain=True, rows=5)) == want
    assert by_rank(search.cosine(v, q, 4)) == want
    plan = search.cosine(v, q, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def by_rank(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


# language models


def plain_model(sentences, order):
    """Probabilities of all n-grams and back-off weights of contexts, in plain Python."""
    full = Counter()
    for words, weight in sentences:
        x = ["<s>", *words, "</s>"]
        if words:
            for i in range(1, len(x)):
                full[tuple(x[max(0, i - order + 1) : i + 1])] += weight
    counts = {order: Counter({g: c for g, c in full.items() if len(g) == order})}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
        counts[n].update({g: c for g, c in full.items() if len(g) == n})
    p, gamma = {("<s>",): 1.0}, {}
    for n in range(1, order + 1):
        t = [sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4)]
        d = (0.5, 1.0, 1.5)
        if all(t):
            y = t[0] / (t[0] + 2 * t[1])
            own = tuple(j - (j + 1) * y * t[j] / t[j - 1] for j in (1, 2, 3))
            d = own if all(0 <= own[j - 1] <= j for j in (1, 2, 3)) else d
        total, taken = Counter(), defaultdict(float)
        for g, c in counts[n].items():
            total[g[:-1]] += c
            taken[g[:-1]] += d[min(c, 3) - 1]
        gamma.update({h: taken[h] / total[h] for h in total})
        size = len(counts[1]) + 1
        if n == 1:
            p[("<unk>",)] = gamma[()] / size
        for g, c in counts[n].items():
            lower = p[g[1:]] if n > 1 else 1 / size
            p[g] = (c - d[min(c, 3) - 1]) / total[g[:-1]] + gamma[g[:-1]] * lower
    return p, gamma


def likely(p, gamma, g):
    if g in p:
        return p[g]
    return gamma.get(g[:-1], 1.0) * likely(p, gamma, g[1:])


@pytest.fixture(scope="module")
def sentences():
    r = random.Random(6)
    return [([r.choice("a a a b b c d e f g h i j k".split()) for _ in range(r.randint(0, 9))], r.choice([1, 1, 2, 3])) for _ in range(200)] + [(["a", "<s>", "b"], 1)]


@pytest.fixture(scope="module", params=[2, 4])
def model(spark, sentences, request, tmp_path_factory):
    df = spark.createDataFrame(sentences, "words array<string>, weight int")
    made = language_model.LanguageModel(spark, str(tmp_path_factory.mktemp("lm") / "m"), request.param).train(df)
    return made, *plain_model([([w for w in s if w != "<s>"], n) for s, n in sentences], request.param)


def test_model_against_plain(model):
    made, p, gamma = model
    rows = {tuple(r.g.split(" ")): (r.logp, r.backoff) for r in made.rows().collect()}
    assert set(rows) == set(p)
    for g, (logp, backoff) in rows.items():
        assert math.isclose(logp, math.log10(p[g]), abs_tol=1e-9)
        assert math.isclose(backoff, math.log10(gamma.get(g, 1.0)) if len(g) < made.order else 0.0, abs_tol=1e-9)


def test_probabilities_sum_to_one(model):
    made, p, gamma = model
    vocabulary = [g[0] for g in p if len(g) == 1 and g != ("<s>",)]
    for h in [(), ("<s>",), ("a",), ("a", "b"), ("<s>", "a", "c"), ("nowhere",)]:
        h = h[-(made.order - 1) :]
        assert math.isclose(sum(likely(p, gamma, (*h, w)) for w in vocabulary), 1.0, abs_tol=1e-9)


def test_scores_and_arpa(spark, model, tmp_path):
    made, p, gamma = model
    asked = [(1, "a b c".split()), (2, "a zz b a b".split()), (3, []), (4, ["zz"]), (5, "k j i h a a a b b".split())]
    got = {r.id: r for r in made.score(spark.createDataFrame(asked, "id int, words array<string>"), "id").collect()}
    for k, words in asked:
        x = ["<s>", *(w if (w,) in p else "<unk>" for w in words), "</s>"]
        want = sum(math.log10(likely(p, gamma, tuple(x[max(0, i - made.order + 1) : i + 1]))) for i in range(1, len(x)))
        assert math.isclose(got[k].logp, want, abs_tol=1e-9) and got[k].n_words == len(words) and got[k].n_unknown == words.count("zz")
    made.write_arpa(str(tmp_path / "arpa"))
    text = "".join(open(tmp_path / "arpa" / f).read() for f in sorted(os.listdir(tmp_path / "arpa")) if f.startswith("part-"))
    assert text.startswith("\\data\\\nngram 1=") and text.rstrip().endswith("\\end\\")
    assert f"ngram {made.order}={sum(len(g) == made.order for g in p)}\n" in text and text.index("\\1-grams:") < text.index("\\2-grams:")
    assert {r.g: r.logp for r in language_model.read_arpa(spark, str(tmp_path / "arpa")).collect()} == {r.g: r.logp for r in made.rows().collect()}


def test_scores_deal_words_once_an_order(spark, model):
    made = model[0]
    s = spark.createDataFrame([(k, "a b c".split()) for k in range(9)], "k int, words array<string>")
    plan = made.score(s, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter") == made.order  # a lookup for each order, none for the backoffs by themselves


def test_highest_order_is_written_once(model):
    made = model[0]
    assert os.path.exists(f"{made.path}/p-{made.order - 1}") and not os.path.exists(f"{made.path}/p-{made.order}")


def test_discounts_fall_back():
    assert language_model.discounts([5, 0, 1, 1]) == (0.5, 1.0, 1.5) and language_model.discounts([10, 1, 100, 1]) == (0.5, 1.0, 1.5)
    assert all(0 < d < 3 for d in language_model.discounts([100, 40, 20, 12]))


# files


def test_files_round_trip(spark, tmp_path):
    rows = [(f"d{k % 3}/f{k}.bin", bytes([k]) * k) for k in range(40)] + [("top.txt", b"x"), ("null.txt", None)]
    folder = f"file:{tmp_path}/out"
    df = spark.createDataFrame(rows, "path string, content binary").repartition(5)
    single_files.write_files(df, folder)
    got = {r.path: bytes(r.content) for r in single_files.read_files(spark, folder).collect()}
    assert got == {p: c or b"" for p, c in rows}
    assert {r.path for r in single_files.read_files(spark, folder, "*.txt").collect()} == {"top.txt", "null.txt"}
    single_files.write_files(spark.createDataFrame([("top.txt", "new"), ("more.txt", "y")], "path string, content string"), folder)  # beside what is there
    assert single_files.read_files(spark, folder).count() == 43 and open(tmp_path / "out" / "top.txt").read() == "new"
    single_files.write_files(spark.createDataFrame([("only.txt", "z")], "path string, content string"), folder, "overwrite")
    assert [r.path for r in single_files.read_files(spark, folder).collect()] == ["only.txt"]
    assert os.listdir(tmp_path) == ["out"]


def test_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([("a.txt", "1"), ("../b.txt", "2")], "path string, content string").coalesce(1)
    with pytest.raises(Exception, match="below its folder"):
        single_files.write_files(bad, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_a_killed_task_leaves_no_half_file(spark, tmp_path):
    """An attempt that dies after some files: another writes them again, and only whole ones show."""
    import pyarrow as pa

    writer = single_files.FilesWriter(str(tmp_path / "out"), False)

    def dies():
        yield pa.RecordBatch.from_pydict({"path": ["a", "b"], "content": [b"1" * 10, b"2"]})
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(dies())
    assert not (tmp_path / "out").exists()
    done = writer.write(iter([pa.RecordBatch.from_pydict({"path": ["a", "b"], "content": [b"1" * 10, b"2"]})]))
    again = writer.write(iter([pa.RecordBatch.from_pydict({"path": ["a", "b"], "content": [b"1" * 10, b"2"]})]))  # speculation
    writer.commit([done, again])
    assert os.listdir(tmp_path) == ["out"] and sorted(os.listdir(tmp_path / "out")) == ["a", "b"] and (tmp_path / "out" / "a").read_bytes() == b"1" * 10


def test_manifests_of_a_folder(spark, tmp_path):
    good = '{"name": "n", "defaults": {"language": "en"}, "items": [{"id": "1", "reference": "r.json", "duration_limit": 2.5}, {"id": "2", "reference": "/r", "language": "ru", "hypothesis": "h/2.json"}]}'
    bad = {"keys": '{"nam": "n", "items": [{"id": "1", "reference": "r"}]}', "none": '{"name": "n"}', "twice": '{"items": [{"id": "1", "reference": "r"}, {"id": "1", "reference": "s"}]}', "lacks": '{"items": [{"id": "1"}]}', "own": '{"items": [{"id": "1", "reference": "r", "x": 1}]}', "torn": '{"items": ['}
    writers.write_files(spark.createDataFrame([("good.json", good), *((f"{k}.json", v) for k, v in bad.items())], "path string, content string"), f"{tmp_path}/m")
    rows = readers.read_corpora(spark, f"{tmp_path}/m", checked=False).collect()
    found = {r.path.rsplit("/", 1)[1][:-5]: r.problem for r in rows}
    assert found == {"good": None, "keys": "unknown keys of the manifest: nam", "none": "no items", "twice": "two items of one id", "lacks": "an item lacks id or reference", "own": "unknown keys of an item: x", "torn": "no JSON object"}
    one, two = sorted((r for r in rows if r.path.endswith("good.json")), key=lambda r: r.item_id)
    assert (one.language, one.duration_limit, one.reference.endswith("/m/r.json")) == ("en", 2.5, True) and (two.language, two.reference) == ("ru", "/r") and two.hypothesis.endswith("/m/h/2.json")
    with pytest.raises(Exception, match="unknown keys|no items|two items|lacks|JSON"):
        readers.read_corpora(spark, f"{tmp_path}/m").collect()


def test_presets_are_opened_once(spark, tmp_path):
    whole = lambda k: '{"id": "%s", "pipeline": {"language": "en"}, "backend": {"id": "b", "options": {"k": [1]}}}' % k
    (tmp_path / "one.json").write_text(whole("a"), encoding="utf-8-sig")
    (tmp_path / "two.json").write_text(f"[{whole('b')},\n{whole('c')}]")
    (tmp_path / "none.json").write_text("")
    (tmp_path / "_left.json").write_text("{}")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "x.json").write_text("{}")
    found = readers.read_presets(spark, str(tmp_path))
    shutil.rmtree(tmp_path)
    assert sorted((r.preset_id, r.description, r.pipeline, r.backend_id, r.options) for r in found.collect()) == [(k, None, '{"language":"en"}', "b", '{"k":[1]}') for k in "abc"]
    tmp_path.mkdir()
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(ValueError, match="lacks its id"):
        readers.read_presets(spark, str(tmp_path))


def counted(df):
    """``df``, and how many of its rows have been worked out so far."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_fit_reads_all_vectors_once(spark):
    v, seen = counted(spark.range(64).selectExpr("id AS vec_id", "array(sin(id), cos(id * 3), sin(id * 7)) AS embedding"))
    assert vector_cells.fitted(v, cells=4, sample=32, rounds=3).shape == (4, 3) and seen.value == 64


def test_language_corpus_cuts_texts_once(spark, tmp_path):
    s, seen = counted(spark.range(20).selectExpr("'a' AS label", "2 AS weight", "id AS doc_id", "0 AS pos", "concat('word ', id) AS sentence"))
    writers.write_language_corpus(s, str(tmp_path), 5)
    assert spark.read.text(f"{tmp_path}/corpus").count() == 40 and spark.read.text(f"{tmp_path}/vocab").first().value == "word" and seen.value == 20
