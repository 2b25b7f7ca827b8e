"""Each operator against brute force on small tables, and on odd ones: nulls, empty and long texts, ties, repeated rows,
empty tables, columns whose names clash."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import cotraining, decontamination, fingerprints, jaccard_join, pfair, sharding, suffix_dedup, token_counts, toxicity, url_lists
from spanloom.llm.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977}" for k in range(60_000))
ODD = [(None, "no id at all here", "en", "s1", 5), (None, None, None, None, None), (1, None, "en", None, 0), (2, "", "en", "s2", 0), (3, "a b", "en", "s2", 3), (4, "a b", "en", "s2", 3), (4, "a b", "en", "s2", 3), (4, "other words", "de", "s1", 11), (5, LONG, "en", "s1", len(LONG)), (6, "x" * 50_000, "en", "s1", 50_000), (7, " \n\t ", "fr", "s3", 4), (8, LONG, None, "s1", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def near(spark):
    """Chains and groups of near copies, so that links, leaders and components differ."""
    r, rows = random.Random(3), []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(r.choice([6, 40, 90]))]
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"e{r.randint(0, 30)}"
            rows.append((len(rows), " ".join(w).title() if r.random() < 0.3 else " ".join(w), "en", f"src{g % 3}", 0))
    return rows, spark.createDataFrame(rows, DOCS)


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def test_jaccard_components(near):
    rows, docs = near
    sets = {r[0]: shingles(r[1]) for r in rows}
    comp = components_of(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op1(docs).collect()}
    assert got == {k: (len(sets[k]), comp[k]) for k in sets}
    kept = {r.doc_id for r in jaccard_join.one_of_each(docs).collect()}
    assert kept == set(comp.values())


def test_jaccard_without_star_rounds(near):
    """The last step alone finds the same components."""
    rows, docs = near
    a = {r.doc_id: r.component_id for r in jaccard_join.op1(docs).collect()}
    b = {r.doc_id: r.component_id for r in jaccard_join.JaccardJoin(star_rounds=1).classes(docs).collect()}
    assert a == b


def test_jaccard_leader_fits_no_class(spark):
    """Two texts link although the leader of all their buckets is too long for either, so that leader rounds are empty."""
    word = lambda c, n: [f"{c}{k}" for k in range(n)]
    both, common, grown = word("s", 35), word("c", 20), word("x", 200)
    texts = [both + word("a", 5), both + word("b", 5), both + common, *(common + grown[: n - 20] for n in (20, 28, 40, 55, 77, 108, 151))]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 0) for k, t in enumerate(texts)], DOCS)
    for rounds in (2, 1, 0):
        out = {r.doc_id: r.component_id for r in jaccard_join.JaccardJoin(size=1, star_rounds=rounds).classes(docs).collect()}
        assert out == {k: 0 if k == 1 else k for k in range(len(texts))}, rounds


def test_jaccard_odd(odd, none):
    out = [tuple(r) for r in jaccard_join.op1(odd).collect()]
    assert Counter(out)[(4, 1, 3)] == 1 and (3, 1, 3) in out and (5, len(shingles(LONG)), 5) in out and (8, len(shingles(LONG)), 5) in out
    assert (1, 0, 1) in out and (2, 0, 2) in out and (None, 0, None) in out and (None, 1, None) in out
    assert jaccard_join.op1(none).count() == 0
    clash = odd.withColumns({c: F.lit(k) for k, c in enumerate(("token", "component_id", "comp", "th", "times", "id", "row", "_row", "__h"))})
    kept = jaccard_join.one_of_each(clash)
    # all but one of documents 5 and 8, of (4, "a b") and 3, of repeated rows
    assert kept.columns == clash.columns and sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == sorted(((k or 0, (t or "")[:5]) for k, t, *_ in ODD if k != 8 and (k, t) != (4, "a b")))


def test_one_of_each_keeps_other_texts_of_a_doc_id(spark):
    """A doc_id with two texts that aren't alike loses neither; repeated rows count once."""
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (2, a, "en", "s", 0), (3, b, "en", "s", 0), (1, a, "de", "s", 0), (9, "lone", None, None, None), (9, "lone", None, None, None)]
    out = jaccard_join.one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in out if r.doc_id < 9) == [(1, a, "de"), (1, b, "en")] and [r.text for r in out if r.doc_id == 9] == ["lone"]


def components_of(sets, percent=75):
    """By brute force."""
    comp = {k: k for k in sets}
    while True:
        moved = False
        for a in sets:
            for b in sets:
                if comp[a] > comp[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[a]:
                    comp[a], moved = comp[b], True
        if not moved:
            return comp


def test_jaccard_nested_texts(spark):
    """Long texts that contain shorter ones lead their buckets without fitting them."""
    r = random.Random(12)
    for turn in range(4):
        pool, rows = [f"p{k}" for k in range(60)], []
        for _ in range(45):
            base = pool[(at := r.randrange(30)) : at + r.choice([8, 12, 20, 22, 30])]
            grown = base + [f"x{r.randrange(400)}" for _ in range(r.choice([0, 0, 1, 2, 40, 90]))]
            rows.append((len(rows), " ".join(grown), "en", "s", 0))
        docs = spark.createDataFrame(rows, DOCS)
        want = components_of({k: shingles(t, 1) for k, t, *_ in rows})
        got = {x.doc_id: x.component_id for x in jaccard_join.JaccardJoin(size=1, star_rounds=turn % 3).classes(docs).collect()}
        assert got == want


def test_jaccard_orders_filter(spark):
    """Candidates of order 1 that don't meet under the other orders never reach verification; all links do."""
    r, rows = random.Random(13), []
    for k in range(40):
        rows.append((k, " ".join(["rare"] * 0 + [f"s{k // 2}"] + [f"c{r.randrange(150)}" for _ in range(24)]), "en", "s", 0))
    docs, sets = spark.createDataFrame(rows, DOCS), {k: shingles(t, 1) for k, t, *_ in rows}
    seen = []

    class Watched(jaccard_join.JaccardJoin):
        def _filtered(self, pairs, live):
            out = super()._filtered(pairs, live)
            seen.append((pairs.count(), out.count()))
            return out

    got = {x.doc_id: x.component_id for x in Watched(size=1, star_rounds=0).classes(docs).collect()}
    assert got == components_of(sets) and seen[-1][1] < seen[-1][0]


def repeated_texts(seed, n=60):
    r, rows = random.Random(seed), []
    shared = ["".join(r.choice("abc ") for _ in range(n)) for n in (150, 260, 330, 700)]
    for k in range(n):
        parts = ["".join(r.choice("abcdef é") for _ in range(r.randint(0, 220))) for _ in range(3)]
        parts.insert(r.randint(0, 3), r.choice(shared)[r.randint(0, 60) :])
        rows.append((k, "".join(parts)))
    return rows + [(100, "z" * 900), (101, rows[0][1]), (102, ("ab" * 120) + rows[1][1]), (103, None), (104, ""), (None, rows[2][1]), (None, "null id " + rows[3][1]), (7, "another text of 7 " + rows[4][1]), (50, rows[50][1])]


def cut_by_force(rows, keep_first):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each row, by all strings of 200 bytes."""
    texts = [(t or "").encode() for _, t in rows]
    low = {}
    for (k, _), b in zip(rows, texts, strict=True):
        low[b] = min(low.get(b, (True, 0)), (k is None, k or 0))
    order = sorted(range(len(rows)), key=lambda i: (low[texts[i]], hashlib.md5(texts[i]).hexdigest(), rows[i][0] is None, rows[i][0] or 0))
    seen = Counter(b[p : p + 200] for b in texts for p in range(len(b) - 199))
    out, before = [], set()
    for i in order:
        b, gone = texts[i], bytearray(len(texts[i]))
        for p in range(len(b) - 199):
            if b[p : p + 200] in before if keep_first else seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
            before.add(b[p : p + 200])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((rows[i][0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("keep_first", [False, True])
def test_suffixes(spark, keep_first, monkeypatch):
    """Against brute force, with equal texts, null and repeated ids, with common anchors cut into strings or not."""
    rows = repeated_texts(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = cut_by_force(rows, keep_first)
    for many in (1200, 4):
        monkeypatch.setattr(suffix_dedup, "MANY", many)
        assert Counter(map(tuple, suffix_dedup.removed(docs, keep_first=keep_first).drop("spans").collect())) == want, many


def test_longest_factors():
    r = random.Random(7)
    for _ in range(60):
        t = "".join(r.choice("ab") for _ in range(r.randint(1, 14)))
        order = sorted(range(len(t)), key=lambda k: t[k:])
        common = lambda i, j: next((k for k in range(len(t)) if i + k >= len(t) or j + k >= len(t) or t[i + k] != t[j + k]), len(t))
        lcp = [0, *(common(a, b) for a, b in zip(order, order[1:], strict=False))]
        for rank in (np.arange(len(t)), -np.arange(len(t)), np.array(r.sample(range(len(t)), len(t)))):
            got = suffix_dedup.longest_factors(np.array(order), np.array(lcp), rank)
            assert got.tolist() == [max((common(i, j) for j in range(len(t)) if rank[j] < rank[i]), default=0) for i in range(len(t))]


def test_suffixes_by_factors(monkeypatch):
    """Strings that share their anchor and both ends and differ between are told apart by their factors alone."""
    r = random.Random(3)
    size, bodies = 200, []
    core = bytes(r.randrange(97, 123) for _ in range(260))
    for k in range(20):
        body = bytearray(core)
        body[90 + k % 3] = 65 + k % 3  # before the anchor
        body[150 + k % 4] = 65 + k % 2  # behind it
        bodies.append(bytes(body))
    n, left = len(bodies), 110
    zeros, ranks = np.zeros(n, np.int64), np.arange(n)

    def found(keep_first):
        got = suffix_dedup.covered(zeros, bodies, np.full(n, left), np.ones(n, np.int64), ranks, size, keep_first)
        return [(int(c), int(x), bool(b if keep_first else a)) for c, x, a, b in zip(*got, strict=True)]

    for keep_first in (False, True):
        got = found(keep_first)
        for c, x, flag in got:
            others = range(c) if keep_first else [k for k in range(n) if k != c]
            assert flag == any(bodies[k][x : x + size] == bodies[c][x : x + size] for k in others)
        assert {f for *_, f in got} == {False, True}
        for constant in (0, size):
            with monkeypatch.context() as m:
                m.setattr(suffix_dedup, "longest_factors", lambda order, lcp, rank, constant=constant: np.full(len(order), constant))
                assert found(keep_first) != got


def test_suffixes_odd(odd, none):
    out = suffix_dedup.removed(odd).collect()
    assert len(out) == len(ODD) and all(r.n_removed == r.n_bytes for r in out if r.doc_id in (5, 6, 8)) and suffix_dedup.removed(none).count() == 0


def test_fingerprints(spark, odd, none):
    out = fingerprints.against_next(odd.where("doc_id in (3, 5, 7)").withColumn("at", F.lit(0))).orderBy("doc_id").collect()
    texts = {3: "a b", 5: LONG, 7: " \n\t "}
    for r, after in zip(out, (7, 3, 5), strict=True):
        t = texts[r.doc_id]
        e = t[: len(t) - len(t) // 3] + texts[after][: len(t) // 3]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.tree(t).text, fingerprints.tree(e).text)
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint)
    assert fingerprints.against_next(odd).count() == len(ODD) and fingerprints.against_next(none).count() == 0
    assert fingerprints.against_next(odd.where("doc_id = 3")).first().near_next == 1.0


def test_likeness_by_force(spark):
    """near_edited and near_next are the share of runs in common, worked out without any tree; the tree comes back from its text."""
    from spanloom.llm.bytetext import Words

    r, rows = random.Random(14), []
    lines = [" ".join(r.choice("red green blue grey ash oak elm".split()) for _ in range(r.randint(0, 9))) for _ in range(12)]
    for k in range(40):
        rows.append((k, r.choice(["\n", "\r\n", "\n\n"]).join(r.choice(lines) for _ in range(r.randint(0, 12)))))
    rows += [(40, None), (41, ""), (42, "\n \n"), (43, "\n\n")]

    def runs(text):
        out = Counter()
        for line in text.split("\n"):
            now = []
            for w in line.encode().split():
                now.append(w)
                if not int(Words([w], lower=False).hash[0]) & 3:
                    out[tuple(now)] += 1
                    now = []
            out[tuple(now)] += bool(now)
        return +out

    def alike(x, y):
        a, b = runs(x), runs(y)
        total = a.total() + b.total()
        return 1.0 if x == y else 2 * (a & b).total() / total if total else 0.0

    texts = {k: t or "" for k, t in rows}
    for x in fingerprints.against_next(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        t, after = texts[x.doc_id], texts[x.doc_id - 1 if x.doc_id else 43]
        e = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert (x.near_edited, x.near_next) == (pytest.approx(alike(t, e)), pytest.approx(alike(t, after))), x.doc_id
        assert fingerprints.Tree.of(x.fingerprint).text == x.fingerprint


def test_differences():
    a = "\n".join(f"line {k} of the text" for k in range(40))
    b = a.replace("line 20 of", "line twenty of")
    x, y = fingerprints.tree(a), fingerprints.tree(b)
    ((p, q), (u, v)), = fingerprints.differences(x, y)
    assert a.encode()[p:q] == b"line 20 of the text\n" and b.encode()[u:v] == b"line twenty of the text\n" and fingerprints.differences(x, x) == []


def test_contained(spark, odd, none):
    item = " ".join(f"q{k}" for k in range(24))
    docs = odd.unionByName(spark.createDataFrame([(20, f"{LONG} {item.upper()}, end", "en", "s", 1), (21, " ".join(item.split()[:20]), "en", "s", 1), (22, " ".join(item.split()[:12]), "en", "s", 1)], DOCS))
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "a b"), (5, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contained(docs, items).collect()}
    assert got == {(20, 1), (20, 5), (21, 1), (21, 5), (3, 4), (4, 4)}
    left = decontamination.clean(docs.withColumn("item_id", F.lit(1)), items)
    assert left.count() == docs.count() - 5 and left.columns[-1] == "item_id"
    assert decontamination.contained(none, items).count() == 0 and decontamination.contained(docs, items.limit(0)).count() == 0


def test_store(spark, odd, none, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "s"), target=1000)
    store.append(odd.where("doc_id < 4 or doc_id is null"), F.lit(0))
    store.append(odd.where("doc_id in (4, 7)"), F.lit(0))
    store.append(odd.where("doc_id > 4 and doc_id <> 7"), F.col("doc_id") % 2)
    before = sorted(map(str, odd.collect()))
    assert store.version() == 3 and sorted(map(str, store.read().collect())) == before
    assert store.compact() == 4 and sorted(map(str, store.read().collect())) == before and store.compact() == 4
    assert sorted(map(str, store.read(3).collect())) == before  # earlier versions hold until vacuum
    assert store.manifest().select("file").distinct().count() < store.manifest(3).select("file").distinct().count()
    with pytest.raises(Exception, match="(?i)exist"):
        store._commit(store.manifest(), 3)  # another writer was first
    with pytest.raises(ValueError, match="in use"):
        store.append(odd, F.lit(0), first=1)
    store.vacuum()
    again = sharding.Store(spark, str(tmp_path / "s"), target=1000)  # opened anew, and given rows of other columns
    assert sorted(map(str, again.read().collect())) == before
    again.append(spark.createDataFrame([(9, "x", 1)], "doc_id long, text string, file long"), F.lit(0))
    assert [r.file for r in again.read().collect() if r.doc_id == 9] == [1] and again.read().count() == len(ODD) + 1
    clash = odd.withColumns({c: F.lit(k) for k, c in enumerate(("row", "shard", "size", "file", "number", "path", "p", "own"))})
    assert sharding.sharded(none).count() == 0
    for ordered in (False, True):
        assert sorted(r.n_bytes for r in sharding.sharded(clash, ordered=ordered).collect()) == sorted(len((x[1] or "").encode()) for x in ODD)


def test_store_arrivals(spark, odd, tmp_path):
    """Arrivals written in one pass are versions of their own, numbered after the shards that are there; one has no rows."""
    store = sharding.Store(spark, str(tmp_path / "s"), target=1000)
    store.append(spark.createDataFrame([(70, "x"), (71, "y")], "doc_id long, text string"), F.col("doc_id") - 70)
    named = odd.withColumns({"change": F.lit("c"), "file": F.lit(1)})
    number = F.when(F.col("doc_id") > 4, 5).otherwise(F.coalesce(F.col("doc_id") % 2, F.lit(0)))  # shards 0 and 1, then 4 and 5
    seen = []
    for version in store.append_each(named, number, 2, 3):
        seen.append((version, store.read().count()))
        if version == 2:
            assert store.compact() == 3
    late = odd.where("doc_id > 4").count()
    assert seen == [(2, 2 + len(ODD) - late), (4, 2 + len(ODD) - late), (5, 2 + len(ODD))]
    assert {r.shard for r in store.manifest().collect()} == {0, 1, 2, 3, 7}
    assert sorted(map(str, store.read().where("doc_id is null or doc_id < 70").select(named.columns).collect())) == sorted(map(str, named.collect()))
    with pytest.raises(ValueError, match="isn't in 0 to 3"):
        list(store.append_each(odd, F.lit(4), 2, 2))
    assert store.version() == 5 and store.read().count() == 2 + len(ODD)


def test_store_tiers_cascade(spark, tmp_path):
    """Merged files that fill the next tier are merged on in one rewrite; files of half the target and more stay."""
    store = sharding.Store(spark, str(tmp_path / "s"), target=1000)
    rows = [(k, "x" * (100 if k < 4 else 210 if k < 6 else 600)) for k in range(8)]
    store.append(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id"))
    store.compact()
    got = {r["row"].doc_id: (r.file, r.file_rows, r.file_bytes) for r in store.placed().collect()}
    assert got == {k: ("m0", 6, 820) if k < 6 else (f"s{k}", 1, 600) for k in range(8)}


def test_urls(spark):
    entries = spark.createDataFrame([("bad.org", 10, 0, "on"), ("bad.org", 20, 0, "off"), ("bad.org", 200, 0, "on"), ("x.net/ads", 5, 0, "on"), ("tie.com", 5, 1, "off"), ("tie.com", 5, 0, "on"), (None, 1, 0, "on"), ("n.com", None, 0, "on")], "rule string, day long, seq int, action string")
    urls = ["http://a.bad.org/x", "https://u@BAD.org:80", "http://notbad.org/", "http://x.net/ads/1?q", "http://x.net/adsy", "http://tie.com/", "", None, "no url"]
    rows = [(k * 1000 + d, u, d) for k, u in enumerate(urls) for d in (0, 7, 10, 19, 20, 199, 200, 364)] + [(9999, urls[0], None)]
    got = {r.capture_id: (r.blocked, r.rule, r.since) for r in url_lists.judged(spark.createDataFrame(rows, "capture_id long, url string, day long"), entries).collect()}
    for k, u, d in rows:
        bad = d is not None and k // 1000 in (0, 1) and (10 <= d < 20 or d >= 200)
        ads = d is not None and k // 1000 == 3 and d >= 5
        assert got[k] == ((True, "bad.org", 10 if d < 20 else 200) if bad else (True, "x.net/ads", 5) if ads else (False, None, -1)), (u, d)
    assert url_lists.op5(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    clash = spark.createDataFrame([(1, "http://bad.org/", 15, "x", "y")], "capture_id long, url string, day long, rule string, period string")
    assert url_lists.judged(clash, entries).first().blocked and not url_lists.judged(clash, entries.limit(0)).first().blocked


def test_long_urls(spark):
    """URLs of a megabyte, with as many directories, labels, or neither."""
    entries = spark.createDataFrame([("bad.org/a/b", 0, 0, "on"), ("y.z", 0, 0, "on")], "rule string, day long, seq int, action string")
    urls = ["http://bad.org/a/b" + "/d" * 500_000, "http://bad.org/a" + "/d" * 500_000, "http://" + "q." * 500_000 + "y.z/", "http://bad.org/a/b/" + "x" * 1_000_000]
    rows = spark.createDataFrame([(k, u, 5) for k, u in enumerate(urls)], "capture_id long, url string, day long")
    assert {r.capture_id: r.rule for r in url_lists.judged(rows, entries).collect()} == {0: "bad.org/a/b", 1: None, 2: "y.z", 3: "bad.org/a/b"}


def test_rules_of_every_depth(spark):
    """All suffixes and heads that plain Python finds, within the depth asked for."""
    urls = ["http://a.b.c.d/x/y//z?q", "http://only/x", "http://b.c", "ftp://u@B.c:80/x#f", "bad", None]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    for labels, heads in ((9, 9), (2, 1), (3, 0), (1, 2)):
        for u, got in frame.select("url", url_lists.rules_of(F.col("url"), labels, heads).alias("r")).collect():
            if u in ("bad", None):
                assert not got
                continue
            host, path = {0: ("a.b.c.d", "x/y/z"), 1: ("only", "x"), 2: ("b.c", ""), 3: ("b.c", "x")}[urls.index(u)]
            h, p = host.split("."), [x for x in path.split("/") if x]
            want = {".".join(h[-k:]) + "".join("/" + x for x in p[:j]) for k in range(min(2, len(h)), min(labels, len(h)) + 1) for j in range(min(heads, len(p)) + 1)}
            assert set(got or []) == want, (u, labels, heads)


def test_token_counts(odd, none):
    from tokenizers import Tokenizer, models

    scores, least = token_counts.read_model()
    vocabulary = token_counts.Vocabulary(scores, least, remembered=50)
    pieces = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *scores.items(), ("￿", least)]
    model = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    r = random.Random(8)
    texts = ["".join(r.choice("ab é☃\n  ▁etr.ß漢") for _ in range(r.randint(1, 40))) for _ in range(300)] + [t for t in (x[1] for x in ODD) if t and len(t) < 100]
    for t in texts:
        assert vocabulary.count(t)[0] == len(model.encode("▁" + t.replace(" ", "▁")).ids), t
        assert vocabulary.count(t) == vocabulary.best("▁" + t.replace(" ", "▁"))
    out = {r.doc_id: r.n_tokens for r in token_counts.token_counts(odd, scores, least).collect()}
    assert out[1] == out[2] == 0 and out[5] == out[8] and token_counts.token_counts(none, scores, least).count() == 0


def test_toxicity(spark, odd, none):
    r, rows, labels = random.Random(9), [], []
    for k in range(900):
        bad = k % 3 == 0
        w = [r.choice(["tree", "river", "stone", "cloud", "grass", "moss"]) + r.choice(["", "y", "en"]) for _ in range(r.randint(5, 80))]
        if bad:
            w[r.randrange(len(w))] = r.choice(["vilex", "vilor", "vilun"])
        rows.append((k, " ".join(w), "en", "s", 1))
        labels.append((k, int(bad)))
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.scored(docs, known).toPandas()
    held = out[out.held_out]
    assert len(out) == 900 and list(out.held_out) == [toxicity.held_out(k) for k in out.doc_id]
    assert ((held.predicted == 1) == (held.doc_id % 3 == 0)).mean() > 0.9
    few = toxicity.Fit(rows=40, epochs=1)
    assert toxicity.scored(docs, known, toxicity.Fit(rows=40, epochs=1, megabytes=0.001)).count() == 900
    assert toxicity.scored(odd.withColumn("score", F.lit(0)), known, few).count() == len(ODD)
    assert toxicity.scored(none, known, few).count() == 0 and toxicity.scored(docs, known.limit(0), few).where("predicted = 1").count() == 0


def test_toxicity_scores_by_force():
    """The scores of a network with random weights, against one that reads word by word in plain Python."""
    from math import exp, tanh

    from spanloom.llm.bytetext import Words, mix

    p = {k: v.astype(float) for k, v in toxicity._start(3).items()}
    r = random.Random(15)
    texts = [" ".join(r.choice(["Tree", "river", "rivers", "stone42", "straße", "x", "tree"]) for _ in range(n)) for n in (0, 1, 2, 23, 24, 25, 43, 90)] + ["a-b!c", "..", "same same SAME other"]
    sig = lambda x: 1 / (1 + exp(-x))
    h = toxicity.HIDDEN

    def vector(word):
        hashed = int(Words([word], lower=False, space=toxicity._BREAK).hash[0])
        chars, rows = [1, *word, 2], []
        for k in (3, 4):
            for at in range(len(chars) - k + 1):
                code = 0
                for c in chars[at : at + k]:
                    code = (code * 257 + c) % (1 << 64)
                rows.append(int(mix(np.array([(code + (k << 40)) % (1 << 64)], np.uint64))[0]) % toxicity.CHAR_ROWS)
        own = [p["char"][g] for g in rows]
        return [*p["word"][hashed % toxicity.WORD_ROWS], *np.mean(own, axis=0), max(x[0] for x in own)]

    def states(window, s):
        state, out = [0.0] * h, {}
        for t in range(len(window)) if s == "f" else reversed(range(len(window))):
            x = np.array(vector(window[t])) @ p[f"x{s}"] + p[f"c{s}"]
            u = p[f"u{s}"]
            z, k = ([sig(x[o + i] + sum(state[j] * u[j, o + i] for j in range(h))) for i in range(h)] for o in (0, h))
            new = [tanh(x[2 * h + i] + sum(k[j] * state[j] * u[j, 2 * h + i] for j in range(h))) for i in range(h)]
            state = [z[i] * state[i] + (1 - z[i]) * new[i] for i in range(h)]
            out[t] = state
        return out

    def score(text):
        low = "".join(c.lower() if c.isascii() else c for c in text).encode()
        words = [w for w in bytes(c if not toxicity._BREAK[c] else 32 for c in low).split(b" ") if w]
        words = [w for k, w in enumerate(words) if not k or w != words[k - 1]]
        best = []
        for at in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP):
            window = words[at : at + toxicity.WINDOW]
            f, b = states(window, "f"), states(window, "b")
            joint = [np.array([*f[t], *b[t]]) for t in range(len(window))]
            share = [exp(float(np.tanh(v @ p["a"]) @ p["v"])) for v in joint]
            best.append(float(p["k"][0]) + (sum(w * float(v @ p["o"]) for w, v in zip(share, joint, strict=True)) / sum(share) if window else 0))
        return sig(max(best))

    got = toxicity.scores(toxicity._start(3), [t.encode() for t in texts])
    assert got.tolist() == pytest.approx([score(t) for t in texts], abs=1e-5)


def test_toxicity_gradient():
    p = {k: v.astype(np.float64) for k, v in toxicity._start(1).items()}
    text = toxicity.Text([b"one two three four one", b"two"])
    y = np.array([1.0, 0.0])

    def loss(q):
        v, _ = toxicity._vectors(q, text)
        z, _ = toxicity._forward(q, text, text.index, v.astype(np.float64))
        return float((np.log1p(np.exp(z)) - y * z).sum())

    v, lookup = toxicity._vectors(p, text)
    v = v.astype(np.float64)
    z, made = toxicity._forward(p, text, text.index, v, keep=True)
    grad = {k: np.zeros_like(x) for k, x in p.items()}
    toxicity._backward(p, text, text.index, v, made, lookup, 1 / (1 + np.exp(-z)) - y, grad)
    for k in ("xf", "ub", "cf", "a", "v", "o", "k"):
        at = tuple(np.argwhere(np.abs(grad[k]) == np.abs(grad[k]).max())[0])
        up, down = ({n: x.copy() for n, x in p.items()} for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        assert grad[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-3, rel=0.02, abs=2e-4), k


def test_cotraining(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = cotraining.scored(docs, labels).join(labels, "doc_id").toPandas()
    assert (out.keep == (out.quality == 1)).mean() > 0.95 and (out[out.quality == 1].keep).mean() > 0.98
    kept = cotraining.kept(docs.withColumn("score", F.lit(1)), labels)
    assert kept.columns[-1] == "score" and kept.count() == cotraining.scored(docs, labels).where("keep").count()
    assert cotraining.scored(odd, labels).count() == len(ODD) and cotraining.scored(none, labels).count() == 0
    assert cotraining.kept(odd, labels.limit(0)).count() == len(ODD)


def test_cotraining_held_out(spark):
    """Learns from two thirds of the labels, by id, and is right on the last third."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = cotraining.scored(docs, labels.where("crc32(string(doc_id)) % 3 <> 1")).join(labels.where("crc32(string(doc_id)) % 3 = 1"), "doc_id").toPandas()
    assert len(out) > 1000 and (out.keep == (out.quality == 1)).mean() > 0.95


def plain_cotraining(text, meta, label, pool_text, pool_meta, fit):
    """The same exchange with every pseudo-labelled row spelled out, by gradient steps with a line search on plain arrays."""

    def descend(x, y, weight):
        x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        w, ridge = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 1e-6)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            h = x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(ridge + 1e-9)
            w = w - np.clip(np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge * w), -5, 5)
        return w

    at = np.arange(len(label))
    held, learn = at % 4 == 3, at % 4 != 3
    views, pools = [], []
    for x, q in ((text, pool_text), (meta, pool_meta)):
        m, s = x[learn].mean(0), np.maximum(x[learn].std(0), 1e-3)
        views.append((x - m) / s)
        pools.append((q - m) / s)
    pseudo = [np.full(len(pool_text), -1)] * 2
    for turn in range(fit.rounds + 1):
        odds = []
        for v in (0, 1):
            some = pseudo[1 - v] >= 0
            trust = 0.5 * min(1, learn.sum() / max(1, some.sum()))
            w = descend(np.concatenate([views[v][learn], pools[v][some]]), np.concatenate([label[learn], pseudo[1 - v][some]]), np.concatenate([np.ones(learn.sum()), np.full(some.sum(), trust)]))
            z = np.concatenate([views[v], pools[v]]) @ w[:-1] + w[-1]
            x = np.stack([z[: len(label)][held], np.ones(held.sum())], axis=1)
            c = np.zeros(2)
            for _ in range(60):
                p = 1 / (1 + np.exp(-x @ c))
                c = c - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag([0.1, 1e-6]), x.T @ (p - label[held]) + [0.1, 1e-6] * c)
            odds.append(c[0] * z + c[1])
        pseudo = [np.where(o[len(label) :] >= np.log(19), 1, np.where(o[len(label) :] <= -np.log(19), 0, -1)) for o in odds]
    return [1 / (1 + np.exp(-o[len(label) :])) for o in odds]


def test_cotraining_against_plain(spark):
    """Counts by code and sums by task give what all rows spelled out give, in memory and by Spark."""
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 3000)
    text = (r.normal(0, 1, (3000, cotraining.N_TEXT)) + np.outer(y, np.linspace(0, 0.9, cotraining.N_TEXT))).astype(np.float32).astype(float)
    codes = cotraining.meta_codes(["en"] * 3000, [f"s{k}" for k in y * 3 + r.integers(0, 4, 3000)], [100] * 3000)
    known, rest = slice(0, 160), slice(160, 3000)
    fit = cotraining.Fit(steps=30)
    a, b = plain_cotraining(text[known], cotraining.meta_features(codes[known]), y[known], text[rest], cotraining.meta_features(codes[rest]), fit)
    rows = spark.createDataFrame([(bytearray(t.astype(np.float32).tobytes()), int(c)) for t, c in zip(text[rest], codes[rest], strict=True)], "text binary, code int").repartition(5)
    for pool in (cotraining.Pool(text[rest], codes[rest]), cotraining.Table(rows)):
        m = cotraining.train(text[known], codes[known], y[known], pool, fit)
        got = m.score(text[rest], codes[rest])
        assert m.exchanged[0] > 400 and m.exchanged[1] > 400
        assert np.abs(got[0] - a).max() < 1e-3 and np.abs(got[1] - b).max() < 1e-3
    assert ((m.score(text[rest], codes[rest])[2] > 0.5) == y[rest]).mean() > 0.9


def test_pfair(spark, odd, none):
    r = random.Random(10)
    for _ in range(60):
        w = [r.randint(1, 9) for _ in range(r.randint(1, 9))]
        done = [0] * len(w)
        for t, s in enumerate(pfair.period(w), 1):
            done[s] += 1
            assert all(abs(d - x * t / sum(w)) < 1 for d, x in zip(done, w, strict=True))
    docs = spark.createDataFrame([(k, "s1" if k % 3 else "s2", 0) for k in range(500)], "doc_id long, source string, row long")
    out = pfair.schedule(docs, pfair.by_number(F.col("source")), 4).toPandas()
    assert ((out.release <= out.slot) & (out.slot < out.deadline)).all()
    for s, g in out.groupby("source"):
        assert list(g.sort_values("at").doc_id) == sorted(g.doc_id) and sorted(g["at"]) == list(range(len(g)))
    clash = odd.withColumns({c: F.lit(k) for k, c in enumerate(("slot", "row", "key", "name", "of", "k", "s", "o", "at", "__row", "__slot"))}).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    mixed = pfair.mixed(clash, pfair.by_number(F.col("source")))
    assert mixed.columns == clash.columns and sorted(map(str, mixed.collect())) == sorted(map(str, clash.collect())) and pfair.mixed(none, pfair.by_number(F.col("source"))).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    from oracle import by_spark, by_sql

    assert by_spark(spark, QUERIES[name]) == by_sql(ORACLES[name])


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = corpus_pipeline.run(spark, DATA).toPandas()
    good = {r.doc_id for r in cotraining.scored(docs, labels).where("keep").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    sets = {k: shingles(t) for k, t in texts.items()}
    comp = {k: k for k in texts}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[a]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    leaks = {r.doc_id for r in decontamination.contained(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert sorted(out.doc_id) == sorted(k for k in texts if comp[k] == k and k not in leaks)


def test_pipeline_shards_follow_mix(spark, tmp_path):
    """The first shards, up to any one, hold each source to within a block of its weight, until a source has run out."""
    n, weights = 1600, {"src1": 2, "src2": 3, "src3": 4}
    rows = [(k * n + i, f"{s} {i} " + "word " * 20, "en", s, 0) for k, s in enumerate(weights) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS)
    corpus_pipeline.mix(spark, docs, DATA).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))
    shard = {r.doc_id: r.shard for r in corpus_pipeline.shard(spark, mixed, DATA).collect()}
    assert len(shard) == 3 * n and set(shard.values()) == set(range(8))
    checked = 0
    for last in range(8):
        done = Counter(s for i, _, _, s, _ in rows if shard[i] <= last)
        if max(done.values()) < n:
            total = sum(done.values())
            assert all(abs(done[s] - total * w / 9) < 16 for s, w in weights.items()), (last, done)
            checked += 1
    assert checked >= 4
    sizes = Counter(shard.values())
    assert max(sizes.values()) - min(sizes.values()) <= 32


def test_pipeline_odd_tables(spark, odd, none, tmp_path):
    """Nulls, empty and long texts, repeated rows, an empty table, and columns of any name."""
    names = ("row", "shard", "at", "th", "times", "_row", "label", "text_", "view", "__view", "key", "slot")
    clash = odd.withColumns({c: F.lit(k) for k, c in enumerate(names)})
    for table, rows in ((clash, 11), (none.withColumn("slot", F.lit(1)), 0)):
        docs = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, DATA)
            assert name == "shard" or out.columns == table.columns
            out.write.parquet(path := str(tmp_path / f"{rows}-{k}"))
            docs = spark.read.parquet(path)
        assert docs.count() <= rows and (docs.count() > 0) == (rows > 0)
