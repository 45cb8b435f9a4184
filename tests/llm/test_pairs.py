"""Joins, repeats and the pipeline against brute force."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheafline.llm import _graph, _store, decontaminate, embedding_join, ngram_join, repeats, secrets
from sheafline.llm._graph import components

from .conftest import prose, words


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def union(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def near(seed, text, changes):
    draw, w = random.Random(seed), text.split()
    for _ in range(changes):
        w[draw.randrange(len(w))] = prose(draw.random(), 1)
    return " ".join(w)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[x] for x in (1, 2, 3, 7, 8, 9)} == {1} and got[21] == 20 and {got[100 + i] for i in range(31)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_plans_of_components_are_short(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(_graph, "written", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), _store.written(df))[1])
    components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")).count()
    assert len(plans) > 5 and max(p.count("Relation [") for p in plans) <= 3 and not any("strategy=broadcast" in p for p in plans)
    star = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1010)]  # a node with more edges than others may have
    got = {r.node: r.root for r in components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert {got[i] for i in range(400)} == {0} and {got[i] for i in range(1000, 1011)} == {1000}


def test_ngram_join_is_brute_force(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)  # a group over several blocks
    base = prose(70, 90)
    texts = [near(i, base, i % 9) for i in range(60)] + [near(i, prose(71, 60), i % 3) for i in range(9)]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more).withColumn("class", F.lit("clash"))
    got = {r.doc_id: r for r in ngram_join.near_duplicates(docs).collect()}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [grams(t) for _, t in rows]
    links = [(a, b) for b in range(len(rows)) for a in range(b) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    root, n = union(len(rows), links), [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    found = sum(r.n_links for r in got.values())
    assert found >= 0.99 * sum(n) - 2
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            assert (got[doc_id].n_links, got[doc_id].component_id) == (n[i], rows[root[i]][0]), doc_id


def test_ngram_join_of_nothing(spark, no_docs):
    assert ngram_join.near_duplicates(no_docs).count() == 0
    assert ngram_join.runs_for(0.99) > ngram_join.runs_for(0.9) >= 1


def test_embedding_join_recall(spark):
    import numpy as np

    draw = np.random.default_rng(5)
    x = draw.standard_normal((2500, 24)).astype(np.float32)
    for i in range(0, 1200, 2):  # pairs near the threshold
        x[i + 1] = x[i] + draw.standard_normal(24).astype(np.float32) * draw.uniform(0.05, 0.5)
    x[2000:2040] = x[0]
    rows = [(i, [float(y) for y in v], 0) for i, v in enumerate(x)]
    rows += [(9000, None, 1), (9001, [0.0] * 24, 1), (9002, [float("nan")] * 24, 1), (9003, [None, *[1.0] * 23], 1), (9004, [], 1), (9005, [1.0, 2.0], 1), (9005, [1.0, 2.0], 1)]
    got = {r.vec_id: r for r in embedding_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, size int"), ).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    link = y @ y.T >= 0.9
    np.fill_diagonal(link, False)
    want = link.sum(1)
    assert sum(got[i].n_links for i in range(2500)) >= 0.95 * want.sum()
    assert all(got[i].n_links <= want[i] for i in range(2500))  # none below the threshold
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(9000, 9005))
    assert got[9005].n_links == 1
    assert got[2039].component_id == 0 and got[2039].n_links >= 39


def test_embedding_join_of_nothing(spark):
    assert embedding_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_collisions_count_windows():
    import numpy as np

    x = np.random.default_rng(2).standard_normal((40, 8))
    got = embedding_join.collisions(x, half=0.4, m=7)
    p = x.astype(np.float32) @ embedding_join.directions(8, 7, 2)
    for i in range(40):
        for j in range(i + 1, 40):
            assert abs(int(got[i, j]) - int((np.abs(p[i] - p[j]) <= 0.4).sum())) <= 1


# ---------------------------------------------------------------- repeats
def removed(texts, least=400):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - least + 1):
            seen[d[i : i + least]] = seen.get(d[i : i + least], 0) + 1
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - least + 1):
            if seen[d[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        spans = sum(1 for i in range(len(d)) if gone[i] and (not i or not gone[i - 1]))
        yield len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("pieces", [384, 1])
def test_repeats_are_brute_force(spark, odd_docs, monkeypatch, pieces):
    monkeypatch.setattr(repeats, "PIECES", pieces)  # 1: every gram is resolved by digests
    a, b, c = prose(80, 150), prose(81, 90), prose(82, 60)
    more = [a, f"x {a} y", f"{b} {c}", f"{b}{c} {b}", "ab" * 500, "ab" * 333 + "c" + "ab" * 220, a[:399], a[1:401], f"é{a[5:405]}", c + a[100:600] + c + b[:450], "z" * 401, "z" * 400]
    texts = [(r.doc_id, r.text) for r in odd_docs.where("n_chars < 5000").collect()] + [(50 + i, t) for i, t in enumerate(more)]
    docs = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, class string")
    want = sorted((i if i is not None else -1, *r) for (i, _), r in zip(texts, removed([t for _, t in texts]), strict=True))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(docs).collect())
    assert got == want


def test_maximal_repeats_by_brute_force():
    pieces = [b"xabcabcy", b"zabcabcw", b"abc", b"cabca"]
    suffixes, found = repeats.maximal_repeats(pieces, least=3)
    told = {(pieces[suffixes[a][0]][suffixes[a][1] :][:n], b - a) for n, a, b in found}
    count = lambda s: sum(p.startswith(s, i) for p in pieces for i in range(len(p)))
    want = set()
    for p in pieces:
        for i in range(len(p)):
            for j in range(i + 3, len(p) + 1):
                s = p[i:j]
                places = [(q, k) for q in pieces for k in range(len(q)) if q.startswith(s, k)]
                left = {q[k - 1] if k else (q, k) for q, k in places}
                right = {q[k + len(s)] if k + len(s) < len(q) else (q, k) for q, k in places}
                if len(places) > 1 and len(left) > 1 and len(right) > 1:
                    want.add((s, count(s)))
    assert told == want


def test_repeats_of_nothing(spark, no_docs):
    assert repeats.without_repeats(no_docs).count() == 0


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
        seen[name] = ({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r for r in out.collect()})
        docs = out if name.startswith("mixing") else out.select(*columns)
        assert out.columns[: len(columns)] == columns or set(columns) <= set(out.columns)
    before, after = seen["quality classifier"]
    good = [i for i in before if labels.get(i) == 1]
    assert sum(i in after for i in good) >= 0.97 * len(good)

    before, after = seen["n-gram Jaccard join"]
    ids = sorted(before)
    sets = [grams(before[i]) for i in ids]
    links = [(a, b) for b in range(len(ids)) for a in range(b) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    assert set(after) == {ids[r] for r in union(len(ids), links)}

    before, after = seen["benchmark decontamination"]
    bench = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[j : j + 13]) for w in bench for j in range(len(w) - 12)}
    for i, text in before.items():
        w, hit = words(text), set()
        for j in range(len(w) - 12):
            if tuple(w[j : j + 13]) in windows:
                hit.update(range(j, j + 13))
        assert (i in after) == (not (hit and 20 * len(hit) >= len(w)))

    before, after = seen["secret scans"]
    scanner = secrets.Scanner()
    assert set(before) == set(after)
    for i, text in before.items():
        assert after[i].text == text if not scanner.spans(text) else "[SECRET]" in after[i].text
        assert after[i].n_chars == len(after[i].text)

    before, after = seen["mixing sources to target weights"]
    assert after and all(r.taken > 0 for r in after.values())
    sources = {r.source: r.target for r in after.values()}
    for s, target in sources.items():
        assert math.isclose(sum(r.taken for r in after.values() if r.source == s), target, abs_tol=1.0)


def test_repeated_rows_keep_one(spark, odd_docs):
    out = corpus_pipeline.one_of_each_group(spark, odd_docs, "").collect()
    ids = [r.doc_id for r in out]
    assert ids.count(9) == 1 and ids.count(1) == 1 and 2 not in ids and 3 not in ids and 11 not in ids
    assert ids.count(None) == 2 and {5, 6, 7, 8, 10} <= set(ids)
    dropped = corpus_pipeline.decontaminated
    assert dropped and decontaminate.WINDOW == 13


def test_stages_keep_clashing_columns(spark, odd_docs, no_docs, tmp_path):
    clash = {c: F.lit(c) for c in ("score", "predicted", "n_words", "n_hit", "items", "contaminated", "spans", "key", "class", "row")}
    sf = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        rows = docs.withColumns(clash)
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, rows, sf)
            assert out.columns == rows.columns, name
            assert all(r[c] == c for r in out.collect() for c in clash)
        assert corpus_pipeline.mixed(spark, rows, sf).count() <= rows.count()


def test_near_pairs_of_vectors_are_found(spark):
    """Recall on pairs just above the threshold alone."""
    import numpy as np

    draw = np.random.default_rng(8)
    x = draw.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 3000, 2):
        side = draw.standard_normal(32)
        side -= side @ x[i] * x[i]
        c = draw.uniform(0.9005, 0.915)
        x[i + 1] = c * x[i] + math.sqrt(1 - c * c) * side / np.linalg.norm(side)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    link = y @ y.T >= 0.9
    np.fill_diagonal(link, False)
    found = sum(r.n_links for r in embedding_join.near_duplicates(rows).collect())
    assert 0.98 * link.sum() <= found <= link.sum()


# ---------------------------------------------------------------- rows without an id, repeated ids
def test_rows_without_an_id_are_linked_and_leave(spark):
    a, b, c = prose(90, 80), prose(91, 80), prose(92, 80)
    rows = [
        (1, a), (None, a), (None, near(1, a, 1)), (None, a.upper()),  # copies of an identified document
        (None, b), (None, b), (None, near(2, b, 1)),  # a group without any id
        (2, c), (3, prose(93, 80)), (3, near(3, c, 1)), (None, None), (None, ""), (4, None),
    ]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [grams(t) for _, t in rows]
    links = [(i, j) for j in range(len(rows)) for i in range(j) if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    root, n = union(len(rows), links), [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    assert len(set(root)) == 7  # the near copies are linked
    name = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    found = ngram_join.near_duplicates(docs).collect()
    told = lambda x: sorted(x, key=str)
    assert told((r.doc_id, r.n_links, r.component_id) for r in found) == told((d, n[i], name[root[i]]) for i, (d, _) in enumerate(rows))
    assert sum(r.kept for r in found) == 7
    out = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
    assert told(x for x in out if x[0] is not None) == told([(1, a), (2, c), (3, rows[8][1]), (4, None)])
    nameless = [t for d, t in out if d is None]
    assert len(nameless) == 3 and {None, ""} < set(nameless) and {b, rows[6][1]} & set(nameless)
