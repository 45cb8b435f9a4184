"""Collocations, vector codes and URL filters against brute force, on odd rows, and on empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sheafline.llm import _store, collocations, url_filter, vector_codes
from tests.llm.conftest import AZ, DOCS


# ------------------------------------------------------------------ phrases
def phrases_by_hand(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(AZ)):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if 2 <= len(p[1]) and a >= least}
    out = defaultdict(list)
    for (lang, ws), a in candidates.items():
        inside = any(
            o == lang and len(longer) > len(ws) and any(longer[i : i + len(ws)] == ws for i in range(len(longer))) and 100 * b >= 80 * a
            for (o, longer), b in candidates.items()
        )
        if not inside:
            cuts = [(2000000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws))]
            score, _, left, right = min(cuts)
            out[lang].append((-score, -a, " ".join(ws).encode(), left, right))
    return {
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items()
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])
    }


@pytest.fixture(scope="module")
def phrase_rows():
    draw = random.Random(11)
    words = ["The", "old", "red", "house", "été", "日本", "x-y", "(a)", "\x1fz", "of"]
    rows = []
    for i in range(60):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " "]) for _ in range(draw.randint(0, 40)))
        rows.append((text, draw.choice(["en", "en", "de", None, "und"])))
    return [*rows, *[("one common line of words", "en")] * 40, (None, "en"), ("", None), (" \t\n", "de"), ("old red house " * 3000, "de")]


def test_phrases_by_brute_force(spark, phrase_rows):
    docs = spark.createDataFrame(phrase_rows, "text string, lang string").repartition(3)
    for least, top in ((5, 2000), (3, 7)):
        got = {tuple(r) for r in collocations.collocations(docs, least=least, top=top).collect()}
        assert got == phrases_by_hand(phrase_rows, least, top) and len(got) > 20


def test_phrases_do_not_depend_on_stretches(spark, phrase_rows):
    docs = spark.createDataFrame(phrase_rows, "text string, lang string")
    for k in (1, 2):
        bits = None if k == 1 else collocations.bit_table(spark, collocations.counted(docs, 1).where("n >= 5"), 1)
        whole, cut = ({tuple(r) for r in collocations.counted(docs, k, bits, stretch=s).collect()} for s in (1 << 20, 64))
        assert whole == cut and whole


def test_python_gets_few_rows_of_texts_at_once(spark, phrase_rows, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    monkeypatch.setattr(collocations, "written", lambda df: (seen.append(int(spark.conf.get(key))), _store.written(df))[1])
    docs = spark.createDataFrame(phrase_rows, "text string, lang string")
    collocations.collocations(docs).count()
    assert max(seen[:5]) <= 1000 and spark.conf.get(key) == before


def test_phrases_of_odd_rows(spark, odd_docs, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    rows = [(r.text, r.lang) for r in odd_docs.collect()]
    assert {tuple(r) for r in collocations.collocations(odd_docs).collect()} == phrases_by_hand(rows, 30, 2000)
    clashing = odd_docs.withColumnsRenamed({"n_chars": "n", "source": "phrase"})
    assert collocations.collocations(clashing, least=2).count() == collocations.collocations(odd_docs, least=2).count() > 0


# ------------------------------------------------------------------ vectors
def codes_by_hand(rows, entries=64):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v, p: v[p * len(v) // 16 : (p + 1) * len(v) // 16]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(16)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))
    for _ in range(2):
        for p in range(16):
            of = defaultdict(list)
            for _, v, _ in kept:
                of[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*of[e])] if e in of else entry for e, entry in enumerate(books[p])]
    total, out = Counter(), []
    for i, v, label in kept:
        best = [near(cut(v, p), books[p]) for p in range(16)]
        total[label] += sum(d for d, _ in best)
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, c, d, total[label]) for i, c, d, label in out), key=str), digest


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes_by_brute_force(spark):
    draw = random.Random(12)
    rows = [(1000 - i, [draw.gauss(0, 0.2) for _ in range(32)], draw.choice([0, 1, None])) for i in range(150)]
    rows += [(2000 + i, rows[5][1], 7) for i in range(120)]  # copies
    rows += [(3000, [0.0] * 32, 1), (3001, [-0.0] * 32, 1), (3002, [900.0] * 32, 2), (3002, [900.0] * 32, 2), (None, [0.1] * 32, None), (None, [0.2] * 32, 1)]
    rows += [(1, None, 0), (2, [math.nan] * 32, 0), (3, [math.inf] + [0.0] * 31, 0), (4, [None] + [0.0] * 31, 0)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3).selectExpr("*", "'kept' AS code", "5 AS far")
    found, books = vector_codes.coded(df)
    want, digest = codes_by_hand(rows)
    got = sorted([(r.vec_id, r.code, r.error, r.label_error) for r in found.collect()], key=str)
    assert got == want and vector_codes.digest(books) == digest
    assert found.where("far = 5").count() == len(want)


def test_codes_of_few_rows_and_wide_numbers(spark):
    for rows in ([], [(1, None, 0)], [(1, [0.5] * 16, None)], [(2, [1e9, -1e30] * 8, 0), (1, [0.25] * 16, 0)]):
        found, books = vector_codes.coded(spark.createDataFrame(rows, VECTORS))
        assert found.count() == sum(v is not None for _, v, _ in rows)
        assert all(r.error == 0 for r in found.collect())  # each vector is an entry of its own
    odd = [(1, [0.5] * 5, 0), (2, [], 0), (3, [0.25] * 40, 1)]
    assert {r.vec_id: r.error for r in vector_codes.coded(spark.createDataFrame(odd, VECTORS))[0].collect()}[3] == 0


def test_nearest_is_alike_for_small_and_wide_numbers():
    draw = np.random.default_rng(5)
    parts, book = draw.integers(-300, 300, (500, 4)), draw.integers(-300, 300, (64, 4))
    book[7] = book[3]  # a tie
    by_hand = [min((int(((p - b) ** 2).sum()), e) for e, b in enumerate(book)) for p in parts]
    at, far = vector_codes.nearest(parts, book)
    assert [(int(d), int(e)) for d, e in zip(far, at)] == by_hand
    wide, far = vector_codes.nearest(parts << 15, book << 15)
    assert (wide == at).all() and all(int(d) == x << 30 for d, (x, _) in zip(far, by_hand))


# ------------------------------------------------------------------ URLs
def parts_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return host.translate(AZ), re.split(r"[?#]", rest[len(host) :])[0]


def rule_by_hand(host, path):
    fits = [(len(t), t, v) for v, t in url_filter.RULES for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def verdicts_by_hand(urls):
    """Witten-Bell probabilities asked character by character, without the sums per string."""
    order, rows = url_filter.ORDER, []
    counts = {"allow": Counter(), "block": Counter()}
    for url in urls:
        rule, told = rule_by_hand(*parts_by_hand(url))
        held = int(hashlib.md5((url or "").encode()).hexdigest()[:4], 16) % 5 == 0
        t = "\x02" + (url or "").translate(AZ) + "\x03"
        rows.append((url, t, rule, told, held))
        if told and not held:
            for i in range(len(t)):
                for m in range(1, min(order + 1, i + 1) + 1):
                    counts[told][t[i + 1 - m : i + 1]] += 1
    both = counts["allow"] + counts["block"]
    seen = sum(n for g, n in both.items() if len(g) == 1)
    kept = {g for g, n in both.items() if n >= max(2, -(-seen // url_filter.PRUNE))}
    after = {kind: defaultdict(dict) for kind in counts}
    for g in kept:
        for kind in counts:
            if g != "\x02" and counts[kind][g]:
                after[kind][g[:-1]][g[-1]] = counts[kind][g]

    def p(kind, context, char):
        below = url_filter.UNSEEN if not context else p(kind, context[1:], char)
        seen = after[kind].get(context)
        if not seen:
            return below
        n, t = sum(seen.values()), len(seen)
        return (seen.get(char, 0) + t * below) / (n + t)

    def score(t):
        total = 0.0
        for i in range(1, len(t)):
            context = t[max(0, i - order) : i]
            total += math.log(p("allow", context, t[i])) - math.log(p("block", context, t[i]))
        return total / (len(t) - 1)

    return rows, score


def test_urls_by_brute_force(spark):
    draw = random.Random(13)
    urls = []
    for i in range(700):
        host = draw.choice(["a.example.org", "EXAMPLE.org", "b.example.com", "casino.example.com", "c.example.net", "org", "myorg", "x.example.org:80"])
        urls.append(f"{draw.choice(['http', 'https', 'HTTP'])}://{host}/{draw.choice(['en', 'es', 'de', 'fr'])}/{draw.randint(1, 300)}{draw.choice(['', '/', '.html', '?a=/de/', '#top'])}")
    urls += ["", None, None, "no scheme", "://", "http://", "http://org", "http://org?x", "http://org/", "a://b://c.org/x", "http://é.org/ü", urls[0], urls[0], "http://x.net/" + "y" * 5000, "http://example.org/en\n/1"]
    df = spark.createDataFrame([(i, u, "kept", "x") for i, u in enumerate(urls)], "page_id long, url string, extra string, host string")
    rows, score = verdicts_by_hand(urls)
    learned = [(url, 1, told == "allow") for url, _, _, told, held in rows if told and not held]
    model = url_filter.fit(spark.createDataFrame(learned, "url string, n long, accepted boolean"))
    scores = {r.page_id: r.score for r in url_filter.scored(df, model, "page_id").collect()}
    for i, (_, t, *_rest) in enumerate(rows):
        assert abs(scores[i] / 1e6 - score(t)) < 2e-4, urls[i]
    told = list({urls[i]: (math.floor(scores[i] / 10_000), r[3]) for i, r in enumerate(rows) if r[3] and r[4]}.items())
    weight = Counter(urls)
    rate = lambda t: (
        sum(weight[u] for u, (b, v) in told if v == "allow" and b < t) * sum(weight[u] for u, (b, v) in told if v == "block")
        + sum(weight[u] for u, (b, v) in told if v == "block" and b >= t) * sum(weight[u] for u, (b, v) in told if v == "allow")
    )
    bins = sorted({b for _, (b, _) in told})
    least = min([b - (b - before) // 2 for before, b in zip([bins[0], *bins], bins)], key=lambda t: (rate(t), abs(t), t))
    for r in url_filter.judged(df).collect():
        _, t, rule, verdict, _ = rows[r.page_id]
        assert (r.host, r.path) == parts_by_hand(r.url) and r.rule == rule and r.extra == "kept"
        assert r.verdict == (verdict or ("allow" if math.floor(scores[r.page_id] / 10_000) >= least else "block"))


def test_urls_without_rules_or_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judged(none).count() == 0
    few = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (None, None)], "page_id long, url string")
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(few).collect()} == {(1, "a.net", "/x", None, "allow"), (None, "", "", None, "allow")}
    assert url_filter.judged(few).count() == 3


def test_urls_are_told_apart(spark):
    """Held-out URLs of rejected languages are mostly blocked, accepted ones mostly allowed."""
    draw = random.Random(14)
    rows = [(i, f"https://{draw.choice('abcdef')}{i % 17}.example.com/{lang}/{draw.randint(1, 9999)}") for i in range(1500) for lang in [draw.choice(["fr", "de"])]]
    rows += [(10_000 + i, f"https://new{i}.example.net/{lang}/{i}") for i in range(200) for lang in [["fr", "de"][i % 2]]]
    got = {r.page_id: r.verdict for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    right = sum(got[10_000 + i] == ["allow", "block"][i % 2] for i in range(200))
    assert right >= 190
