"""Decontamination and mixing against brute force and SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sheafline.llm import decontaminate, mixing

from .conftest import prose, words


def brute(text, items, window=13):
    w, hit, named = words(text), set(), set()
    for name, item in items:
        n = min(window, len(item))
        for j in range(len(item) - n + 1):
            for i in range(len(w) - n + 1):
                if n and w[i : i + n] == item[j : j + n]:
                    hit.update(range(i, i + n))
                    named.add(str(name))
    return len(w), len(hit), sorted(named)


def bench(spark):
    long = prose(50, 40)
    rows = [(1, long), (2, "Short item of five words"), (3, prose(51, 13)), (4, None), (5, ""), (6, long), (None, "no name")]
    return spark.createDataFrame(rows, "item_id long, text string"), rows


@pytest.mark.parametrize("most", [500_000, 0])
def test_contamination_is_brute_force(spark, odd_docs, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)  # 0: fingerprints are joined by shuffle
    items, rows = bench(spark)
    known = [(i, words(t)) for i, t in rows if i is not None]
    a, b = rows[0][1].split(), rows[2][1].split()
    more = [
        (20, prose(7, 30) + " " + " ".join(a[5:25]) + " " + prose(8, 30)),
        (21, " ".join(a[:12])),  # one word less than a window
        (22, " ".join(a[:13])),
        (23, "x short ITEM, of five words y"),
        (24, " ".join(b) + " " + " ".join(b)),
        (25, " ".join(a[:20] + a[10:40])),
        (26, prose(9, 400) + " " + " ".join(b)),
    ]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    docs = docs.withColumn("n_words", F.lit("clash")).withColumn("h", F.lit(1))
    got = decontaminate.contamination(docs, items).collect()
    assert len(got) == docs.count()
    for r in got:
        n, hit, named = brute(r.text, known)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, named), r.doc_id
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    assert {r.doc_id for r in got if r.contaminated} >= {20, 22, 23, 24, 25}


def test_contamination_without_rows(spark, odd_docs, no_docs):
    items, _ = bench(spark)
    assert decontaminate.contamination(no_docs, items).count() == 0
    assert decontaminate.contamination(odd_docs, items.limit(0)).where("contaminated").count() == 0


def test_native_plans_have_no_python(spark, odd_docs):
    items, _ = bench(spark)
    for df in (decontaminate.contamination(odd_docs, items), mixing.mix(odd_docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("query", ["op7_mix_sources", "op10_decontaminate"])
def test_against_sql(spark, query):
    from sheafline.llm import entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[query])
    names = [d[0] for d in want.description]
    rounded = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert rounded(want.fetchall()) == rounded([tuple(r) for r in entry.queries()[query](spark, sf).select(*names).collect()])


def test_mix_meets_its_targets(spark, odd_docs):
    docs = odd_docs.withColumn("target", F.lit("clash"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == odd_docs.count()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert r.size == len((r.text or "").split())
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1 and target[s] <= 3 * sizes[s] + 1e-6
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-3
    again = {(r.doc_id, r.text): r.taken for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.text): r.taken for r in rows}


def test_mix_prefers_heavy_documents(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("word " * 10).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    weight = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    got = mixing.mix(docs, weight=weight, slices=64).where("target < source_size").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n"))
    n = {r.odd: r.n for r in got.collect()}
    assert n[0] > 1.3 * n[1]


def test_mix_of_nothing(no_docs):
    assert mixing.mix(no_docs).count() == 0


def test_items_without_an_id_hit(spark, tmp_path):
    """Against brute force and the query's SQL, on tables where items and documents have no id."""
    from sheafline.llm import entry

    secret, other, both = prose(60, 20), prose(61, 20), prose(62, 16)
    items = [(None, secret), (None, "three short words"), (None, both), (7, both), (8, other), (None, None)]
    texts = [secret, f"x {secret} y", "and THREE short, words", both, other, f"{secret} {other} three short words", prose(63, 50), "", None]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    cut = [(i, words(t)) for i, t in items]
    for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect():
        n, hit, named = brute(r.text, cut)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, [x for x in named if x != "None"]), r.doc_id
        assert r.contaminated == (hit > 0 and 20 * hit >= n) == (r.doc_id < 6)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["op10_decontaminate"])
    names = [d[0] for d in want.description]
    got = entry.queries()["op10_decontaminate"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in got)


def test_no_slice_is_hot(spark):
    """Whatever the weights, no slice of keys holds much of a source: unspaced texts, mixed ones, single-word ones."""
    from sheafline.llm import mixing

    for chars in ("'x'", "repeat('日', 40 + id % 9)", "if(id % 2 = 0, repeat('z', 90), 'six ch')"):
        rows = spark.range(20_000).selectExpr("id AS doc_id", f"{chars} AS text")
        key = -F.log(mixing.uniform(F.col("doc_id"), F.col("text"), "mix-1")) / mixing.quality_weight(F.col("text"), F.lit(1))
        largest = rows.groupBy(mixing.slice_of(key)).count().agg(F.max("count")).first()[0]
        assert largest <= 20_000 * 0.002
