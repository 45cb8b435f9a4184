"""JSON trees, payloads and clean quiz files of odd shapes against plain Python."""

import json
import random

from pyspark.sql import functions as F

from sheafline.operators import trees
from sheafline.sources import clean_quiz, payload


def shown(x):
    if isinstance(x, dict):
        return {k: shown(v) if isinstance(v, dict) else [shown(i) if isinstance(i, dict) else i for i in v] if isinstance(v, list) else v for k, v in x.items() if not any(p in k.lower() for p in trees.SECRET_PARTS)}
    return x


def test_trees_are_redacted_and_put_together(spark):
    draw = random.Random(6)

    def tree(depth):
        kind = draw.randint(0, 8)
        if depth and kind < 3:
            return {draw.choice(["a", "б", "Token", "my phone", "z\"q", "x y", "e"]): tree(depth - 1) for _ in range(draw.randint(0, 4))}
        if depth and kind < 6:
            return [tree(depth - 1) for _ in range(draw.randint(0, 4))]
        return draw.choice([None, True, False, 0, -7, 2**40, 1.5, "", "é\"\\\n\t/", "日本"])

    docs = [{"k": tree(5), "session": tree(2)} for _ in range(60)] + [{}, {"a": [[{"token": 1}], []]}]
    df = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)], "t long, j string").withColumn("v", F.try_parse_json("j"))
    flat = trees.nodes(df, "t", "v")
    canon = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert {r.tree: r.text for r in trees.canonical(flat).collect()} == {i: canon(d) for i, d in enumerate(docs)}
    assert {r.tree: r.text for r in trees.canonical(trees.redacted(flat)).collect()} == {i: canon(shown(d)) for i, d in enumerate(docs)}
    assert trees.nodes(df.limit(0), "t", "v").count() == 0 and trees.canonical(trees.nodes(df.limit(0), "t", "v")).count() == 0


def test_forms_of_whole_rows(spark):
    """Row by row as level by level, without a shuffle."""
    docs = [
        {"k": {"Token": [1, 2], "b": [[{"token": 1}], {"token": 2, "z": None}]}, "a\"б": 1.5, "é": "\n\"\\日本", "c": [], "d": {}}, {"session": {"x": 1}, "q": {"Phone": 2, "y": [{"a": 1, "secret": 2}]}}, {"k": [[{"token": 1}], {"token": 2}], "e": []}, {}, [[{"api_key": 2**40}]], "text", -7, None,
    ]
    df = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)] + [(99, None)], "t long, j string").withColumn("v", F.try_parse_json("j"))
    flat = trees.nodes(df, "t", "v")
    whole, shown = ({r.tree: r.text for r in trees.canonical(x).collect()} for x in (flat, trees.redacted(flat)))
    n = {r.tree: (r.n, r.d) for r in flat.groupBy("tree").agg(F.count("*").alias("n"), F.max("depth").alias("d")).collect()}
    got = trees.forms(df, "t", "v")
    assert {r.tree: (r.whole, r.shown, (r.nodes, r.depth)) for r in got.collect()} == {t: (whole[t], shown[t], n[t]) for t in whole} and len(whole) == len(docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_payloads_of_all_shapes(spark):
    docs = [
        {"blocks": [{"id": "x", "text": "", "text_md": "T"}, 5, {"type": "image", "media": ["m"], "content": "c"}, {"id": 0, "block_id": 7, "kind": ""}]},
        {"blocks": {"b1": "t", "p2": 3}, "source_blocks": []}, {"blocks": [], "source_blocks": [{"block_id": "img1"}]}, {}, [], {"blocks": "no"},
    ]
    df = spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(docs)], "f string, j string").withColumn("v", F.parse_json("j"))
    got = sorted((r.file, r.pos, r.block_id, r.kind, r.text, tuple(r.media), r.is_image) for r in payload.blocks(df, "f", "v").collect())
    assert got == [
        ("0", 1, "x", "paragraph", "T", (), False), ("0", 3, "b0003", "image", "c", ("m",), True), ("0", 4, "7", "paragraph", "", (), False),
        ("1", 1, "b1", "paragraph", "t", (), False), ("1", 2, "p2", "paragraph", "3", (), False), ("2", 1, "img1", "paragraph", "", (), True),
    ]
    known = spark.createDataFrame([("0", x) for x in ("p-0001", "p0001", "b0002", "img-0007", "12345")], "file string, block_id string")
    asked = spark.createDataFrame([("0", x) for x in ("b1", "b0001", "p2", "p-0002", "img7", "b12345", "1", "b0002", "b0002", "no")] + [("1", "b1")], "file string, id string")
    found = [(r.file, r.id, r.found) for r in payload.resolved(asked, known, "file", "id").collect()]
    want = {"b1": "p-0001", "b0001": "p-0001", "p2": "b0002", "p-0002": "b0002", "img7": "img-0007", "b12345": "12345", "1": None, "b0002": "b0002", "no": None}
    assert set(found) == {("0", k, v) for k, v in want.items()} | {("1", "b1", None)}
    assert len(found) == 11


def test_clean_files_of_all_faults(spark):
    rows = [
        ("a", '{"title":" ","settings":[],"items":[1,{"type":"x"},{"type":"question","question":"q","options":[{"text":"a"},{"text":" "},3],"answers":[1,1,9,true,1.5],"mode":"single","media":["",5,"ok"]},{"type":"context","media":"no"},{"type":"question"}]}'),
        ("b", "[]"), ("c", "{bad"), ("d", None), ("e", '{"title":"t","settings":{},"items":{}}'), ("f", '{"title":"t","settings":{},"items":[{"type":"title"},{"type":"question","question":"q","options":[{"text":"a"},{"text":"b"}],"answers":[2],"mode":"single","media":null}]}'),
    ]
    got = sorted((r.file, r.item or 0, r.question or 0, r.code, r.field, r.value, len(r.actions)) for r in clean_quiz.issues(spark.createDataFrame(rows, "file string, value string")).collect())
    schema = "invalid_schema"
    assert got == sorted(
        [
            ("a", 0, 0, schema, "title", None, 2), ("a", 0, 0, schema, "settings", None, 2), ("a", 1, 0, schema, "item", None, 2), ("a", 2, 0, schema, "type", "x", 2), ("a", 3, 1, schema, "option", "3", 3),
            ("a", 3, 1, "option_text_empty", "option", "2", 3), ("a", 3, 1, schema, "answers", "4", 3), ("a", 3, 1, schema, "answers", "5", 3), ("a", 3, 1, "answer_index_out_of_range", "answers", "9", 3),
            ("a", 3, 1, "answer_index_duplicate", "answers", None, 3), ("a", 3, 1, "mode_answer_count_conflict", "mode", "single", 3), ("a", 3, 1, schema, "media", "1", 3), ("a", 3, 1, schema, "media", "2", 3),
            ("a", 4, 0, schema, "media", None, 2), ("a", 5, 2, "question_text_empty", "question", None, 3), ("a", 5, 2, schema, "options", None, 3), ("a", 5, 2, "answer_missing", "answers", None, 3),
            ("a", 5, 2, "mode_invalid", "mode", None, 3), ("b", 0, 0, schema, "file", None, 2), ("c", 0, 0, "invalid_json", "file", None, 2), ("d", 0, 0, "invalid_json", "file", None, 2), ("e", 0, 0, schema, "items", None, 2),
        ]
    )


def test_ids_of_more_than_four_digits_stay_whole(spark, tmp_path):
    """Part keys and places beyond 9,999, against the query's SQL."""
    import duckdb

    from sheafline.plans import trees as plans

    keys = [*range(9990, 10040), *range(123400, 123480)]
    spark.createDataFrame([(k, f"part {k}") for k in keys], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, 1 + i % 7, k) for i, k in enumerate(keys * 3)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = sorted((r.l_orderkey, r.asked, r.found, r.first or "", r["last"] or "") for r in plans.resolved_ids(spark, str(tmp_path)).collect())
    assert got == sorted((k, a, f, x or "", y or "") for k, a, f, x, y in con.execute(plans.RESOLVED).fetchall())
    many = spark.createDataFrame([("0", json.dumps({"blocks": [{}] * 10001}))], "f string, j string").withColumn("v", F.parse_json("j"))
    assert payload.blocks(many, "f", "v").agg(F.max_by("block_id", "pos")).first()[0] == "b10001"
