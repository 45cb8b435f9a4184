"""Queries on JSON of any shape, built from the tables as text and parsed again: trees, payloads, ids, clean quiz files."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.operators import trees
from sheafline.plans.items import table
from sheafline.sources import clean_quiz, payload


# ------------------------------------------------------------------ trees
def _trees(spark, sf_dir):
    """A document a customer with nested orders, names in no order, some of them secret at several depths."""
    order = F.concat(
        F.lit('{"total": '), F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), F.lit(', "id":'), F.col("o_orderkey").cast("string"), F.lit(', "Session_Id": {"k": ['), F.col("o_custkey").cast("string"),
        F.lit('], "x": {}}, "flags": [true, null, "'), F.col("o_orderpriority"), F.lit('\\n\\"é"], "nested": [[{"token": "'), F.col("o_orderstatus"), F.lit('", "a": []}], []]}'),
    )
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", order.alias("t")))), lambda x: x.t), ", ").alias("orders"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    text = F.concat(F.lit('{"zeta": "'), F.col("c_name"), F.lit('", "orders": ['), F.coalesce("orders", F.lit("")), F.lit('], "contact": {"phone": [1, {"a": 2}], "nation": '), F.col("c_nationkey").cast("string"), F.lit(', "Аб": {"b": {"api_key": 1}}}}'))
    return c.select("c_custkey", F.parse_json(text).alias("doc"))


def canonical_trees(spark, sf_dir):
    """Hashes of documents in canonical form, whole and without secret fields."""
    found = trees.forms(_trees(spark, sf_dir), "c_custkey", "doc")
    return found.select(F.col("tree").alias("c_custkey"), trees.hashed(F.col("whole")).alias("whole"), trees.hashed(F.col("shown")).alias("shown"), F.length("shown").alias("n_shown"), "nodes", "depth")


CANONICAL = r"""
WITH o AS (
  SELECT o_custkey AS c, o_orderkey, '{"flags":[true,null,"' || o_orderpriority || '\n\"é"],"id":' || o_orderkey || ',"nested":[[{"a":[],"token":"' || o_orderstatus || '"}],[]]' AS t,
    ',"total":' || CAST(round(o_totalprice * 100) AS BIGINT) || '}' AS last, '{"Session_Id":{"k":[' || o_custkey || '],"x":{}},' AS secret FROM orders),
g AS (SELECT c, string_agg(t || last, ',' ORDER BY o_orderkey) AS shown, string_agg(secret || substr(t, 2) || last, ',' ORDER BY o_orderkey) AS whole, count(*) AS n FROM o GROUP BY 1),
d AS (
  SELECT c_custkey, coalesce(n, 0) AS n,
    '{"contact":{"nation":' || c_nationkey || ',"phone":[1,{"a":2}],"Аб":{"b":{"api_key":1}}},"orders":[' || coalesce(whole, '') || '],"zeta":"' || c_name || '"}' AS whole,
    '{"contact":{"nation":' || c_nationkey || ',"Аб":{"b":{}}},"orders":[' || coalesce(shown, '') || '],"zeta":"' || c_name || '"}' AS shown FROM customer LEFT JOIN g ON c = c_custkey)
SELECT c_custkey, 'sha256:' || sha256(whole) AS whole, 'sha256:' || sha256(shown) AS shown, length(shown) AS n_shown, 12 + 17 * n AS nodes, CASE WHEN n > 0 THEN 6 ELSE 4 END AS depth FROM d
"""


# ------------------------------------------------------------------ payloads and ids
def _payloads(spark, sf_dir):
    """Parts as blocks of documents of 40: a list under one of two names with fields under any of theirs, or an object of texts."""
    p, k, doc = table(spark, sf_dir, "part"), F.col("p_partkey"), F.floor(F.col("p_partkey") / 40)
    quote = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    named = F.when(k % 4 == 0, F.concat(F.lit('"id":"b'), F.lpad(k.cast("string"), 4, "0"), F.lit('",'))).when(k % 4 == 1, F.concat(F.lit('"id":"", "block_id":"p-'), k.cast("string"), F.lit('",'))).when(k % 4 == 2, F.concat(F.lit('"block_id":"img'), k.cast("string"), F.lit('",'))).otherwise("")
    kind = F.when(k % 7 == 0, F.lit('"type":"image","kind":null,')).when(k % 7 == 1, F.lit('"kind":"heading",')).otherwise("")
    text = F.when(k % 3 == 0, F.concat(F.lit('"text":"","text_md":'), quote(F.col("p_name")))).when(k % 3 == 1, F.concat(F.lit('"content":'), quote(F.col("p_name")))).otherwise(F.concat(F.lit('"text":'), quote(F.col("p_name"))))
    media = F.when(k % 5 == 0, F.concat(F.lit(',"media_refs":[],"media":["'), k.cast("string"), F.lit('.png"]'))).otherwise("")
    entry = F.when(k % 11 == 0, F.lit('"no object"')).otherwise(F.concat(F.lit("{"), named, kind, text, media, F.lit("}")))
    pair = F.concat(F.lit('"b'), k.cast("string"), F.lit('":'), quote(F.col("p_name")))
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", c.alias("t")))), lambda x: x.t), ",")
    d = p.groupBy(doc.alias("doc")).agg(listed(entry).alias("entries"), listed(pair).alias("pairs"))
    body = F.when(F.col("doc") % 3 == 0, F.concat(F.lit('{"blocks":['), F.col("entries"), F.lit("]}"))).when(F.col("doc") % 3 == 1, F.concat(F.lit('{"blocks":[], "source_blocks":['), F.col("entries"), F.lit("]}"))).otherwise(F.concat(F.lit('{"blocks":{'), F.col("pairs"), F.lit("}}")))
    return d.select("doc", F.parse_json(body).alias("v"))


def payload_blocks(spark, sf_dir):
    found = payload.blocks(_payloads(spark, sf_dir), "doc", "v")
    return found.select(F.col("file").alias("doc"), F.when(F.col("file") % 3 != 2, F.col("pos")).alias("pos"), "block_id", "kind", "text", F.array_join("media", ",").alias("media"), "is_image")


def resolved_ids(spark, sf_dir):
    """Lines ask for blocks in several spellings; some are in no payload of that document."""
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.floor(F.col("l_partkey") / 40).alias("doc"), (F.col("l_linenumber") % 5).alias("s"))
    k = F.col("l_partkey").cast("string")
    spelt = F.when(F.col("s") == 0, F.concat(F.lit("b"), payload.padded(k))).when(F.col("s") == 1, F.concat(F.lit("b"), k)).when(F.col("s") == 2, F.concat(F.lit("p-"), k)).when(F.col("s") == 3, F.concat(F.lit("img-"), k)).otherwise(k)
    asked = asked.select("l_orderkey", "l_linenumber", "doc", spelt.alias("asked"))
    known = payload.blocks(_payloads(spark, sf_dir), "doc", "v")
    found = payload.resolved(asked, known, "doc", "asked")
    return found.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("asked"), F.count("found").alias("found"), F.min("found").alias("first"), F.max("found").alias("last"))


_PAYLOADS = """
WITH p AS (
  SELECT p_partkey AS k, p_partkey // 40 AS doc, p_name, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) AS pos FROM part),
b AS (
  SELECT doc, pos, k, CASE WHEN k % 4 = 0 THEN 'b' || lpad(k::VARCHAR, 4, '0') WHEN k % 4 = 1 THEN 'p-' || k WHEN k % 4 = 2 THEN 'img' || k ELSE 'b' || lpad(pos::VARCHAR, 4, '0') END AS block_id,
    CASE k % 7 WHEN 0 THEN 'image' WHEN 1 THEN 'heading' ELSE 'paragraph' END AS kind, p_name AS text, CASE WHEN k % 5 = 0 THEN k || '.png' ELSE '' END AS media FROM p WHERE doc % 3 <> 2 AND k % 11 <> 0
  UNION ALL SELECT doc, NULL, k, 'b' || k, 'paragraph', p_name, '' FROM p WHERE doc % 3 = 2)
"""
PAYLOAD = _PAYLOADS + "SELECT doc, pos, block_id, kind, text, media, doc % 3 <> 2 AND (kind = 'image' OR starts_with(block_id, 'img')) AS is_image FROM b"
RESOLVED = _PAYLOADS + """,
a AS (
  SELECT l_orderkey, l_partkey AS k, l_partkey // 40 AS doc, l_linenumber % 5 AS s, CASE l_linenumber % 5 WHEN 0 THEN 'b' || lpad(l_partkey::VARCHAR, greatest(4, length(l_partkey::VARCHAR))::INT, '0') WHEN 1 THEN 'b' || l_partkey WHEN 2 THEN 'p-' || l_partkey WHEN 3 THEN 'img-' || l_partkey ELSE l_partkey::VARCHAR END AS asked
  FROM lineitem),
c AS (
  SELECT *, lpad(k::VARCHAR, greatest(4, length(k::VARCHAR))::INT, '0') AS d FROM a),
e AS (
  SELECT *, unnest(CASE WHEN s IN (0, 1) THEN [asked, 'p-' || d, 'p' || d, k::VARCHAR] WHEN s = 2 THEN [asked, 'b' || d, 'p-' || d] WHEN s = 3 THEN [asked, 'img' || d, 'img-' || d] ELSE [asked] END) AS id,
    unnest(generate_series(1, CASE WHEN s IN (0, 1) THEN 4 WHEN s IN (2, 3) THEN 3 ELSE 1 END)) AS rank FROM c),
f AS (SELECT doc, asked, arg_min(id, rank) AS found FROM (SELECT DISTINCT e.doc, asked, id, rank FROM e JOIN b ON b.doc = e.doc AND b.block_id = e.id) GROUP BY 1, 2)
SELECT l_orderkey, count(*) AS asked, count(found) AS found, min(found) AS "first", max(found) AS "last" FROM a LEFT JOIN f USING (doc, asked) GROUP BY 1
"""


# ------------------------------------------------------------------ clean quiz files
def clean_file_issues(spark, sf_dir):
    """A file a customer, an item an order: broken files, titles, settings, items, options, answers, modes and media of all kinds."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    packed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    o, k, s = table(spark, sf_dir, "orders").join(packed, "o_orderkey"), F.col("o_orderkey"), F.lit
    option = F.transform("lines", lambda x, i: F.when((k % 10 == 1) & (i == 0), s("7")).when((k % 10 == 2) & (i == 0), s('{"text":"  "}')).otherwise(F.concat(s('{"text":"'), x.l_partkey.cast("string"), s('"}'))))
    right = F.array_compact(F.transform("lines", lambda x, i: F.when(x.l_returnflag == "R", (i + 1).cast("string"))))
    more = F.when(k % 10 == 3, F.array(s("99"), s("0"))).when(k % 10 == 4, F.array(s("true"), s('"1"'))).when(k % 10 == 5, right).otherwise(F.array().cast("array<string>"))
    options = F.when(k % 10 == 6, s("{}")).otherwise(F.concat(s("["), F.array_join(option, ","), s("]")))
    mode = F.when(k % 10 == 7, s("null")).when(F.col("o_orderpriority") == "1-URGENT", s('"single"')).otherwise(s('"multiple"'))
    media = F.when(k % 9 == 0, s(',"media":["", 5, "a.png"]')).when(k % 9 == 1, s(',"media":"a.png"')).when(k % 9 == 2, s(',"media":null')).otherwise("")
    asked = F.concat(s('{"type":"question","question":"'), F.when(k % 10 == 8, "  ").otherwise(k.cast("string")), s('","options":'), options, s(',"answers":['), F.array_join(F.concat(right, more), ","), s('],"mode":'), mode, media, s("}"))
    item = F.when(k % 8 == 0, s("[]")).when(k % 8 == 1, s('{"type":"quiz"}')).when(k % 8 == 2, F.concat(s('{"type":"context"'), media, s("}"))).when(k % 8 == 3, s('{"type":"title"}')).otherwise(asked)
    d = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", item.alias("t")))), lambda x: x.t), ",").alias("items"))
    c = F.col("o_custkey")
    body = F.concat(s('{"title":'), F.when(c % 13 == 0, s("5")).when(c % 13 == 1, s('" "')).otherwise(s('"t"')), s(',"settings":'), F.when(c % 17 == 0, s("[]")).otherwise(s("{}")), s(',"items":'), F.when(c % 19 == 0, s("{}")).otherwise(F.concat(s("["), F.col("items"), s("]"))), s("}"))
    value = F.when(c % 23 == 0, s('{"title"')).when(c % 29 == 0, s("[]")).otherwise(body)
    found = clean_quiz.issues(d.select(c.cast("string").alias("file"), value.alias("value")))
    return found.groupBy("code", "field", F.array_join("actions", ",").alias("actions")).agg(F.count(F.lit(1)).alias("n"), F.sum("item").alias("items"), F.sum("question").alias("questions"), F.countDistinct("file").alias("files"))


CLEAN = """
WITH l AS (SELECT l_orderkey AS k, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS i FROM lineitem),
g AS (SELECT k, count(*) AS n, count(*) FILTER (f = 'R') AS r FROM l GROUP BY 1),
o AS (SELECT o_custkey AS c, k, n, r, o_orderpriority = '1-URGENT' AS single, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS item FROM orders JOIN g ON k = o_orderkey),
h AS (SELECT *, c % 23 = 0 AS broken, c % 23 <> 0 AND c % 29 = 0 AS listed, c % 23 <> 0 AND c % 29 <> 0 AND c % 19 = 0 AS none FROM o),
q AS (SELECT *, CASE WHEN k % 8 > 3 THEN row_number() OVER (PARTITION BY c, k % 8 > 3 ORDER BY k) END AS question, k % 8 > 3 AS asks, CASE WHEN k % 10 = 6 THEN 0 ELSE n END AS shown,
  r + CASE k % 10 WHEN 3 THEN 2 WHEN 5 THEN r ELSE 0 END AS answers FROM h WHERE NOT broken AND NOT listed AND NOT none),
f AS (SELECT DISTINCT c, broken, listed, none FROM h),
x AS (
  SELECT 'invalid_json' AS code, 'file' AS field, NULL::BIGINT AS item, NULL::BIGINT AS question, c, 1 AS times FROM f WHERE broken
  UNION ALL SELECT 'invalid_schema', 'file', NULL, NULL, c, 1 FROM f WHERE listed
  UNION ALL SELECT 'invalid_schema', 'title', NULL, NULL, c, 1 FROM f WHERE NOT broken AND NOT listed AND c % 13 < 2
  UNION ALL SELECT 'invalid_schema', 'settings', NULL, NULL, c, 1 FROM f WHERE NOT broken AND NOT listed AND c % 17 = 0
  UNION ALL SELECT 'invalid_schema', 'items', NULL, NULL, c, 1 FROM f WHERE none
  UNION ALL SELECT 'invalid_schema', 'item', item, NULL, c, 1 FROM q WHERE k % 8 = 0
  UNION ALL SELECT 'invalid_schema', 'type', item, NULL, c, 1 FROM q WHERE k % 8 = 1
  UNION ALL SELECT 'invalid_schema', 'media', item, question, c, CASE k % 9 WHEN 0 THEN 2 ELSE 1 END FROM q WHERE (asks OR k % 8 = 2) AND k % 9 < 2
  UNION ALL SELECT 'question_text_empty', 'question', item, question, c, 1 FROM q WHERE asks AND k % 10 = 8
  UNION ALL SELECT 'invalid_schema', 'options', item, question, c, 1 FROM q WHERE asks AND k % 10 = 6
  UNION ALL SELECT 'invalid_schema', 'option', item, question, c, 1 FROM q WHERE asks AND k % 10 = 1
  UNION ALL SELECT 'option_text_empty', 'option', item, question, c, 1 FROM q WHERE asks AND k % 10 = 2
  UNION ALL SELECT 'too_few_options', 'options', item, question, c, 1 FROM q WHERE asks AND k % 10 <> 6 AND n < 2
  UNION ALL SELECT 'too_many_options', 'options', item, question, c, 1 FROM q WHERE asks AND shown > 10
  UNION ALL SELECT 'invalid_schema', 'answers', item, question, c, 2 FROM q WHERE asks AND k % 10 = 4
  UNION ALL SELECT 'answer_missing', 'answers', item, question, c, 1 FROM q WHERE asks AND answers = 0
  UNION ALL SELECT 'answer_index_out_of_range', 'answers', item, question, c, CASE k % 10 WHEN 3 THEN 2 ELSE r END FROM q WHERE asks AND (k % 10 = 3 OR k % 10 = 6 AND r > 0)
  UNION ALL SELECT 'answer_index_duplicate', 'answers', item, question, c, 1 FROM q WHERE asks AND k % 10 = 5 AND r > 0
  UNION ALL SELECT 'mode_invalid', 'mode', item, question, c, 1 FROM q WHERE asks AND k % 10 = 7
  UNION ALL SELECT 'mode_answer_count_conflict', 'mode', item, question, c, 1 FROM q WHERE asks AND k % 10 <> 7 AND single AND answers > 1)
SELECT code, field, CASE WHEN question IS NULL THEN 'edit,abort' ELSE 'skip_question,edit,abort' END AS actions, CAST(sum(times) AS BIGINT) AS n, CAST(sum(item * times) AS BIGINT) AS items,
  CAST(sum(question * times) AS BIGINT) AS questions, count(DISTINCT c) AS files FROM x GROUP BY ALL
"""

QUERIES = {f.__name__: f for f in (canonical_trees, payload_blocks, resolved_ids, clean_file_issues)}
ORACLES = {"canonical_trees": CANONICAL, "payload_blocks": PAYLOAD, "resolved_ids": RESOLVED, "clean_file_issues": CLEAN}
