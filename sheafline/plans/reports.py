"""Reports, record files and snapshots, built from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.operators import ledger, ordered, reports
from sheafline.plans.items import table
from sheafline.plans.sequences import _runs
from sheafline.scratch import scratch
from sheafline.sources import clean_quiz, records

S = lambda c: F.col(c).cast("string")


def _quizzes(spark, sf_dir):
    """(file, value): a file a customer with raw questions; some entries are no objects, some files no lists or no JSON."""
    k, s = F.col("o_orderkey"), F.lit
    context = F.when(k % 6 == 0, s('"ab"')).when(k % 6 == 1, s('"twenty letters long xx"')).when(k % 6 == 2, s('"twenty letters long."')).when(k % 6 == 3, s("5")).otherwise(s("null"))
    entry = F.when(k % 9 == 0, s('"none"')).otherwise(F.concat(s('{"source_item_id":'), S("o_orderkey"), s(',"context":'), context, s("}")))
    d = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", entry.alias("t")))), lambda x: x.t), ",").alias("items"))
    c, items = F.col("o_custkey"), F.concat(s("["), F.col("items"), s("]"))
    return d.select(S("o_custkey").alias("file"), F.when(c % 31 == 0, s('{"questions":{}}')).when(c % 37 == 0, s("[")).when(c % 2 == 0, items).otherwise(F.concat(s('{"questions":'), items, s("}"))).alias("value"))


def quality_warnings(spark, sf_dir):
    """Raw items zipped with parsed questions by their place, then warnings on contexts and options."""
    files = _quizzes(spark, sf_dir).withColumn("doc", F.try_parse_json("value"))
    raw = records.raw_items(files, "file", "doc")
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    o = table(spark, sf_dir, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    place = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "lines"))), lambda x: x)
    q = o.groupBy(S("o_custkey").alias("file")).agg(place.alias("q")).select("file", F.posexplode("q").alias("p", "q"))
    options = F.transform("q.lines", lambda x: F.concat(x.l_partkey.cast("string"), F.when(x.l_partkey % 7 == 0, "…").when(x.l_partkey % 11 == 0, "...").otherwise("")))
    q = q.select("file", (F.col("p") + 1).alias("pos"), F.col("q.o_orderkey").alias("o_orderkey"), options.alias("options"), F.when(F.col("q.o_orderkey") % 4 == 0, "fourteen chars").alias("context"))
    both = reports.zipped(q, raw, "file", "pos")
    is_text = F.schema_of_variant(F.try_variant_get("item", "$.context", "variant")) == "STRING"
    return reports.quality_warnings(both, ["o_orderkey"], "options", F.when(is_text, F.try_variant_get("item", "$.context", "string")), F.col("context"))


QUALITY = """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
t AS (
  SELECT k, CASE WHEN c % 31 <> 0 AND c % 37 <> 0 AND k % 9 <> 0 AND k % 6 < 3 THEN CASE k % 6 WHEN 0 THEN 'ab' WHEN 1 THEN 'twenty letters long xx' ELSE 'twenty letters long.' END WHEN k % 4 = 0 THEN 'fourteen chars' ELSE '' END AS told FROM o),
l AS (SELECT l_orderkey AS k, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT k AS o_orderkey, 'short_context' AS code, NULL AS option FROM t WHERE length(told) BETWEEN 1 AND 14
UNION ALL SELECT k, 'context_fragment', NULL FROM t WHERE length(told) BETWEEN 15 AND 44 AND NOT regexp_matches(told, '[.!?;:]')
UNION ALL SELECT k, 'truncated_option', i FROM l WHERE p % 7 = 0 OR p % 11 = 0
"""


def invalid_lists(spark, sf_dir):
    files = _quizzes(spark, sf_dir).withColumn("doc", F.try_parse_json("value"))
    return records.invalid_lists(files, "file", "doc")


INVALID = "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS file FROM orders WHERE o_custkey % 31 = 0 OR o_custkey % 37 = 0"


def reused_distractors(spark, sf_dir):
    """Words of a part's name as options: the raw ones were guessed for every other part."""
    p = table(spark, sf_dir, "part").withColumn("w", F.split("p_name", " "))
    found = reports.reused_distractors(F.concat(F.transform("w", F.upper), F.array(F.lit("new"))), F.array(F.get("w", F.lit(0))), F.concat("w", F.array(F.col("p_brand"))), F.slice("w", 1, 2), F.col("p_partkey") % 2 == 0)
    return p.select("p_partkey", F.array_join(found, "|").alias("reused"))


REUSED = """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN array_to_string(list_transform(list_filter(w, lambda x: x <> w[1] AND NOT list_contains(w[1:2], x)), lambda x: upper(x)), '|') ELSE '' END AS reused
FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)
"""


def split_report(spark, sf_dir):
    """Turns of a conversation in two halves, the system's words as context, every third turn with media."""
    c = ordered.carry_forward(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.md5("text"), F.col("role") == "system", F.length("text") > 2500, "context")
    media = F.when(F.col("turn") % 3 == 0, F.array("role", "role")).otherwise(F.array().cast("array<string>"))
    return reports.split_report(c.withColumn("part", (F.col("turn") % 4 >= 2).cast("int")), "conv_id", "part", "turn", F.col("context"), media)


SPLIT = """
WITH c AS (SELECT *, CAST(turn % 4 >= 2 AS INT) AS part, coalesce(last_value(CASE WHEN role = 'system' THEN md5(text) WHEN length(text) > 2500 THEN '' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '') AS context FROM conversations),
d AS (SELECT *, coalesce(lag(context) OVER (PARTITION BY conv_id, part ORDER BY turn), '') AS before FROM c)
SELECT conv_id, part, count(*) AS questions, count(*) FILTER (context <> '' AND context <> before) AS context_runs, CAST(sum(CASE WHEN turn % 3 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS media_refs FROM d GROUP BY 1, 2
"""


def build_totals(spark, sf_dir):
    """Counts of a build: blocks, windows, questions that are valid or for review, media that no file has."""
    c, o = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    windows = c.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.sequence(F.lit(1).cast("long"), reports.chunks(F.col("n")))).alias("w"))
    missing = table(spark, sf_dir, "lineitem").select("l_partkey").distinct().join(table(spark, sf_dir, "part").where("p_size > 10"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")
    same = F.col("o_orderkey") == F.col("l_orderkey")
    return reports.totals(blocks=c, chunks=windows, parsed_questions=o, valid_questions=o.join(lines, same, "left_semi"), review_count=o.join(lines, same, "left_anti"), missing_media_count=missing)


TOTALS = """
SELECT 'blocks' AS name, count(*) AS n FROM conversations UNION ALL SELECT 'chunks', CAST(ceil(count(*) / 240.0) AS BIGINT) FROM conversations UNION ALL SELECT 'parsed_questions', count(*) FROM orders
UNION ALL SELECT 'valid_questions', count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'review_count', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'missing_media_count', count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)
"""


def question_snapshots(spark, sf_dir):
    """Texts and options of the questions of clean files, by their number."""
    k, s = F.col("o_orderkey"), F.lit
    item = F.when(k % 5 == 0, s('{"type":"context"}')).when(k % 5 == 1, s("7")).when(k % 5 == 2, F.concat(s('{"type":"question","question":5,"options":[{"text":"'), F.col("o_orderpriority"), s('"},{"text":1},"x"]}'))).otherwise(F.concat(s('{"type":"question","question":"'), S("o_orderkey"), s('"}')))
    d = table(spark, sf_dir, "orders").groupBy(S("o_custkey").alias("file")).agg(F.concat(s('{"items":['), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", item.alias("t")))), lambda x: x.t), ","), s("]}")).alias("value"))
    found = clean_quiz.snapshots(d)
    return found.select("file", "index", "question_text", F.array_join("options", "|").alias("options"))


SNAPSHOTS = """
SELECT CAST(o_custkey AS VARCHAR) AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS "index", CASE WHEN o_orderkey % 5 = 2 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS question_text,
  CASE WHEN o_orderkey % 5 = 2 THEN o_orderpriority ELSE '' END AS options FROM orders WHERE o_orderkey % 5 >= 2
"""


def run_state_files(spark, sf_dir):
    """A state file a run in folders of their own, some broken, read back as what may be shown."""
    path, s = scratch(spark, "states"), F.lit
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("u")).agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.when(F.col("event_type") == "purchase", F.col("event_id") % 50))), lambda x: x.cast("string")), ",").alias("up"), F.max("event_id").alias("last"))
    body = F.when(F.col("u") % 12 == 5, s("{no json")).otherwise(F.concat(s('{"run_id":"r'), S("u"), s('","status":"paused","uploaded":['), F.col("up"), s('],"next":'), (F.col("last") % 50).cast("string"), s(',"source":"/home/x/quiz '), S("u"), s('.json","session":"hidden"}')))
    records.write_texts(e.withColumn("body", body), path, "u", "body")
    found = records.run_states(spark, path, "part-*")
    return found.select(F.regexp_extract("run", r"(\d+)$", 1).cast("long").alias("u"), records.safe_state(F.col("state")).alias("x")).select("u", "x.*")


STATES = """
SELECT user_id AS u, 'r' || user_id AS run_id, 'paused' AS status, count(DISTINCT event_id % 50) FILTER (event_type = 'purchase') AS uploaded, 0 AS skipped, max(event_id) % 50 AS next, 'quiz ' || user_id || '.json' AS source
FROM events WHERE user_id % 12 <> 5 GROUP BY user_id
"""


def usable_results(spark, sf_dir):
    """Earlier results: rows without a field, with a wrong type or a null inside are dropped, so are broken files."""
    k, s = F.col("o_orderkey"), F.lit
    item = F.when(k % 7 == 0, s("3")).when(k % 7 == 1, F.concat(s('{"id":'), S("o_orderkey"), s(',"question":"q"}'))).when(k % 7 == 2, s('{"id":"x","question":"q","options":["a"]}')).when(k % 7 == 3, F.concat(s('{"id":'), S("o_orderkey"), s(',"question":"q","options":["a",null]}')))
    item = item.otherwise(F.concat(s('{"id":'), S("o_orderkey"), s(',"question":"q '), S("o_orderkey"), s('","options":["a","'), F.col("o_orderpriority"), s('"]}')))
    d = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", item.alias("t")))), lambda x: x.t), ",").alias("t"))
    value = F.when(F.col("o_custkey") % 11 == 0, s("[")).when(F.col("o_custkey") % 11 == 1, s("[]")).otherwise(F.concat(s('{"questions":['), F.col("t"), s("]}")))
    found = records.usable_results(d.select(S("o_custkey").alias("file"), value.alias("value")), "file", "value", {"id": "long", "question": "string", "options": "array<string>"})
    return found.select("file", "pos", "id", "question", F.array_join("options", "|").alias("options"))


USABLE = """
SELECT * FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderkey AS id, 'q ' || o_orderkey AS question, 'a|' || o_orderpriority AS options
  FROM orders WHERE o_custkey % 11 > 1) WHERE id % 7 > 3
"""


def plain_texts(spark, sf_dir):
    """Texts with line ends of three systems written as files and read back."""
    path = scratch(spark, "texts")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "\r\n\r").alias("text"))
    records.write_texts(c, path, "conv_id", "text")
    back = records.whole_texts(spark, path, "part-*")
    return back.select(F.regexp_extract("_metadata.file_path", r"conv_id=(\d+)", 1).cast("long").alias("conv_id"), F.md5(F.regexp_replace("value", "\n$", "")).alias("md5"), F.instr("value", "\r").alias("returns"))


PLAIN = r"""
SELECT conv_id, md5(regexp_replace(regexp_replace(string_agg(text, chr(13) || chr(10) || chr(13) ORDER BY turn), '\r\n?', chr(10), 'g'), '\n$', '')) AS md5, 0 AS returns FROM conversations GROUP BY 1
"""


def request_messages(spark, sf_dir):
    """Requests on parts as JSON, and the object in a reply with words around it."""
    p = table(spark, sf_dir, "part")
    asked = records.message("Answer in JSON.", F.concat_ws("\n", "p_name", "p_brand"), "question")
    reply = F.when(F.col("p_partkey") % 5 == 0, "no object").otherwise(F.concat(F.lit("Here it is:\n```json\n"), F.lit('{"a": {"size": '), S("p_size"), F.lit("}}\n``` done")))
    return p.select("p_partkey", F.md5(asked).alias("md5"), F.try_variant_get(T.json_object(reply), "$.a.size", "int").alias("size"))


REQUESTS = """
SELECT p_partkey, md5('{"messages":[{"role":"system","content":"Answer in JSON."},{"role":"user","content":"' || p_name || '\\n' || p_brand || '"}],"schema":"question"}') AS md5, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS size FROM part
"""


def continue_steps(spark, sf_dir):
    """What continuing each run from another question undoes or skips."""
    events = _runs(spark, sf_dir)
    net = events.groupBy("user_id", "index").agg(F.max_by("kind", "event_id").alias("kind"))
    at = ledger.snapshot(events, "user_id", "event_id").where("next_index IS NOT NULL").select("user_id", "next_index")
    return reports.steps_to(net, "user_id", "index", F.col("kind"), at, F.pmod("user_id", F.lit(110)).cast("int") + 1)


STEPS = """
WITH runs AS (
  SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'uploaded' WHEN 'signup' THEN 'skipped' WHEN 'error' THEN 'undone' END AS kind, CAST(json_extract(props, '$.k') AS INTEGER) AS idx FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
net AS (SELECT user_id, idx, arg_max(kind, event_id) AS kind FROM runs GROUP BY 1, 2),
a AS (SELECT user_id, max(idx) FILTER (kind <> 'undone') + 1 AS next, user_id % 110 + 1 AS target FROM net GROUP BY 1)
SELECT net.user_id, 'undo' AS action, idx AS "index" FROM net JOIN a ON a.user_id = net.user_id WHERE kind = 'uploaded' AND target < next AND idx >= target
UNION ALL SELECT user_id, 'skip', unnest(generate_series(next, target - 1)) FROM a WHERE target > next
"""

QUERIES = {f.__name__: f for f in (quality_warnings, invalid_lists, reused_distractors, split_report, build_totals, question_snapshots, run_state_files, usable_results, plain_texts, request_messages, continue_steps)}
ORACLES = {
    "quality_warnings": QUALITY, "invalid_lists": INVALID, "reused_distractors": REUSED, "split_report": SPLIT, "build_totals": TOTALS, "question_snapshots": SNAPSHOTS, "run_state_files": STATES,
    "usable_results": USABLE, "plain_texts": PLAIN, "request_messages": REQUESTS, "continue_steps": STEPS,
}
