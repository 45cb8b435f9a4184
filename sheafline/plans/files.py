"""Queries on line formats, exports and streams: what is written is read back and given."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.plans.items import questions, table
from sheafline.scratch import scratch
from sheafline.sources import item_json, markup, sinks
from sheafline.streaming import jobs


def option_line_split(spark, sf_dir):
    """All options of a line, in either alphabet; a line that starts otherwise has none."""
    letters = F.when(F.col("p_partkey") % 3 == 0, F.array(*[F.lit(x) for x in "АВСD"])).otherwise(F.array(*[F.lit(x) for x in "ABCD"]))
    words = F.slice(F.split("p_name", " "), 1, 4)
    line = F.array_join(F.transform(words, lambda w, i: F.concat(F.get(letters, i), F.when(F.col("p_partkey") % 2 == 0, ") ").otherwise(". "), w)), " ")
    line = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("so "), line)).otherwise(line)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.option_parts(line), "|").alias("options"))


OPTIONS = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE array_to_string(string_split(p_name, ' ')[1:4], '|') END AS options FROM part"


def _blocks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.length(F.trim("text")) > 0)
    kind = F.when(F.col("turn") % 6 == 4, "break").when(F.col("turn") % 6 == 3, "image").otherwise("paragraph")
    name = F.concat(F.when(kind == "image", "img").otherwise("b"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    return c.select("conv_id", F.col("turn").alias("pos"), name.alias("block_id"), kind.alias("kind"), F.regexp_replace("text", r"\s+", " ").alias("text"))


def block_stream_parse(spark, sf_dir):
    """Turns as a block stream, parsed again: breaks are gone, images name the block before them."""
    text = sinks.block_stream_text(_blocks(spark, sf_dir), "conv_id")
    found = markup.block_stream(markup.lines_of(text, "conv_id", "text"), "conv_id")
    return found.select("conv_id", "order", "block_id", "kind", F.try_element_at("meta", F.lit("after")).alias("after"), F.length("text").alias("chars"))


BLOCKS = r"""
WITH b AS (
  SELECT conv_id, turn, CASE WHEN turn % 6 = 4 THEN 'break' WHEN turn % 6 = 3 THEN 'image' ELSE 'paragraph' END AS kind,
    length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM conversations WHERE length(trim(text)) > 0),
k AS (SELECT *, CASE WHEN kind = 'image' THEN 'img' ELSE 'b' END || lpad(CAST(turn AS VARCHAR), 4, '0') AS id FROM b),
p AS (SELECT *, row_number() OVER w AS "order", lag(id) OVER w AS before FROM k WHERE kind <> 'break' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, "order", id AS block_id, kind, CASE WHEN kind = 'image' THEN coalesce(before, '') END AS after, CASE WHEN kind <> 'image' THEN n END AS chars FROM p
"""


def _marked(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    q = questions(spark, sf_dir).where(F.size("options") > 0).join(o, "o_orderkey")
    context = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("about "), "o_orderpriority"))
    return q.select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("section"), context.alias("context"), "question", "options", "answers", F.when(F.col("o_orderkey") % 4 == 0, "because").alias("explanation"))


def marker_parse(spark, sf_dir):
    """Questions written as marker files and parsed again."""
    text = sinks.marker_text(_marked(spark, sf_dir), "o_custkey", "o_orderkey")
    found = markup.marker_items(markup.lines_of(text, "o_custkey", "text"), "o_custkey").where("type = 'question'")
    return found.select(
        "o_custkey", "question", "section", F.array_join("options", "|").alias("options"),
        F.array_join(F.transform("answers", lambda a: a.cast("string")), ",").alias("answers"), F.coalesce(F.nullif("explanation", F.lit("")), F.lit("-")).alias("explanation"),
    )


MARKED = """
WITH l AS (SELECT l_orderkey AS k, l_partkey AS p, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS i FROM lineitem),
g AS (SELECT k, string_agg(p, '|' ORDER BY i) AS o, string_agg(i, ',' ORDER BY i) FILTER (f = 'R') AS a FROM l GROUP BY 1)
SELECT o_custkey, 'question ' || o_orderkey AS question, o_orderpriority AS section, o AS options, coalesce(a, '') AS answers, CASE WHEN o_orderkey % 4 = 0 THEN 'because' ELSE '-' END AS explanation
FROM orders JOIN g ON k = o_orderkey
"""


def marker_issue_rows(spark, sf_dir):
    """Lines of marker files that are broken on purpose, by code."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 7
    body = (
        F.when(k == 0, "#SECTIONX\n#Q\nask\n#A\none\n#END_Q").when(k == 1, "#Q\nask\n#WHAT\n#A\none\n#END_Q").when(k == 2, "lost line\n#Q\nask\n#END_Q")
        .when(k == 3, "#CONTEXT\nabout").when(k == 4, "#CONTEXT\n#END_CONTEXT\n#SECTION:\n").when(k == 5, "#Q\n#A*\n\n#A\ntwo\n#END_Q").otherwise("#SECTION: t\n#Q\nask\n#A\none\n#A*\ntwo")
    )
    lines = markup.lines_of(p.select("p_partkey", body.alias("value")), "p_partkey")
    return markup.strict_issues(lines, "p_partkey").select("p_partkey", "code", "severity")


ISSUES = """
SELECT p_partkey, i.code AS code, i.severity AS severity FROM part JOIN (VALUES
  (0, 'strict_section_marker_invalid', 'error'), (0, 'too_few_options', 'error'), (0, 'answer_missing', 'error'),
  (1, 'strict_unknown_marker_in_question', 'error'), (1, 'too_few_options', 'error'), (1, 'answer_missing', 'error'),
  (2, 'strict_text_outside_block', 'error'), (2, 'too_few_options', 'error'), (2, 'answer_missing', 'error'),
  (3, 'strict_context_missing_end', 'error'), (4, 'strict_context_empty', 'warning'), (4, 'strict_section_title_empty', 'error'),
  (5, 'question_text_empty', 'error'), (5, 'option_text_empty', 'error'), (6, 'strict_question_missing_end', 'error')) i(k, code, severity) ON p_partkey % 7 = i.k
"""


def exported_groups(spark, sf_dir):
    """Questions exported by group as JSON lines, read back from their folders."""
    path = scratch(spark, "export")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("date"), F.col("o_orderpriority").alias("section"))
    rows = questions(spark, sf_dir).join(o, "o_orderkey").select("o_orderkey", "question", "options", "answers", "date", "section")
    sinks.export_groups(rows, path, "date", "section")
    back = spark.read.schema("o_orderkey long, question string, options array<string>, answers array<int>, date string, section string, group_slug string").json(path)
    return back.groupBy("date", "section").agg(F.count(F.lit(1)).alias("questions"), F.sum(F.size("options")).alias("options"), F.countDistinct("group_slug").alias("folders"))


EXPORTED = """
SELECT o_orderstatus AS date, o_orderpriority AS section, count(*) AS questions, CAST(sum(coalesce(n, 0)) AS BIGINT) AS options, 1 AS folders
FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) ON k = o_orderkey GROUP BY 1, 2
"""


def single_group_file(spark, sf_dir):
    """One group as a file of upload rows, read back with shapes told apart; a broken file gives an issue."""
    path = scratch(spark, "group")
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    rows = questions(spark, sf_dir).join(o, "o_orderkey").select("o_custkey", "o_orderkey", F.struct("question", "options", F.col("answers").alias("correct")).alias("q"))
    quiz = rows.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "q"))), lambda x: x.q).alias("questions"))
    text = F.when(F.col("o_custkey") % 10 == 0, "{broken").otherwise(F.to_json(F.struct(F.lit("quiz").alias("quiz_title"), "questions")))
    quiz.select(F.col("o_custkey").cast("string").alias("c"), text.alias("value")).write.parquet(path)
    files = spark.read.parquet(path).select(F.col("c").alias("file"), "value", F.try_parse_json("value").alias("doc"))
    good = item_json.questions(files.where("doc IS NOT NULL")).groupBy("file").agg(F.count(F.lit(1)).alias("questions"), F.sum(F.size("answers")).alias("answers"))
    bad = item_json.invalid(files).select("file", "code")
    return good.join(bad, "file", "full").select(F.col("file").cast("long").alias("o_custkey"), "questions", "answers", "code")


SINGLE = """
SELECT o_custkey, CASE WHEN o_custkey % 10 <> 0 THEN count(*) END AS questions, CASE WHEN o_custkey % 10 <> 0 THEN CAST(sum(coalesce(n, 0)) AS BIGINT) END AS answers,
  CASE WHEN o_custkey % 10 = 0 THEN 'invalid_json' END AS code
FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON k = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1
"""


def streamed_jobs(spark, sf_dir):
    """Events replayed as a stream into an idempotent ledger, then folded by user."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    path = scratch(spark, "ledger")
    jobs.write_ledger(stream, path, scratch(spark, "offsets")).awaitTermination()
    events = jobs.ledger(spark, path, ["event_id"], "ts")
    return jobs.fold_stream(events, "user_id", "event_id", ["event_type", "props"]).select("user_id", "events", "last", "event_type", "props")


STREAMED = """
SELECT user_id, count(*) AS events, max(event_id) AS "last", arg_max(event_type, event_id) AS event_type, arg_max(props, event_id) AS props FROM events GROUP BY 1
"""


QUERIES = {f.__name__: f for f in (option_line_split, block_stream_parse, marker_parse, marker_issue_rows, exported_groups, single_group_file, streamed_jobs)}
ORACLES = {
    "option_line_split": OPTIONS, "block_stream_parse": BLOCKS, "marker_parse": MARKED, "marker_issue_rows": ISSUES, "exported_groups": EXPORTED,
    "single_group_file": SINGLE, "streamed_jobs": STREAMED,
}
