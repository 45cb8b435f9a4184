"""Documents built from orders, read back as questions with contexts and issues of page breaks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheafline.operators import prepare as P
from sheafline.plans.items import table
from sheafline.scratch import written

KEY = "o_orderkey"


def _documents(spark, sf_dir):
    """A document a customer; each order gives a heading, texts, an image (some do), a line that asks, its lines as options and an answer line."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    packed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias(KEY)).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    o = table(spark, sf_dir, "orders").select("o_custkey", KEY).join(packed, KEY)
    k = F.col(KEY)
    name = k.cast("string")
    block = lambda kind, text, bold=F.lit(False), cut=F.lit(False), media=None: F.struct(F.lit(kind).alias("kind"), text.alias("text"), bold.alias("bold"), cut.alias("page_break"), (F.array(media) if media is not None else F.array().cast("array<string>")).alias("media"))
    options = F.transform("lines", lambda x, i: block("paragraph", F.concat(F.char(i % 4 + 65), F.lit(") part "), x.l_partkey.cast("string")), x.l_returnflag == "R", (k % 13 == 0) & (i == 1)))
    some = lambda when, b: F.when(when, F.array(b))
    asks = block("paragraph", F.when(k % 36 == 0, F.concat(F.lit("A) Which "), name, F.lit("?"))).otherwise(F.concat(F.lit("Order "), name, F.lit(":"))), cut=k % 11 == 0)
    pieces = [
        some(k % 5 == 0, block("heading", F.concat(F.lit("Section "), name))), some(k % 4 == 0, block("paragraph", F.concat(F.lit("Context "), name))),
        some(k % 12 == 0, block("paragraph", F.concat(F.lit("More "), name), cut=F.lit(True))), some(k % 9 == 0, block("image", F.lit(""), media=F.concat(name, F.lit(".png")))),
        F.array(asks), options, some(k % 3 == 0, block("paragraph", F.lit("Ответ: D"), cut=k % 6 == 0)),
    ]
    every = F.flatten(F.array_compact(F.array(*pieces)))
    rows = o.select("o_custkey", KEY, F.posexplode(every).alias("at", "b")).select(F.col("o_custkey").cast("string").alias("document"), KEY, "at", "b.*")
    pos = F.row_number().over(Window.partitionBy("document").orderBy(KEY, "at"))
    return rows.withColumn("pos", pos).drop(KEY, "at")


def prepared_questions(spark, sf_dir):
    q, contexts, _ = P.prepare(written(_documents(spark, sf_dir), "documents"))
    q = q.join(contexts.select("document", "context", F.col("text").alias("told"), F.array_join("media", "|").alias("media")), ["document", "context"], "left")
    return q.select(
        "document", "question", "text", F.size("options").cast("long").alias("n_options"), F.array_join(F.transform("answers", lambda a: a.cast("string")), ",").alias("answers"), "mode", "source", "title",
        "context", "told", "media", F.array_join("codes", ",").alias("codes"), "broken",
    )


def prepared_issues(spark, sf_dir):
    _, _, issues = P.prepare(written(_documents(spark, sf_dir), "documents"))
    return issues.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document").alias("documents"), F.sum("question").alias("questions"), F.sum("pos").alias("places"))


# Events of each order in the order of its blocks: h heading, t text of a context, m image, q question; then what stands before each question.
_FACTS = """
WITH l AS (SELECT l_orderkey AS k, l_returnflag AS f, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS i FROM lineitem),
g AS (
  SELECT CAST(o_custkey AS VARCHAR) AS document, k, count(*) AS n, coalesce(list(i ORDER BY i) FILTER (f = 'R'), []) AS bold, min(p) FILTER (i = 1) AS p1
  FROM l JOIN orders ON o_orderkey = k GROUP BY 1, 2),
b AS (
  SELECT *, (k % 5 = 0)::INT AS h, (k % 4 = 0)::INT AS c1, (k % 12 = 0)::INT AS c2, (k % 9 = 0)::INT AS m, (k % 3 = 0)::INT AS t, n >= 2 AS isq FROM g),
s AS (
  SELECT *, coalesce(sum(h + c1 + c2 + m + 1 + n + t) OVER (PARTITION BY document ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM b),
e AS (
  SELECT document, k, base + 1 AS pos, 'h' AS e, 'Section ' || k AS text, false AS cut FROM s WHERE h = 1
  UNION ALL SELECT document, k, base + h + 1, 't', 'Context ' || k, false FROM s WHERE c1 = 1
  UNION ALL SELECT document, k, base + h + c1 + 1, 't', 'More ' || k, true FROM s WHERE c2 = 1
  UNION ALL SELECT document, k, base + h + c1 + c2 + 1, 'm', k || '.png', false FROM s WHERE m = 1
  UNION ALL SELECT document, k, base + h + c1 + c2 + m + 1, CASE WHEN isq THEN 'q' ELSE 't' END, CASE WHEN k % 36 = 0 THEN 'A) Which ' || k || '?' ELSE 'Order ' || k || ':' END, k % 11 = 0 FROM s
  UNION ALL SELECT document, k, base + h + c1 + c2 + m + 2, 't', 'A) part ' || p1, false FROM s WHERE NOT isq
  UNION ALL SELECT document, k, base + h + c1 + c2 + m + 3, 't', 'Ответ: D', k % 6 = 0 FROM s WHERE NOT isq AND t = 1),
x AS (SELECT *, sum((e IN ('h', 'q'))::INT) OVER (PARTITION BY document ORDER BY pos) - (e IN ('h', 'q'))::INT AS seg FROM e),
y AS (
  SELECT document, seg, max(pos) FILTER (e IN ('h', 'q')) AS pos, max(k) FILTER (e = 'q') AS k, max(e) FILTER (e IN ('h', 'q')) AS edge, coalesce(bool_or(cut) FILTER (e IN ('h', 'q')), false) AS cut,
    coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (e = 't'), '') AS told, coalesce(string_agg(text, '|' ORDER BY pos) FILTER (e = 'm'), '') AS media, count(*) FILTER (e IN ('t', 'm')) AS own,
    max(text) FILTER (e = 'h') AS head FROM x GROUP BY 1, 2),
z AS (
  SELECT *, sum((edge = 'q' AND own > 0)::INT) OVER w AS ctx, sum((edge = 'q')::INT) OVER w AS question, max(CASE WHEN edge = 'h' THEN pos END) OVER w AS head_pos FROM y WHERE edge IS NOT NULL
  WINDOW w AS (PARTITION BY document ORDER BY pos)),
u AS (
  SELECT *, max(CASE WHEN edge = 'q' AND own > 0 THEN pos END) OVER (PARTITION BY document ORDER BY pos) AS set_pos,
    max(CASE WHEN edge = 'q' AND own = 0 AND cut THEN pos END) OVER (PARTITION BY document ORDER BY pos) AS cut_pos,
    max(CASE WHEN edge = 'q' AND own = 0 AND cut THEN pos END) OVER (PARTITION BY document ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cut_before FROM z),
v AS (
  SELECT *, set_pos IS NOT NULL AND set_pos > coalesce(greatest(head_pos, cut_pos), -1) AS held,
    edge = 'q' AND own = 0 AND cut AND set_pos IS NOT NULL AND set_pos > coalesce(greatest(head_pos, cut_before), -1) AS leak FROM u),
q AS (
  SELECT v.document, v.question, v.pos, s.k, s.n, s.h + s.c1 + s.c2 + s.m + s.base AS before, v.leak, CASE WHEN v.held THEN v.ctx END AS context, s.bold, s.t = 1 AND s.n >= 4 AND s.n < 8 AS line, s.t = 1 AND (s.n < 4 OR s.n >= 8) AS lost,
    s.k % 13 = 0 AS cut_option, s.t = 1 AND s.k % 6 = 0 AS cut_answer, hd.head AS title FROM v JOIN s USING (document, k)
  LEFT JOIN v hd ON hd.document = v.document AND hd.edge = 'h' AND hd.pos = v.head_pos WHERE v.edge = 'q'),
r AS (
  SELECT *, CASE WHEN line AND len(bold) > 0 AND bold = [4] THEN 'both_match' WHEN line AND len(bold) > 0 THEN 'conflict' WHEN line THEN 'answer_line' WHEN len(bold) > 0 THEN 'bold_option' ELSE 'unknown' END AS source FROM q),
a AS (
  SELECT *, CASE source WHEN 'both_match' THEN [4] WHEN 'answer_line' THEN [4] WHEN 'bold_option' THEN bold ELSE [] END AS good,
    concat_ws(',', CASE WHEN cut_option THEN 'question_split_by_page_break' END, CASE WHEN cut_answer THEN 'question_split_by_page_break' END, CASE WHEN lost THEN 'answer_label_unknown' END,
      CASE WHEN source = 'conflict' THEN 'answer_bold_and_line_conflict' END, CASE WHEN source = 'unknown' AND NOT lost THEN 'answer_missing' END) AS codes FROM r)
"""
QUESTIONS = _FACTS + """
SELECT a.document, question, CASE WHEN k % 36 = 0 THEN 'Which ' || k || '?' ELSE 'Order ' || k END AS text, n AS n_options, array_to_string(good, ',') AS answers,
  CASE len(good) WHEN 0 THEN 'unknown' WHEN 1 THEN 'single' ELSE 'multiple' END AS mode, source, title, context, c.told, c.media, codes, nullif(string_split(codes, ',')[1], '') AS broken
FROM a LEFT JOIN (SELECT document, ctx, told, media FROM v WHERE edge = 'q' AND own > 0) c ON c.document = a.document AND c.ctx = a.context
"""
ISSUES = _FACTS + """,
o AS (SELECT document, pos, cut, row_number() OVER (PARTITION BY document, seg ORDER BY pos) AS i FROM x WHERE e = 't'),
i AS (
  SELECT document, pos, 'context_continued_across_page_break' AS code, 'info' AS severity, NULL AS question FROM o WHERE cut AND i > 1
  UNION ALL SELECT document, pos, 'context_leak_blocked_by_page_break', 'warning', NULL FROM q WHERE leak
  UNION ALL SELECT document, before + 3, 'question_split_by_page_break', 'error', question FROM q WHERE cut_option
  UNION ALL SELECT document, before + n + 2, 'question_split_by_page_break', 'error', question FROM q WHERE cut_answer
  UNION ALL SELECT document, pos, code, 'error', question FROM (SELECT *, unnest(list_filter(string_split(codes, ','), lambda c: c <> '' AND c <> 'question_split_by_page_break')) AS code FROM a))
SELECT code, severity, count(*) AS n, count(DISTINCT document) AS documents, CAST(sum(question) AS BIGINT) AS questions, CAST(sum(pos) AS BIGINT) AS places FROM i GROUP BY 1, 2
"""

QUERIES = {f.__name__: f for f in (prepared_questions, prepared_issues)}
ORACLES = {"prepared_questions": QUESTIONS, "prepared_issues": ISSUES}
