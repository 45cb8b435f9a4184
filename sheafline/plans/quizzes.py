"""Queries on building, checking and exporting questions. Orders stand for questions, their lines for options."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.functions import values as V
from sheafline.operators import answers, ordered, rules
from sheafline.operators import blocks as B
from sheafline.operators import questions as Q
from sheafline.plans.items import questions, table
from sheafline.scratch import written

S = lambda c: F.col(c).cast("string")


# ------------------------------------------------------------------ values
def neighbour_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = (F.col("o_custkey") % 21 + 1).cast("int")
    century = F.concat(V.roman(n), F.lit(" веке"))
    year = F.when(F.col("o_orderkey") % 2 == 0, F.year("o_orderdate")).otherwise(F.lit(100))
    return o.select(
        "o_orderkey", F.array_join(Q.number_distractors(century), ",").alias("centuries"),
        F.array_join(Q.number_distractors(year.cast("string")), ",").alias("years"),
        F.array_join(Q.number_distractors(F.col("o_orderpriority")), ",").alias("none"),
    )


NEIGHBOURS = """
WITH r AS (SELECT ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX','XXI'] AS names),
n AS (SELECT o_orderkey, CAST(o_custkey % 21 + 1 AS INT) AS n, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) ELSE 100 END AS y FROM orders)
SELECT o_orderkey,
  array_to_string(list_transform(list_filter([n-1, n+1, n+2, n-2], lambda x: x BETWEEN 1 AND 21)[1:3], lambda x: names[x] || ' веке'), ',') AS centuries,
  array_to_string(list_filter([y-1, y+1, y+5, y-5, y+10, y-10], lambda x: x > 0)[1:3], ',') AS years, '' AS "none"
FROM n, r
"""


# ------------------------------------------------------------------ answers from labels, lines and bold options
def _evidence(spark, sf_dir):
    """A line is an option, the fifth and later ones with labels of no scheme; every seventh question has a Cyrillic label among Latin ones, lines come in several spellings."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    packed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    letter = lambda i: F.char(i + 65)
    q = packed.withColumn("labels", F.transform("lines", lambda x, i: F.when((F.col("l_orderkey") % 7 == 0) & (i == 1), "Б").otherwise(letter(i))))
    named = F.array_join(F.array_compact(F.transform("lines", lambda x, i: F.when(x.l_returnflag == "R", letter(i)))), ", ")
    at = F.col("l_orderkey")
    said = (
        F.when(at % 11 == 0, "Ответ: да").when(at % 5 == 0, F.concat(F.lit("Источник: "), named))
        .when(at % 3 == 0, F.concat(F.lit("Правильный  ответ： "), F.lower(named))).otherwise(F.concat(F.lit("✅ Ответ: "), named))
    )
    bold = F.array_compact(F.transform("lines", lambda x, i: F.when(x.l_linestatus == "O", i + 1)))
    return q.select("l_orderkey", "labels", F.when(named != "", said).alias("line"), bold.alias("bold"))


def answer_evidence(spark, sf_dir):
    e = _evidence(spark, sf_dir).withColumn("r", answers.resolve(F.col("labels"), F.col("line"), F.col("bold")))
    return e.select(
        "l_orderkey", answers.label_scheme(F.col("labels")).alias("scheme"), F.array_join(F.transform("r.answers", lambda a: a.cast("string")), ",").alias("answers"),
        F.col("r.mode").alias("mode"), F.col("r.source").alias("source"), F.array_join("r.issues", ",").alias("issues"),
    )


EVIDENCE = """
WITH l AS (
  SELECT l_orderkey, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus) AS i
  FROM lineitem),
p AS (
  SELECT l_orderkey, count(*) AS n, coalesce(list(i ORDER BY i) FILTER (l_returnflag = 'R'), []) AS named,
    coalesce(list(i ORDER BY i) FILTER (l_linestatus = 'O'), []) AS bold FROM l GROUP BY 1),
s AS (
  SELECT *, l_orderkey % 7 = 0 AND n > 1 AS mixed,
    len(named) > 0 AND l_orderkey % 11 <> 0 AND l_orderkey % 5 <> 0 AND list_max(named) <= 4 AS told,
    len(named) > 0 AND (l_orderkey % 11 = 0 OR l_orderkey % 5 <> 0 AND list_max(named) > 4) AS wrong FROM p),
a AS (
  SELECT *, CASE WHEN NOT told THEN [] WHEN mixed THEN list_filter(named, lambda x: x <> 2) ELSE named END AS line,
    told AND mixed AND list_contains(named, 2) AS lost FROM s),
r AS (
  SELECT *, CASE WHEN len(line) > 0 AND len(bold) > 0 AND line = bold THEN 'both_match' WHEN len(line) > 0 AND len(bold) > 0 THEN 'conflict'
    WHEN len(line) > 0 THEN 'answer_line' WHEN len(bold) > 0 THEN 'bold_option' ELSE 'unknown' END AS source FROM a),
f AS (
  SELECT *, CASE WHEN source IN ('both_match', 'answer_line') THEN line WHEN source = 'bold_option' THEN bold ELSE [] END AS got FROM r)
SELECT l_orderkey, CASE WHEN mixed THEN 'mixed' ELSE 'latin_abcd' END AS scheme, array_to_string(got, ',') AS answers,
  CASE len(got) WHEN 0 THEN 'unknown' WHEN 1 THEN 'single' ELSE 'multiple' END AS mode, source,
  concat_ws(',', CASE WHEN mixed THEN 'option_label_scheme_mixed' END, CASE WHEN wrong THEN 'answer_line_not_letter' END,
    CASE WHEN lost THEN 'answer_label_ambiguous_alphabet' END, CASE WHEN source = 'conflict' THEN 'answer_bold_and_line_conflict' END,
    CASE WHEN source = 'unknown' AND NOT wrong AND NOT lost THEN 'answer_missing' END) AS issues FROM f
"""


# ------------------------------------------------------------------ types and distractors
def question_types(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    options = F.when(F.col("doc_id") % 5 == 0, F.array("lang")).otherwise(F.array().cast("array<string>"))
    media = F.when(F.col("doc_id") % 7 == 0, F.array("source")).otherwise(F.array().cast("array<string>"))
    right = F.sequence(F.lit(1), (F.col("doc_id") % 3).cast("int"))
    right = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<int>")).otherwise(right)
    answer = F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.col("source"))
    kind = Q.question_type(F.col("text"), answer, options, media, right)
    return d.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


TYPES = """
SELECT CASE WHEN doc_id % 3 = 0 THEN 'needs_answer_review' WHEN doc_id % 4 = 0 AND length(text) > 100 THEN 'needs_option_length_review'
  WHEN doc_id % 3 = 2 THEN 'multiple_answer' WHEN doc_id % 7 = 0 THEN 'media_context_quiz' WHEN doc_id % 5 = 0 THEN 'multiple_choice'
  WHEN length(text) > 250 THEN 'long_question' ELSE 'simple_quiz' END AS kind, count(*) AS n FROM documents GROUP BY 1
"""

RULES = [(("green", "steel"), ("red steel", "blue steel", "grey steel", "green iron")), (("brass",), ("copper", " ", "tin", "Brass", "copper", "zinc"))]
FALLBACKS = [(("tin", "copper"), ("lead", "gold")), (("red", "blue"), ("white", "black", "brown", "pink"))]


def attached_distractors(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    found = Q.keyword_distractors(F.col("p_name"), F.col("answer"), RULES, FALLBACKS)
    answer = F.when(F.col("p_partkey") % 9 == 0, F.repeat(F.lit("x"), 101)).when(F.col("p_partkey") % 10 == 0, "").otherwise(F.element_at(F.split("p_name", " "), -1))
    q = p.withColumn("answer", answer).withColumn("found", found)
    q = q.select("p_partkey", F.array().cast("array<string>").alias("options"), F.col("answer").alias("correct_answer"), F.lit("simple_quiz").alias("type"), F.lit(None).cast("int").alias("correct"), "found")
    done = Q.with_distractors(q, F.col("found"))
    return done.select("p_partkey", F.array_join("found", "|").alias("found"), F.size("options").cast("long").alias("n_options"), "type", "distractors_source", "correct")


def _usable(words: str) -> str:
    return f"list_filter({words}, lambda x: trim(x) <> '' AND lower(x) <> lower(trim(answer)))"


ATTACHED = f"""
WITH q AS (
  SELECT p_partkey, lower(p_name) AS name, CASE WHEN p_partkey % 9 = 0 THEN repeat('x', 101) WHEN p_partkey % 10 = 0 THEN '' ELSE string_split(p_name, ' ')[-1] END AS answer FROM part),
f AS (
  SELECT *, CASE WHEN contains(name, 'green') AND contains(name, 'steel') THEN {_usable("['red steel', 'blue steel', 'grey steel', 'green iron']")}[1:3]
    WHEN contains(name, 'brass') THEN {_usable("['copper', 'tin', 'Brass', 'zinc']")}[1:3]
    WHEN contains(name, 'tin') OR contains(name, 'copper') THEN {_usable("['lead', 'gold']")}
    WHEN contains(name, 'red') OR contains(name, 'blue') THEN {_usable("['white', 'black', 'brown', 'pink']")}[1:3] ELSE [] END AS found FROM q)
SELECT p_partkey, array_to_string(found, '|') AS found, CASE WHEN answer <> '' AND length(answer) <= 100 AND len(found) = 3 THEN 4 ELSE 0 END AS n_options,
  CASE WHEN answer = '' THEN 'simple_quiz' WHEN length(answer) > 100 THEN 'needs_option_length_review' WHEN len(found) < 3 THEN 'needs_distractor_review' ELSE 'simple_quiz' END AS type,
  CASE WHEN answer = '' THEN NULL WHEN length(answer) > 100 THEN 'needs_option_length_review' WHEN len(found) < 3 THEN 'needs_contextual_distractors' ELSE 'heuristic_same_document' END AS distractors_source,
  CASE WHEN answer <> '' AND length(answer) <= 100 AND len(found) = 3 THEN 1 END AS correct FROM f
"""


# ------------------------------------------------------------------ markup by block ids
def markup_build(spark, sf_dir):
    """Parts as blocks, orders as marked questions: some ids are unknown, some questions share a block with their context."""
    blocks = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 500).alias("document"), F.col("p_partkey").alias("block_id"), F.col("p_partkey").alias("order"), F.when(F.col("p_size") > 3, F.col("p_name")).otherwise("").alias("text")
    )
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("question_id")).agg(
        F.array_sort(F.collect_set("l_partkey")).alias("option_ids"), F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey")))).alias("correct_ids")
    )
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "question_id").join(lines, "question_id")
    asked = F.greatest(F.element_at("option_ids", 1) - F.col("o_custkey") % 5, F.lit(1))
    asked = F.when(F.col("question_id") % 6 == 0, F.lit(-1) * F.col("o_custkey")).otherwise(asked)
    shared = F.when(F.col("question_id") % 4 == 0, F.array(asked)).when(F.col("question_id") % 4 == 1, F.array(F.col("o_custkey"))).otherwise(F.array().cast("array<long>"))
    m = o.select("question_id", F.array(asked).alias("question_ids"), "option_ids", "correct_ids", shared.alias("context_ids"))
    regions = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("region"), F.array(F.col("n_nationkey").cast("long") + 1).alias("block_ids"), F.array((F.col("n_nationkey").cast("long") % 20) * 8 + 2, F.lit(3).cast("long")).alias("applies_to")
    )
    built = Q.build_from_markup(m, blocks, regions)
    return built.select(
        "question_id", "question", F.array_join("options", "|").alias("options"), F.array_join(F.transform("correct", lambda x: x.cast("string")), ",").alias("correct"),
        "context", F.array_join("flags", ",").alias("flags"),
    )


MARKUP = """
WITH b AS (SELECT p_partkey AS id, floor(p_partkey / 500) AS doc, CASE WHEN p_size > 3 THEN p_name ELSE '' END AS text FROM part),
l AS (SELECT l_orderkey AS q, list_sort(list(DISTINCT l_partkey)) AS opts, coalesce(list(DISTINCT l_partkey) FILTER (l_returnflag = 'R'), []) AS good FROM lineitem GROUP BY 1),
m AS (
  SELECT q, opts, good, o_custkey, CASE WHEN q % 6 = 0 THEN -o_custkey ELSE greatest(opts[1] - o_custkey % 5, 1) END AS asked FROM orders JOIN l ON o_orderkey = q),
c AS (SELECT *, CASE WHEN q % 4 = 0 THEN asked WHEN q % 4 = 1 THEN o_custkey END AS ctx FROM m),
inf AS (
  SELECT c.q, max(b.id) AS id FROM c JOIN b AS cb ON cb.id = c.ctx JOIN b AS ob ON ob.id = (SELECT min(x.id) FROM b x WHERE list_contains(c.opts, x.id))
  JOIN b ON b.id > c.ctx AND b.id < ob.id AND b.doc = ob.doc AND b.text <> '' WHERE c.ctx = c.asked AND ob.id > c.ctx + 1 GROUP BY 1),
reg AS (
  SELECT q, max(n) AS n FROM (SELECT n_nationkey AS n, unnest([(n_nationkey % 20) * 8 + 2, 3]) AS q FROM nation) GROUP BY 1),
t AS (
  SELECT c.*, inf.id AS got, coalesce(qb.text, '') AS question, qb.id IS NULL AS q_lost, cb.text AS own, c.ctx IS NOT NULL AND cb.id IS NULL AS c_lost, rb.text AS rtext, reg.n AS region
  FROM c LEFT JOIN inf USING (q) LEFT JOIN b qb ON qb.id = coalesce(inf.id, c.asked) LEFT JOIN b cb ON cb.id = c.ctx LEFT JOIN reg USING (q) LEFT JOIN b rb ON rb.id = reg.n + 1),
d AS (
  SELECT t.q, string_agg(b.text, '|' ORDER BY b.id) AS options, count(*) AS n FROM (SELECT q, unnest(opts) AS id FROM t) t JOIN b USING (id) GROUP BY 1)
SELECT q AS question_id, question, options,
  CASE WHEN len(good) = 0 THEN '1' ELSE array_to_string(list_filter(list_transform(opts, lambda x, i: CASE WHEN list_contains(good, x) THEN i END), lambda x: x IS NOT NULL), ',') END AS correct,
  CASE WHEN ctext = question THEN '' ELSE ctext END AS context,
  concat_ws(',', CASE WHEN q_lost OR c_lost THEN 'missing_source_blocks: ' || concat_ws(', ', CASE WHEN q_lost THEN CAST(asked AS VARCHAR) END, CASE WHEN c_lost AND NOT (q_lost AND ctx = asked) THEN CAST(ctx AS VARCHAR) END) END,
    CASE WHEN got IS NOT NULL THEN 'context_overlap_autofix' END, CASE WHEN n < 3 THEN 'too_few_options' END, CASE WHEN len(good) = 0 THEN 'answer_missing' END) AS flags
FROM (SELECT *, CASE WHEN coalesce(own, '') <> '' THEN own ELSE coalesce(rtext, '') END AS ctext FROM t JOIN d USING (q))
"""


# ------------------------------------------------------------------ checks
def settings_values(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    settings = F.map_from_arrays(
        F.array(F.lit("context_send_mode"), F.lit("shuffle_options"), F.col("event_type")),
        F.array(F.when(F.col("event_id") % 3 == 0, "once").when(F.col("event_id") % 3 == 1, "never").otherwise("per-question"), F.when(F.col("event_id") % 4 == 0, "1").otherwise("false"), F.lit("x")),
    )
    return e.select("event_id", F.array_join(Q.settings_issues(settings), ",").alias("codes"))


SETTINGS = """
SELECT event_id, concat_ws(',', 'settings_unknown_key:' || event_type, CASE WHEN event_id % 3 = 1 THEN 'settings_context_send_mode_invalid' END,
  CASE WHEN event_id % 4 = 0 THEN 'settings_shuffle_options_invalid' END) AS codes FROM events
"""


def long_option_errors(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", r"[.\n]").alias("options"))
    return Q.long_options(d, ["doc_id"], "options").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").cast("long").alias("longest"), F.min("option_index").cast("long").alias("first"))


LONG = r"""
SELECT doc_id, count(*) AS n, max(k) AS longest, min(i) AS "first" FROM (
  SELECT doc_id, i, length(trim(regexp_replace(replace(o[i], chr(160), ' '), '\s+', ' ', 'g'))) AS k FROM (
    SELECT doc_id, o, unnest(generate_series(1, len(o))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '[.\n]') AS o FROM documents)))
WHERE k > 100 GROUP BY 1
"""


def editor_issue_counts(spark, sf_dir):
    q = questions(spark, sf_dir)
    options = F.when(F.col("o_orderkey") % 5 == 0, F.concat("options", F.array(F.lit(" ")), F.slice("options", 1, 1))).otherwise(F.col("options"))
    found = Q.editor_issues(F.when(F.col("o_orderkey") % 13 == 0, " ").otherwise(F.col("question")), options, F.get("answers", 0), F.repeat(F.lit("e"), (F.col("o_orderkey") % 220).cast("int")))
    return q.select(F.inline(found)).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"), F.sum("option").alias("places"))


EDITOR = """
WITH l AS (
  SELECT l_orderkey AS k, l_partkey AS p, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS i FROM lineitem),
n AS (SELECT o_orderkey AS k, count(i) AS n, min(i) FILTER (f = 'R') AS a FROM orders LEFT JOIN l ON k = o_orderkey GROUP BY 1),
o AS (
  SELECT k, CAST(p AS VARCHAR) AS x, i FROM l UNION ALL SELECT k, ' ', n + 1 FROM n WHERE k % 5 = 0
  UNION ALL SELECT l.k, CAST(p AS VARCHAR), n + 2 FROM l JOIN n USING (k) WHERE l.k % 5 = 0 AND i = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY k, x ORDER BY i) AS nth FROM o),
m AS (SELECT *, n + CASE WHEN k % 5 <> 0 THEN 0 WHEN n = 0 THEN 1 ELSE 2 END AS size FROM n),
found AS (
  SELECT 'empty_question' AS code, 'critical' AS severity, NULL AS option FROM m WHERE k % 13 = 0
  UNION ALL SELECT 'few_options', 'critical', NULL FROM m WHERE size < 3
  UNION ALL SELECT 'missing_correct', 'critical', NULL FROM m WHERE a IS NULL
  UNION ALL SELECT 'empty_option', 'critical', i FROM r WHERE x = ' '
  UNION ALL SELECT 'duplicate_option', 'warning', i FROM r WHERE x <> ' ' AND nth > 1
  UNION ALL SELECT 'explanation_limit', 'warning', NULL FROM m WHERE k % 220 > 200)
SELECT code, severity, count(*) AS n, sum(option) AS places FROM found GROUP BY 1, 2
"""


def normaliser_codes(spark, sf_dir):
    q = questions(spark, sf_dir).withColumns({"explanation": F.repeat(F.lit("e"), (F.col("o_orderkey") % 210).cast("int")), "correct_answer": F.array_join(F.transform("answers", lambda a: F.try_element_at(F.col("options"), a)), "; ")})
    code = rules.first_failure(rules.normaliser_rules())
    return q.groupBy(F.coalesce(code, F.lit("clean")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


NORMALISER = """
WITH l AS (
  SELECT l_orderkey AS k, CAST(l_partkey AS VARCHAR) AS x, l_returnflag AS f FROM lineitem),
g AS (SELECT o_orderkey AS k, list(x) FILTER (x IS NOT NULL) AS o, list(x) FILTER (f = 'R') AS good, list(x) FILTER (f <> 'R') AS bad FROM orders LEFT JOIN l ON k = o_orderkey GROUP BY 1)
SELECT CASE WHEN coalesce(len(o), 0) <> 4 THEN 'missing_required_field' WHEN k % 210 > 200 THEN 'too_long_explanation' WHEN good IS NULL THEN 'correct_not_in_options'
  WHEN len(list_distinct(o)) < 4 THEN 'duplicate_options'
  WHEN len(list_filter(coalesce(bad, []), lambda b: len(list_filter(good, lambda c: contains(b, c) OR contains(c, b))) > 0)) > 0 THEN 'weak_distractors' ELSE 'clean' END AS code, count(*) AS n
FROM g GROUP BY 1
"""


def media_missing(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    refs = p.select("page_id", F.array("url", F.concat(F.col("url"), F.lit(".png"))).alias("media"))
    files = p.where("page_id % 2 = 0").select(F.col("url").alias("path"))
    return Q.missing_media(refs, ["page_id"], "media", files)


MEDIA = """
SELECT page_id, ref FROM (SELECT DISTINCT page_id, unnest([url, url || '.png']) AS ref FROM pages)
WHERE ref NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)
"""


# ------------------------------------------------------------------ items, uploads, exports
def _items(spark, sf_dir):
    kind = F.when(F.col("role") == "system", "context").when(F.col("turn") % 7 == 5, "title").when(F.col("turn") % 7 == 6, "reset_context").otherwise("question")
    media = F.when(F.col("turn") % 3 == 0, F.array(S("turn"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", kind.alias("type"), media.alias("media"))


ITEMS = """
i AS (SELECT conv_id, turn, text, CASE WHEN role = 'system' THEN 'context' WHEN turn % 7 = 5 THEN 'title' WHEN turn % 7 = 6 THEN 'reset_context' ELSE 'question' END AS type,
  CASE WHEN turn % 3 = 0 THEN CAST(turn AS VARCHAR) ELSE '' END AS media FROM conversations)
"""


def clean_items(spark, sf_dir):
    done = Q.clean_and_audit(_items(spark, sf_dir), "conv_id", "turn")
    return done.select("conv_id", "turn", "type", S("item_index").alias("item_index"), S("question_index").alias("question_index"), F.length("section").alias("section_chars"), F.length("preview").alias("preview_chars"))


CLEAN = f"""
WITH {ITEMS}
SELECT conv_id, turn, type, CAST(row_number() OVER w AS VARCHAR) AS item_index,
  CASE WHEN type = 'question' THEN CAST(count(*) FILTER (type = 'question') OVER (w ROWS UNBOUNDED PRECEDING) AS VARCHAR) END AS question_index,
  length(last_value(CASE WHEN type = 'title' THEN text END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING)) AS section_chars,
  CASE WHEN type = 'context' THEN least(160, length(text)) END AS preview_chars
FROM i WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
"""


def _uploads(spark, sf_dir, title_resets):
    rows = Q.upload_rows(_items(spark, sf_dir), "conv_id", "turn", title_resets)
    return rows.select("conv_id", "turn", F.col("index").cast("long").alias("index"), F.length("context").alias("context_chars"), F.array_join("media", ",").alias("media"))


def upload_rows(spark, sf_dir):
    return _uploads(spark, sf_dir, True)


def imported_rows(spark, sf_dir):
    return _uploads(spark, sf_dir, False)


def _uploads_sql(resets: str, media: str) -> str:
    return f"""
WITH {ITEMS},
g AS (SELECT *, count(*) FILTER (type = 'question') OVER w AS index, count(*) FILTER ({resets} OR type = 'context') OVER w AS island FROM i
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
c AS (SELECT conv_id, island, text AS context, media AS shared FROM g WHERE type = 'context')
SELECT g.conv_id, turn, index, length(context) AS context_chars, {media} AS media FROM g LEFT JOIN c USING (conv_id, island) WHERE type = 'question'
"""


def selected_rows(spark, sf_dir):
    """Rows from the second question on, of a few indexes; and the indexes that are skipped."""
    rows = Q.upload_rows(_items(spark, sf_dir), "conv_id", "turn")
    return Q.selected(rows, 2, [1, 2, 3, 5]).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("index").cast("long").alias("last"))


SELECTED = f"""
WITH {ITEMS}, n AS (SELECT conv_id, type, count(*) FILTER (type = 'question') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS index FROM i)
SELECT conv_id, count(*) AS n, max(index) AS "last" FROM n WHERE type = 'question' AND index >= 2 AND index IN (1, 2, 3, 5) GROUP BY 1
"""


def upload_envelope(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.collect_set(F.when(F.col("role") == "user", F.col("turn").cast("int"))).alias("skips"))
    start = (F.col("conv_id") % 5 + 1).cast("int")
    return c.select("conv_id", F.array_join(F.transform(Q.skipped_indexes(start, F.col("n"), F.col("skips")), lambda x: x.cast("string")), ",").alias("skipped"), F.col("n").cast("long").alias("source_count"))


ENVELOPE = """
SELECT conv_id, array_to_string(list_sort(list_distinct(list_concat(generate_series(1, least(conv_id % 5 + 1, n + 1) - 1), coalesce(skips, [])))), ',') AS skipped, n AS source_count
FROM (SELECT conv_id, count(*) AS n, list(DISTINCT turn) FILTER (role = 'user') AS skips FROM conversations GROUP BY 1)
"""


def correct_values(spark, sf_dir):
    q = questions(spark, sf_dir)
    return q.select("o_orderkey", Q.correct_value(F.col("answers"), F.col("mode")).alias("correct"))


CORRECT = """
WITH l AS (SELECT l_orderkey AS k, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS i FROM lineitem),
g AS (SELECT o_orderkey, any_value(o_orderpriority) AS p, list(i ORDER BY i) FILTER (f = 'R') AS a FROM orders LEFT JOIN l ON k = o_orderkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN p = '1-URGENT' THEN CAST(a[1] AS VARCHAR) ELSE '[' || coalesce(array_to_string(a, ','), '') || ']' END AS correct FROM g
"""


def group_export_summary(spark, sf_dir):
    """Questions and flags of each group, and its title; a group is a priority."""
    q = questions(spark, sf_dir).withColumn("explanation", F.lit(""))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    flagged = q.join(o, "o_orderkey").select("o_orderpriority", F.size(rules.quality_flags()).alias("flags"))
    groups = flagged.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("questions"), F.sum("flags").alias("flags"))
    n = groups.select("o_orderpriority").distinct().agg(F.count(F.lit(1)).alias("groups"))
    title = Q.group_title(F.lit(" Quiz 1-URGENT "), F.col("o_orderpriority"), F.col("groups"))
    return groups.join(F.broadcast(n)).select("o_orderpriority", "questions", "flags", title.alias("title"))  # one row


EXPORT = """
WITH l AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS a FROM lineitem GROUP BY 1)
SELECT o_orderpriority, count(*) AS questions,
  sum((coalesce(n, 0) < 3)::INT + (coalesce(a, 0) = 0)::INT + (coalesce(a, 0) > 1)::INT) AS flags,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '1-URGENT' ELSE 'Quiz 1-URGENT · ' || o_orderpriority END AS title
FROM orders LEFT JOIN l ON k = o_orderkey GROUP BY 1
"""


def offline_normalise(spark, sf_dir):
    """Trusted questions are clean, all others go to review; counts by reason."""
    q = questions(spark, sf_dir)
    ok = (F.size("options") == 4) & (F.size("answers") == 1) & (F.size(F.array_distinct("options")) == 4)
    reason = F.when(ok, "clean").when(F.size("answers") == 0, "missing_required_field").otherwise("max_retries_exceeded")
    return q.groupBy(reason.alias("outcome")).agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("options")).alias("options"))


OFFLINE = """
WITH l AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS a, count(DISTINCT l_partkey) AS d FROM lineitem GROUP BY 1)
SELECT CASE WHEN n = 4 AND a = 1 AND d = 4 THEN 'clean' WHEN coalesce(a, 0) = 0 THEN 'missing_required_field' ELSE 'max_retries_exceeded' END AS outcome,
  count(*) AS items, CAST(sum(coalesce(n, 0)) AS BIGINT) AS options FROM orders LEFT JOIN l ON k = o_orderkey GROUP BY 1
"""


def error_reason_counts(spark, sf_dir):
    """Counts by reason as one sorted text, with totals."""
    e = table(spark, sf_dir, "events")
    by = e.groupBy(F.col("event_type").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.concat_ws("=", "reason", S("n"))))
    return by.agg(F.sum("n").alias("items"), F.sum(F.when(F.col("reason") == "error", F.col("n"))).alias("review"), F.array_join(pairs, ",").alias("reasons"))


REASONS = """
SELECT sum(n) AS items, sum(n) FILTER (reason = 'error') AS review, string_agg(reason || '=' || n, ',' ORDER BY reason || '=' || n) AS reasons
FROM (SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1)
"""


def repaired_rows(spark, sf_dir):
    """Missing rows inserted, one id dropped, a value overridden in a range of ids."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = Q.insert_missing(c.where("c_custkey % 10 <> 0"), c.where("c_custkey % 5 = 0"), "c_custkey")
    return Q.overridden(rows, "c_custkey", [7], 20, 40, "c_mktsegment", F.lit("patched"))


REPAIRED = "SELECT c_custkey, CASE WHEN c_custkey BETWEEN 20 AND 40 THEN 'patched' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey <> 7"


def inherited_media(spark, sf_dir):
    rows = _items(spark, sf_dir).select("conv_id", "turn", "media")
    return Q.inherit_media(rows, "conv_id", "turn", 2, 6).select("conv_id", "turn", F.array_join("media", ",").alias("media"))


INHERITED = f"""
WITH {ITEMS}
SELECT conv_id, turn, CASE WHEN media = '' AND turn BETWEEN 2 AND 6
  THEN coalesce(last_value(CASE WHEN media <> '' THEN media END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '') ELSE media END AS media FROM i
"""


def clean_cuts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "opt").when(F.col("event_type") == "error", "empty").otherwise("start")
    return Q.clean_cuts(e, "user_id", "event_id", kind, F.col("event_type") == "purchase", 2)


CUTS = """
WITH k AS (
  SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'opt' WHEN 'error' THEN 'empty' ELSE 'start' END AS kind,
    coalesce(count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM events),
p AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM k WHERE kind <> 'empty')
SELECT user_id, coalesce(min(event_id) FILTER (n = 2), max(event_id) FILTER (n < 2), min(event_id)) AS cut,
  coalesce(min(n) FILTER (n = 2), max(n) FILTER (n < 2), min(n)) AS n_items
FROM p WHERE kind = 'start' AND last = 'opt' GROUP BY 1
"""


def resumed_prelude(spark, sf_dir):
    """Whether rows from the third turn on send their context; the row before the start still counts."""
    rows = ordered.carry_forward(_items(spark, sf_dir), ["conv_id"], ["turn"], F.col("text"), F.col("type") == "context", F.col("type").isin("title", "reset_context"), "context")
    rows = rows.withColumn("sends", F.coalesce(ordered.prelude(rows, ["conv_id"], ["turn"], F.col("context"), "once"), F.lit(False)))
    return rows.where("turn >= 3").select("conv_id", "turn", "sends")


PRELUDE = f"""
WITH {ITEMS},
g AS (SELECT *, count(*) FILTER (type <> 'question') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM i),
c AS (SELECT g.conv_id, g.turn, s.text AS context FROM g LEFT JOIN g s ON s.conv_id = g.conv_id AND s.island = g.island AND s.type = 'context'),
l AS (SELECT *, lag(context) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM c)
SELECT conv_id, turn, context IS NOT NULL AND context IS DISTINCT FROM before AS sends FROM l WHERE turn >= 3
"""


# ------------------------------------------------------------------ runs and accounts
def auto_resume_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "paused").when(F.col("event_type") == "click", "failed").otherwise("completed")
    code = F.when(F.col("event_id") % 3 == 0, "telegram_timeout").when(F.col("event_id") % 3 == 1, "paused_by_user")
    return e.where(Q.needs_auto_resume(F.col("user_id") % 2 == 0, status, code)).select("event_id")


AUTO = """
SELECT event_id FROM events WHERE user_id % 2 = 0 AND event_id % 3 <> 1 AND (event_type = 'view' OR (event_type = 'click' AND event_id % 3 = 0))
"""


def protected_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("uploaded"), F.count_if(F.col("event_type") == "error").alias("skips"), F.count(F.lit(1)).alias("n"), F.max_by("event_type", "event_id").alias("last")
    )
    status = F.when(F.col("last") == "view", "paused").otherwise("created")
    safe = Q.protected(F.col("uploaded"), F.col("skips"), F.lit(0), F.lit(1), F.lit(1), status)
    return e.select("user_id", safe.alias("protected"))


PROTECTED = """
SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'error')) > 0 OR arg_max(event_type, event_id) = 'view' AS protected FROM events GROUP BY 1
"""


def resumable_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    stored = F.when(F.col("doc_id") % 4 == 0, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(F.sha2("text", 256))
    return d.groupBy(Q.same_source(stored, F.col("text")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


SOURCES = "SELECT doc_id % 4 <> 0 AS same, count(*) AS n FROM documents GROUP BY 1"


def undo_plan(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return Q.undo_order(e.select("user_id", "event_id", n.alias("index")), "user_id", "index", 2).select("user_id", "event_id", F.col("undo_place").cast("long").alias("undo_place"))


UNDO = """
WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type = 'purchase')
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS undo_place FROM n WHERE i >= 2
"""


def _accounts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.concat(F.lit("+7700"), F.lpad(S("c_custkey"), 7, "0")).alias("phone"),
        F.concat(F.lit("/data/sessions/"), F.col("c_name"), F.lit(".session")).alias("session"), (F.col("c_acctbal") > 0).alias("enabled"), (F.col("c_custkey") % 2 == 0).alias("authorized"), "c_nationkey",
    )


def account_views(spark, sf_dir):
    return Q.public_accounts(_accounts(spark, sf_dir), F.lit(3))


ACCOUNTS = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS display_name,
  CASE WHEN c_acctbal <= 0 THEN 'disabled' WHEN c_custkey % 2 = 0 THEN 'enabled_authorized' ELSE 'enabled' END AS status, c_name || '.session' AS session_file,
  repeat('*', 8) || right(lpad(CAST(c_custkey AS VARCHAR), 7, '0'), 4) AS phone_masked, c_custkey = 3 AS is_active FROM customer
"""


def accounts_over_limit(spark, sf_dir):
    return Q.over_enabled(_accounts(spark, sf_dir), "c_nationkey")


OVER = "SELECT c_nationkey, count(*) AS n_enabled FROM customer WHERE c_acctbal > 0 GROUP BY 1 HAVING count(*) > 2"


def run_accounts(spark, sf_dir):
    """Runs with the name of their account, where there is one."""
    runs = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("id"))
    return runs.join(_accounts(spark, sf_dir).select("id", F.col("name").alias("account")), "id", "left").select("o_orderkey", "account")


RUN_ACCOUNTS = "SELECT o_orderkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS account FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2"


# ------------------------------------------------------------------ texts
def json_shapes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("k"))
    texts = [
        '[{"question": "a"}]', '{"items": []}', '{"name": "n", "questions": [{"question": "q", "correct": 1, "options": ["a", "b"]}]}',
        '{"name": "n", "quiz_title": "t", "questions": [{"question": "q", "correct": 1, "options": ["a", "b"]}]}', '{"questions": [{"option_block_ids": ["b1"]}]}', "{broken", '{"other": 1}',
    ]
    text = F.get(F.array(*[F.lit(t) for t in texts]), F.col("k").cast("int"))
    return d.groupBy(Q.shape_of(text).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


SHAPES = """
SELECT ['list', 'clean', 'ui_group', 'questions', 'block_markup', 'invalid', 'invalid'][doc_id % 7 + 1] AS shape, count(*) AS n FROM documents GROUP BY 1
"""


def quiz_markdown(spark, sf_dir):
    q = questions(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    one = F.struct("o_orderkey", "question", F.col("options"), F.get("answers", 0).alias("answer"))
    of = q.groupBy("o_custkey").agg(F.sort_array(F.collect_list(one)).alias("q"))
    text = Q.quiz_markdown(S("o_custkey"), F.col("q"))
    return of.select("o_custkey", F.sha2(text, 256).alias("sha"), F.length(text).alias("chars"))


MARKDOWN = """
WITH l AS (SELECT l_orderkey AS k, l_partkey AS p, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS i FROM lineitem),
a AS (SELECT k, min(i) AS a FROM l WHERE f = 'R' GROUP BY 1),
o AS (SELECT l.k, string_agg(i || '. ' || p || CASE WHEN i = a THEN ' ✅' ELSE '' END, chr(10) ORDER BY i) AS o FROM l LEFT JOIN a USING (k) GROUP BY 1),
q AS (SELECT o_custkey, o_orderkey, '### ' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) || '. question ' || o_orderkey || chr(10) || chr(10) || coalesce(o, '') AS t FROM orders LEFT JOIN o ON k = o_orderkey),
m AS (SELECT o_custkey, '# ' || o_custkey || chr(10) || chr(10) || 'Всего вопросов: **' || count(*) || '**' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY o_orderkey) AS t FROM q GROUP BY 1)
SELECT o_custkey, sha256(t) AS sha, length(t) AS chars FROM m
"""


def corrupt_titles(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    title = F.when(k == 0, "").when(k == 1, " Контекст ").when(k == 2, "что?").when(k == 3, F.concat("text", F.lit("?"))).otherwise(F.col("source"))
    return d.groupBy(T.looks_corrupt(title).alias("corrupt")).agg(F.count(F.lit(1)).alias("n"))


CORRUPT = """
SELECT CASE WHEN doc_id % 5 IN (0, 1) THEN true WHEN doc_id % 5 = 3 THEN NOT regexp_matches(lower(text), '[а-яё]')
  ELSE doc_id % 5 = 4 AND (trim(source) = '' OR contains(source, '?')) END AS corrupt, count(*) AS n FROM documents GROUP BY 1
"""


QUERIES = {
    f.__name__: f
    for f in (
        neighbour_numbers, answer_evidence, question_types, attached_distractors, markup_build, settings_values, long_option_errors, editor_issue_counts, normaliser_codes,
        media_missing, clean_items, upload_rows, imported_rows, selected_rows, upload_envelope, correct_values, group_export_summary, offline_normalise, error_reason_counts,
        repaired_rows, inherited_media, clean_cuts, resumed_prelude, auto_resume_runs, protected_runs, resumable_sources, undo_plan, account_views, accounts_over_limit, run_accounts,
        json_shapes, quiz_markdown, corrupt_titles,
    )
}
ORACLES = {
    "neighbour_numbers": NEIGHBOURS, "answer_evidence": EVIDENCE, "question_types": TYPES, "attached_distractors": ATTACHED, "markup_build": MARKUP, "settings_values": SETTINGS,
    "long_option_errors": LONG, "editor_issue_counts": EDITOR, "normaliser_codes": NORMALISER, "media_missing": MEDIA, "clean_items": CLEAN,
    "upload_rows": _uploads_sql("type IN ('title', 'reset_context')", "coalesce(shared, '')"),
    "imported_rows": _uploads_sql("type = 'reset_context'", "CASE WHEN media <> '' THEN media ELSE coalesce(shared, '') END"),
    "selected_rows": SELECTED, "upload_envelope": ENVELOPE, "correct_values": CORRECT, "group_export_summary": EXPORT, "offline_normalise": OFFLINE, "error_reason_counts": REASONS,
    "repaired_rows": REPAIRED, "inherited_media": INHERITED, "clean_cuts": CUTS, "resumed_prelude": PRELUDE, "auto_resume_runs": AUTO, "protected_runs": PROTECTED,
    "resumable_sources": SOURCES, "undo_plan": UNDO, "account_views": ACCOUNTS, "accounts_over_limit": OVER, "run_accounts": RUN_ACCOUNTS, "json_shapes": SHAPES,
    "quiz_markdown": MARKDOWN, "corrupt_titles": CORRUPT,
}


# ------------------------------------------------------------------ blocks of documents
def parsed_blocks(spark, sf_dir):
    """A document for each customer: a date, then each order as a question, its lines as options (labels start again after the fourth) and an answer line."""
    line = F.struct("l_linenumber", "l_partkey")  # lines that agree in both are alike here
    packed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    packed = packed.select("l_orderkey", F.transform("lines", lambda x: x.l_partkey).alias("parts"))
    o = table(spark, sf_dir, "orders").join(packed, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "parts")
    # orders are numbered, not their lines: where the blocks of each start, after the date
    answered, n = F.col("o_orderkey") % 3 == 0, F.size("parts")
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before = F.sum(n + 1 + answered.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    o = o.select(S("o_custkey").alias("document"), "o_orderkey", "parts", (F.row_number().over(by) == 1).cast("int").alias("head"), (F.coalesce(before, F.lit(0)) + 2).alias("start"))
    o = written(o, "orders")
    ends = o.select("document", F.explode(F.array(F.col("start") - F.col("head"), F.col("start") + n + answered.cast("int"))).alias("pos"))
    letter = lambda i: F.char(i % 4 + 65)
    options = F.transform("parts", lambda p, i: F.concat(letter(i), F.lit(") part "), p.cast("string")))
    asked = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Order "), S("o_orderkey"))).otherwise(F.concat(F.lit("Какой номер у "), S("o_orderkey"), F.lit("?")))
    none = F.array().cast("array<string>")
    answer = F.when(answered, F.array(F.concat(F.lit("Ответ: "), letter((F.col("o_orderkey") % n).cast("int"))))).otherwise(none)
    texts = F.concat(F.when(F.col("head") == 1, F.array(F.lit("5 мая"))).otherwise(none), F.array(asked), options, answer)
    bold = (F.col("o_orderkey") % 3 == 1) & F.get("parts", 0).isNotNull()
    rows = o.select("document", "start", "head", bold.alias("bold"), F.posexplode(texts).alias("at", "text"))
    rows = rows.withColumn("at", F.col("at") - F.col("head"))
    blocks = rows.select(
        "document", (F.col("start") + F.col("at")).alias("pos"), F.lit("text").alias("kind"), "text", F.when((F.col("at") == 1) & F.col("bold"), F.col("text")).otherwise("").alias("bold_text"),
        F.lit(0).alias("blank_before"), F.lit(False).alias("is_heading"),
    )
    found = B.questions_of_blocks(blocks, ends=ends)
    return found.select("document", "item", "date", "question", F.array_join("options", "|").alias("options"), F.array_join(F.transform("answers", lambda a: a.cast("string")), ",").alias("answers"), "correct_answer", "type")


PARSED = """
WITH l AS (SELECT l_orderkey AS k, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS i FROM lineitem),
g AS (SELECT k, count(*) AS n, list('part ' || p ORDER BY i) AS o FROM l GROUP BY 1),
a AS (SELECT *, CASE WHEN k % 3 = 0 THEN [CAST(k % n % 4 + 1 AS INT)] WHEN k % 3 = 1 THEN list_filter(list_transform(o, lambda x, i: CASE WHEN contains(o[1], x) OR contains(x, o[1]) THEN i END), lambda i: i = 1) ELSE [] END AS good
  FROM g JOIN orders ON o_orderkey = k)
SELECT CAST(o_custkey AS VARCHAR) AS document, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS item, '5 мая' AS date,
  CASE WHEN k % 4 = 0 THEN 'Order ' || k ELSE 'Какой номер у ' || k || '?' END AS question, array_to_string(o, '|') AS options, array_to_string(good, ',') AS answers,
  coalesce(o[good[1]], '') AS correct_answer, CASE WHEN len(good) = 0 THEN 'needs_answer_review' ELSE 'multiple_choice' END AS type FROM a
"""

QUERIES["parsed_blocks"] = parsed_blocks
ORACLES["parsed_blocks"] = PARSED
