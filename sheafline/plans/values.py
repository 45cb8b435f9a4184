"""Queries on single texts and values: answers in lines, damaged texts, quotes, labels, keys, small numbers and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.functions import values as V
from sheafline.plans.items import table

S = F.lit
COLLAPSED = r"trim(regexp_replace(replace({x}, chr(160), ' '), '\s+', ' ', 'g'))"


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part"), F.col("p_partkey")


def inline_answers(spark, sf_dir):
    """Lines that hold a question and its answer, split at a colon or a dash."""
    p, k = _part(spark, sf_dir)
    line = F.when(k % 4 == 0, F.concat_ws(": ", "p_name", "p_brand")).when(k % 4 == 1, F.concat_ws("  -  ", "p_name", "p_brand")).when(k % 4 == 2, F.concat(S("Контекст "), "p_name", S(": "), "p_brand")).otherwise(F.concat_ws(" — ", "p_name", S("ab")))
    return p.select("p_partkey", T.inline_answer(line).alias("x")).select("p_partkey", "x.question", "x.answer")


INLINE = "SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 AND length(p_name) > 8 THEN p_name END AS question, CASE WHEN p_partkey % 4 < 2 AND length(p_name) > 8 THEN p_brand END AS answer FROM part"


def answer_forms(spark, sf_dir):
    """Whole texts as answers: cleaned of their prefix, made short enough for an option, cut for an explanation."""
    d = table(spark, sf_dir, "documents")
    said = F.concat(F.when(F.col("doc_id") % 3 == 0, "✅ Ответ: ").when(F.col("doc_id") % 3 == 1, "ответ：").otherwise(""), F.col("text"))
    return d.select("doc_id", F.md5(T.clean_answer(said)).alias("clean"), T.compact_answer(said).alias("short"), F.md5(T.explanation(said)).alias("explanation"))


FORMS = rf"""
WITH c AS (SELECT doc_id, {COLLAPSED.format(x="text")} AS t FROM documents), f AS (SELECT *, trim(regexp_split_to_array(t, '[.;]')[1]) AS first FROM c)
SELECT doc_id, md5(t) AS clean, CASE WHEN length(first) BETWEEN 3 AND 100 AND NOT regexp_matches(t, '(?i)^\s*[IVXLCDM]+\.\s+\S+') THEN first WHEN length(t) > 100 THEN rtrim(substr(t, 1, 99)) || '…' ELSE t END AS short,
  md5(CASE WHEN length(t) > 200 THEN rtrim(substr(t, 1, 199)) || '…' ELSE t END) AS explanation FROM f
"""


def quote_states(spark, sf_dir):
    p, k = _part(spark, sf_dir)
    line = F.concat(F.repeat(S("«"), (k % 4).cast("int")), "p_name", F.repeat(S("”"), (k % 3).cast("int")), F.when(k % 5 == 0, "“").otherwise(""))
    return p.select("p_partkey", T.quote_balance(line).alias("balance"))


QUOTES = "SELECT p_partkey, CAST(p_partkey % 4 - p_partkey % 3 + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS balance FROM part"


def label_metadata(spark, sf_dir):
    p, k = _part(spark, sf_dir)
    label = F.substring(S("ABCDАБВГ1"), (k % 9 + 1).cast("int"), S(1))
    return p.select("p_partkey", T.code_point(label).alias("code"), T.script_of(label).alias("script"), T.character_name(label).alias("name"))


LABELS = """
SELECT p_partkey, printf('U+%04X', unicode(substr('ABCDАБВГ1', p_partkey % 9 + 1, 1))) AS code, CASE WHEN p_partkey % 9 < 4 THEN 'latin' WHEN p_partkey % 9 < 8 THEN 'cyrillic' ELSE 'unknown' END AS script,
  CASE WHEN p_partkey % 9 < 4 THEN 'LATIN CAPITAL LETTER ' || substr('ABCD', p_partkey % 9 + 1, 1) WHEN p_partkey % 9 < 8 THEN 'CYRILLIC CAPITAL LETTER ' || ['A', 'BE', 'VE', 'GHE'][p_partkey % 9 - 3] ELSE 'DIGIT ONE' END AS name FROM part
"""


def damaged_texts(spark, sf_dir):
    """All codes of texts that look damaged, on names with planted damage."""
    p, k = _part(spark, sf_dir)
    text = F.concat("p_name", F.when(k % 5 == 1, " �").when(k % 5 == 2, " РџСЂРё").when(k % 5 == 3, " при??вет").when(k % 5 == 4, " � Ð??я").otherwise(" что??"))
    return p.select("p_partkey", F.array_join(T.encoding_issues(text), ",").alias("codes"))


DAMAGED = """
SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'text_contains_replacement_char' WHEN 2 THEN 'text_mojibake_detected' WHEN 3 THEN 'text_encoding_suspect'
  WHEN 4 THEN 'text_contains_replacement_char,text_mojibake_detected' ELSE '' END AS codes FROM part
"""


def whole_keys(spark, sf_dir):
    """Keys of whole texts with invisible characters put in: folded, collapsed, invisible ones gone; names without their image marks."""
    d = table(spark, sf_dir, "documents")
    marked = F.concat(F.lit("​"), F.replace("text", S(" "), S(" ‍﻿ ")))
    image = F.concat(F.lit("[IMAGE 1]"), F.col("source"), F.lit("\t [IMAGE: x y] z"))
    return d.select("doc_id", F.md5(T.key(marked)).alias("key"), F.md5(T.without_zero_width(marked)).alias("plain"), T.without_image_marks(image).alias("source"))


KEYS = rf"""
SELECT doc_id, md5(replace(lower({COLLAPSED.format(x="text")}), 'ß', 'ss')) AS key, md5({COLLAPSED.format(x="text")}) AS plain, source || ' z' AS source FROM documents
"""


def small_values(spark, sf_dir):
    """Middles, shares, neighbours of centuries, media names, dates in names."""
    p, k = _part(spark, sf_dir)
    ref = F.concat(F.when(k % 6 == 0, "/").when(k % 6 == 1, "a/../").when(k % 6 == 2, "C:").when(k % 6 == 3, "a\\").otherwise("m/"), k.cast("string"), F.when(k % 4 == 0, ".PNG").when(k % 4 == 1, ".gif").otherwise(".txt"))
    name = F.concat(S("quiz "), (k % 40).cast("string"), F.when(k % 2 == 0, " мая.docx").otherwise(" июня.docx"))
    return p.select(
        "p_partkey", V.midpoint(F.col("p_size"), k).alias("middle"), V.percent(F.col("p_size"), (k % 60).cast("int")).alias("percent"),
        F.array_join(F.transform(V.century_distractors(F.col("p_size") % 22), lambda x: x.cast("string")), ",").alias("centuries"), V.safe_media(ref).alias("safe"), V.date_token(name).alias("date"),
        F.array_join(F.transform(V.index_line(F.when(k % 4 == 0, "1, 3").when(k % 4 == 1, "2;2").when(k % 4 == 2, "1 9").otherwise("1, x"), S(4)), lambda x: x.cast("string")), ",").alias("indexes"),
    )


VALUES = r"""
SELECT p_partkey, (p_size + p_partkey) / 2 AS middle, CASE WHEN p_partkey % 60 > 0 THEN CAST(greatest(0, least(100, round_even(100.0 * p_size / (p_partkey % 60), 0))) AS INTEGER) ELSE 0 END AS percent,
  array_to_string(list_filter([p_size % 22 - 1, p_size % 22 + 1, p_size % 22 + 2, p_size % 22 - 2], lambda x: x > 0)[1:3], ',') AS centuries, p_partkey % 6 > 3 AND p_partkey % 4 < 2 AS safe,
  CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 40) || ' мая' ELSE '' END AS date, CASE WHEN p_partkey % 4 = 0 THEN '1,3' END AS indexes FROM part
"""


def next_attempts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", V.next_attempt(F.col("ts"), F.floor("value")).alias("next"))


NEXT = "SELECT event_id, ts + to_seconds(CAST(greatest(30, floor(value)) AS BIGINT)) AS next FROM events"

QUERIES = {f.__name__: f for f in (inline_answers, answer_forms, quote_states, label_metadata, damaged_texts, whole_keys, small_values, next_attempts)}
ORACLES = {
    "inline_answers": INLINE, "answer_forms": FORMS, "quote_states": QUOTES, "label_metadata": LABELS, "damaged_texts": DAMAGED, "whole_keys": KEYS, "small_values": VALUES, "next_attempts": NEXT,
}
