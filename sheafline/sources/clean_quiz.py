"""Clean quiz files: every rule on the file, its items by their type, their options, answers, modes and media.

A file is parsed once into VARIANT; items are exploded once, and each row's rules are array expressions,
so a file is one pass whatever it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.text import collapse
from sheafline.operators.rules import MAX_OPTIONS, MIN_OPTIONS

#: Types of items, modes of questions, actions on an issue of a file and of a question.
TYPES, MODES = ("title", "context", "reset_context", "question"), ("single", "multiple")
FILE_ACTIONS, QUESTION_ACTIONS = ("edit", "abort"), ("skip_question", "edit", "abort")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _text(v: Column) -> Column:
    """A string value collapsed; null where it is none."""
    return F.when(_is(v, "STRING"), collapse(F.try_variant_get(v, "$", "string")))


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _issue(code: str, where: str, value: Column | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(where).alias("field"), (F.lit(None) if value is None else value).cast("string").alias("value"))


def _when(cond: Column, *found: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.array(*found))


def _each(items: Column, bad, code: str, where: str) -> Column:
    """One issue for each place (from 1) of `items` where `bad` holds."""
    places = F.filter(F.transform(items, lambda x, i: F.when(F.coalesce(bad(x), F.lit(False)), i + 1)), lambda i: i.isNotNull())
    return F.transform(places, lambda i: _issue(code, where, i))


def media_issues(v: Column) -> Column:
    given = v.isNotNull() & ~_is(v, "VOID")
    return F.when(given & _list(v).isNull(), F.array(_issue("invalid_schema", "media"))).when(given, _each(_list(v), lambda m: _text(m).isNull() | (_text(m) == ""), "invalid_schema", "media"))


def question_issues(item: Column) -> Column:
    options, answers, mode = _list(_at(item, "options")), _list(_at(item, "answers")), _text(_at(item, "mode"))
    n = F.coalesce(F.size(options), F.lit(0))
    is_index = lambda a: _is(a, "BIGINT")
    numbers = F.transform(F.filter(answers, is_index), lambda a: F.try_variant_get(a, "$", "long"))
    outside = F.filter(numbers, lambda a: (a < 1) | (a > n))
    said = lambda o: F.when(_is(o, "OBJECT"), F.coalesce(_text(_at(o, "text")), F.lit("")))
    question = F.coalesce(_text(_at(item, "question")), F.lit(""))
    count = F.coalesce(F.size(numbers), F.lit(0))
    return F.flatten(
        F.array_compact(
            F.array(
                _when(question == "", _issue("question_text_empty", "question")),
                _when(options.isNull(), _issue("invalid_schema", "options")),
                _each(options, lambda o: ~_is(o, "OBJECT"), "invalid_schema", "option"),
                _each(options, lambda o: said(o) == "", "option_text_empty", "option"),
                _when(options.isNotNull() & (n < MIN_OPTIONS), _issue("too_few_options", "options", n)),
                _when(n > MAX_OPTIONS, _issue("too_many_options", "options", n)),
                _each(answers, lambda a: ~is_index(a), "invalid_schema", "answers"),
                _when(count == 0, _issue("answer_missing", "answers")),
                F.transform(outside, lambda a: _issue("answer_index_out_of_range", "answers", a)),
                _when(F.size(F.array_distinct(numbers)) < count, _issue("answer_index_duplicate", "answers")),
                _when(mode.isNull() | ~mode.isin(*MODES), _issue("mode_invalid", "mode", mode)),
                _when((mode == "single") & (count > 1), _issue("mode_answer_count_conflict", "mode", mode)),
                media_issues(_at(item, "media")),
            )
        )
    )


def issues(files: DataFrame, file: str = "file", value: str = "value") -> DataFrame:
    """(file, item, question, code, field, value, actions): item and question count from 1, null where an issue is none of theirs.

    A file that is no JSON or no object has one issue; one without a list of items has those of its title and settings alone. Items that are
    no objects or of no known type have one issue; titles and resets have no rules.
    """
    doc = F.try_parse_json(F.coalesce(F.col(value), F.lit("")))
    d = files.select(F.col(file).alias("file"), doc.alias("doc"))
    v = F.col("doc")
    title = _text(_at(v, "title"))
    head = F.flatten(
        F.array_compact(
            F.array(
                _when(title.isNull() | (title == ""), _issue("invalid_schema", "title")),
                _when(~_is(_at(v, "settings"), "OBJECT"), _issue("invalid_schema", "settings")),
                _when(_list(_at(v, "items")).isNull(), _issue("invalid_schema", "items")),
            )
        )
    )
    of_file = F.when(v.isNull(), F.array(_issue("invalid_json", "file"))).when(~_is(v, "OBJECT"), F.array(_issue("invalid_schema", "file"))).otherwise(head)
    whole = d.select("file", F.lit(None).cast("int").alias("item"), F.lit(None).cast("int").alias("question"), F.inline(of_file))
    at = d.select("file", F.posexplode(F.when(_is(v, "OBJECT"), _list(_at(v, "items")))).alias("pos", "it"))
    it = F.col("it")
    kind = F.when(_is(it, "OBJECT"), F.coalesce(F.when(_is(_at(it, "type"), "STRING"), F.try_variant_get(it, "$.type", "string")), F.lit(""))).otherwise(None)
    at = at.withColumn("kind", kind)
    numbered = d.select("file", F.filter(F.transform(_list(_at(v, "items")), lambda x, i: F.when(F.try_variant_get(x, "$.type", "string") == "question", i)), lambda i: i.isNotNull()).alias("asked"))
    found = (
        F.when(F.col("kind").isNull(), F.array(_issue("invalid_schema", "item"))).when(~F.col("kind").isin(*TYPES), F.array(_issue("invalid_schema", "type", F.col("kind"))))
        .when(F.col("kind") == "context", media_issues(_at(it, "media"))).when(F.col("kind") == "question", question_issues(it))
    )
    place = F.when(F.col("kind") == "question", F.array_position("asked", F.col("pos"))).cast("int")
    each = at.join(numbered, "file").select("file", (F.col("pos") + 1).alias("item"), place.alias("question"), F.inline(found))
    out = whole.unionByName(each)
    actions = F.when(F.col("question").isNull(), F.array(*[F.lit(a) for a in FILE_ACTIONS])).otherwise(F.array(*[F.lit(a) for a in QUESTION_ACTIONS]))
    return out.withColumn("actions", actions)


def snapshots(files: DataFrame, file: str = "file", value: str = "value") -> DataFrame:
    """(file, index, question_text, options) of the questions of clean files, numbered from 1; files that are none give no rows.

    Options are the texts of option objects; a question that is no text is an empty one.
    """
    v = F.try_parse_json(F.coalesce(F.col(value), F.lit("")))
    asked = F.filter(_list(_at(v, "items")), lambda x: F.coalesce(F.try_variant_get(x, "$.type", "string") == "question", F.lit(False)) & _is(x, "OBJECT"))
    each = files.select(F.col(file).alias("file"), F.posexplode(asked).alias("pos", "it"))
    text = lambda o, name: F.when(_is(_at(o, name), "STRING"), F.try_variant_get(o, f"$.{name}", "string"))
    options = F.array_compact(F.transform(_list(_at(F.col("it"), "options")), lambda o: text(o, "text")))
    return each.select("file", (F.col("pos") + 1).alias("index"), F.coalesce(text(F.col("it"), "question"), F.lit("")).alias("question_text"), F.coalesce(options, F.array().cast("array<string>")).alias("options"))
