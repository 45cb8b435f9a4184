"""Declarative validation: rules over a row become rows of an issue table in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions import text as T

MIN_OPTIONS, MAX_OPTIONS, MAX_QUESTIONS = 2, 10, 200
#: Options that only fill a gap.
FALLBACK_OPTIONS = (
    "вариант 1", "вариант 2", "вариант 3", "вариант 4", "другое", "нет правильного варианта",
    "option 1", "option 2", "option 3", "option 4", "other", "none of the above",
)


@dataclass(frozen=True)
class Rule:
    """One issue per row where `when` holds; with `each`, one per element of that array."""

    code: str
    when: Column
    severity: str = "error"
    each: Column | None = None


def issue(rule: Rule, index: Column) -> Column:
    actions = F.when(index.isNull(), F.array(F.lit("edit"), F.lit("abort"))).otherwise(
        F.array(*[F.lit(a) for a in (("skip_question", "edit", "abort") if rule.severity == "error" else ("confirm", "skip_question", "edit", "abort"))])
    )
    fields = lambda value: F.struct(F.lit(rule.code).alias("code"), F.lit(rule.severity).alias("severity"), actions.alias("actions"), value.alias("value"))
    if rule.each is not None:
        return F.when(rule.when, F.transform(rule.each, lambda x: fields(x.cast("string"))))
    return F.when(rule.when, F.array(fields(F.lit(None).cast("string"))))


def issues(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str], index: str | None = None) -> DataFrame:
    """(keys, code, severity, actions, value): every rule's issues, without scanning `df` again."""
    at = F.col(index) if index else F.lit(None)
    found = F.flatten(F.array_compact(F.array(*[issue(r, at) for r in rules])))
    return df.select(*keys, F.inline(found))


def first_failure(rules: Sequence[Rule]) -> Column:
    """Code of the first rule that holds, in the order given; null if none does."""
    return F.coalesce(*[F.when(r.when, F.lit(r.code)) for r in rules])


def clean_question_rules(question="question", options="options", answers="answers", mode="mode") -> list[Rule]:
    """All rules on a question with options, one-based answers and a mode."""
    q, o, a, m = (F.col(c) for c in (question, options, answers, mode))
    empty = F.filter(F.transform(o, lambda x, i: F.when(F.length(F.trim(F.coalesce(x, F.lit("")))) == 0, i + 1)), lambda i: i.isNotNull())
    outside = F.filter(a, lambda i: (i < 1) | (i > F.size(o)))
    return [
        Rule("question_text_empty", F.length(F.trim(F.coalesce(q, F.lit("")))) == 0),
        Rule("option_text_empty", F.size(empty) > 0, each=empty),
        Rule("too_few_options", F.size(o) < MIN_OPTIONS),
        Rule("too_many_options", F.size(o) > MAX_OPTIONS),
        Rule("answer_missing", F.size(a) == 0),
        Rule("answer_index_out_of_range", F.size(outside) > 0, each=outside),
        Rule("answer_index_duplicate", F.size(F.array_distinct(a)) < F.size(a)),
        Rule("mode_invalid", ~m.isin("single", "multiple")),
        Rule("mode_answer_count_conflict", (m == "single") & (F.size(a) > 1)),
    ]


def upload_rules(question="question", options="options", answers="answers", explanation="explanation") -> list[Rule]:
    """What an upload row must satisfy, in order of checking."""
    q, o, a, e = (F.col(c) for c in (question, options, answers, explanation))
    return [
        Rule("question_length", ~F.length(q).between(1, T.QUESTION_MAX)),
        Rule("option_count", ~F.size(o).between(MIN_OPTIONS, MAX_OPTIONS)),
        Rule("option_length", F.exists(o, lambda x: ~F.length(x).between(1, T.OPTION_MAX))),
        Rule("options_not_unique", F.size(F.array_distinct(o)) < F.size(o)),
        Rule("explanation_length", F.length(e) > T.EXPLANATION_MAX),
        Rule("answers_invalid", (F.size(a) == 0) | (F.size(F.array_distinct(a)) < F.size(a)) | F.exists(a, lambda i: (i < 1) | (i > F.size(o)))),
    ]


def normaliser_rules(question="question", options="options", answers="answers", answer="correct_answer", explanation="explanation") -> list[Rule]:
    """What a normalised question must satisfy; the first failure decides."""
    q, o, a, c, e = (F.col(x) for x in (question, options, answers, answer, explanation))
    keys = F.transform(o, T.simple_key)
    texts = F.transform(a, lambda i: F.try_element_at(o, i))
    right = F.transform(texts, T.simple_key)
    wrong = F.array_except(keys, right)
    fallback = F.array(*[F.lit(x) for x in FALLBACK_OPTIONS])
    overlap = F.exists(wrong, lambda w: F.exists(right, lambda r: F.contains(w, r) | F.contains(r, w)))
    ellipsis = F.exists(o, lambda x: F.contains(x, F.lit("...")) | F.contains(x, F.lit("…")))
    return [
        Rule("too_long_question", ~F.length(q).between(1, T.QUESTION_MAX)),
        Rule("missing_required_field", F.size(o) != 4),
        Rule("too_long_option", F.exists(o, lambda x: ~F.length(x).between(1, T.OPTION_MAX))),
        Rule("too_long_explanation", F.length(e) > T.EXPLANATION_MAX),
        Rule("correct_not_in_options", (F.size(a) == 0) | (F.size(F.array_distinct(a)) < F.size(a)) | F.exists(a, lambda i: (i < 1) | (i > F.size(o)))),
        Rule("duplicate_options", F.size(F.array_distinct(keys)) < F.size(keys)),
        Rule("correct_not_in_options", c != F.array_join(texts, "; ")),
        Rule("weak_distractors", ellipsis | F.arrays_overlap(wrong, fallback) | overlap),
    ]


def context_warnings(context: str = "context") -> list[Rule]:
    c = F.col(context)
    n = F.length(c)
    return [
        Rule("short_context", (n > 0) & (n < 15), "warning"),
        Rule("context_fragment", n.between(15, 44) & ~c.rlike("[.!?;:]"), "warning"),
    ]


def quality_flags(question="question", options="options", answers="answers", explanation="explanation") -> Column:
    """Flags of an exported question, each once."""
    q, o, a, e = (F.col(x) for x in (question, options, answers, explanation))
    return F.array_compact(
        F.array(
            F.when(F.length(q) > T.QUESTION_MAX, "question_too_long"),
            F.when(F.size(o) < 3, "too_few_options"),
            F.when(F.exists(o, lambda x: F.length(x) > T.OPTION_MAX), "option_too_long"),
            F.when(F.length(e) > T.EXPLANATION_MAX, "explanation_too_long"),
            F.when(F.size(a) == 0, "needs_answer_review"),
            F.when(F.exists(a, lambda i: (i < 1) | (i > F.size(o))), "invalid_correct_index"),
            F.when(F.size(a) > 1, "multiple_correct"),
        )
    )


def settings_issues(settings: Column, allowed: Sequence[str]) -> Column:
    """Unknown keys of a settings map."""
    return F.array_except(F.map_keys(settings), F.array(*[F.lit(k) for k in allowed]))
