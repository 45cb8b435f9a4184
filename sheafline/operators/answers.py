"""Which options are right: label schemes, answer lines and bold options, resolved in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafline.functions import text as T

# Option labels, prefixes of answer lines, issue codes.
LATIN, CYRILLIC = "ABCD", "АБВГ"
ANSWER_PREFIXES = ("ответ", "правильный ответ")
MIXED, AMBIGUOUS, UNKNOWN = "option_label_scheme_mixed", "answer_label_ambiguous_alphabet", "answer_label_unknown"
NOT_LETTER, MISSING, CONFLICT = "answer_line_not_letter", "answer_missing", "answer_bold_and_line_conflict"


def _among(x: Column, letters: str) -> Column:
    return x.isin(*letters)


def label_script(label: Column) -> Column:
    x = F.upper(F.trim(label))
    return F.when(_among(x, LATIN), "latin").when(_among(x, CYRILLIC), "cyrillic").otherwise("unknown")


def scheme_position(label: Column) -> Column:
    """One-based place of a label in its own alphabet."""
    x = F.upper(F.trim(label))
    return F.when(label_script(label) == "unknown", None).otherwise(F.greatest(F.locate(x, F.lit(LATIN)), F.locate(x, F.lit(CYRILLIC))))


def label_scheme(labels: Column) -> Column:
    """latin_abcd, cyrillic_abvg, mixed or unknown for an array of labels."""
    known = F.array_distinct(F.filter(F.transform(labels, label_script), lambda s: s != "unknown"))
    return F.when(F.size(known) > 1, "mixed").when(F.array_contains(known, "latin"), "latin_abcd").when(F.array_contains(known, "cyrillic"), "cyrillic_abvg").otherwise("unknown")


def answer_payload(line: Column) -> Column:
    """What an answer line says after its prefix; null if it is empty or has another prefix."""
    s = F.trim(F.regexp_replace(F.trim(line), "^(?:✅|✔️|✔)\\s*", ""))
    cut = F.translate(s, "：", ":")
    at = F.instr(cut, ":")
    prefix = F.lower(T.collapse(F.substring(s, F.lit(1), at - 1)))
    return F.when(s == "", None).when(at == 0, s).when(prefix.isin(*ANSWER_PREFIXES), F.trim(F.substring(s, at + 1, F.length(s))))


def answer_labels(payload: Column) -> Column:
    """The labels of a payload, in order; null if any token is no single supported letter or there is none."""
    tokens = F.filter(F.transform(F.split(payload, r"[,;/\\\s]+"), F.upper), lambda t: t != "")
    return F.when((F.size(tokens) > 0) & F.forall(tokens, lambda t: _among(t, LATIN + CYRILLIC)), tokens)


def exact_position(labels: Column, label: Column) -> Column:
    """Place of the one option with this label; null if none or several have it."""
    same = F.filter(F.transform(labels, lambda x, i: F.when(F.upper(F.trim(x)) == label, i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(same) == 1, F.get(same, 0))


def _once(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def resolve(labels: Column, line: Column, bold: Column) -> Column:
    """struct(answers, mode, source, issues) from labels, an answer line (or null) and the places of bold options.

    Both signals are compared as ordered lists. A mixed scheme alone is a warning; a missing answer is
    told only where nothing else is wrong.
    """
    none, silent = F.array().cast("array<int>"), F.array().cast("array<string>")

    def settled(x: Column) -> Column:
        by_line, by_bold = F.size(x["at"]) > 0, F.size(x["bold"]) > 0
        source = (
            F.when(by_line & by_bold & (x["at"] == x["bold"]), "both_match").when(by_line & by_bold, "conflict")
            .when(by_line, "answer_line").when(by_bold, "bold_option").otherwise("unknown")
        )
        return _once(F.struct(x.alias("x"), source.alias("source")), told)

    def told(y: Column) -> Column:
        x, source = y["x"], y["source"]
        answers = F.when(source.isin("both_match", "answer_line"), x["at"]).when(source == "bold_option", x["bold"]).otherwise(none)
        issues = F.concat(
            F.when(x["scheme"] == "mixed", F.array(F.lit(MIXED))).otherwise(silent), F.array_distinct(x["error"]), F.when(source == "conflict", F.array(F.lit(CONFLICT))).otherwise(silent),
            F.when((source == "unknown") & (F.size(x["error"]) == 0), F.array(F.lit(MISSING))).otherwise(silent),
        )
        mode = F.when(F.size(answers) == 0, "unknown").when(F.size(answers) > 1, "multiple").otherwise("single")
        return F.struct(answers.alias("answers"), mode.alias("mode"), source.alias("source"), issues.alias("issues"))

    def placed(x: Column) -> Column:
        at = F.array_compact(x["found"])
        error = F.when(x["payload"].isNotNull() & x["tokens"].isNull(), F.array(F.lit(NOT_LETTER))).otherwise(
            F.array_repeat(F.when(x["scheme"] == "mixed", AMBIGUOUS).otherwise(F.lit(UNKNOWN)), F.size(x["found"]) - F.size(at))
        )
        right = F.array_distinct(F.filter(F.coalesce(bold, none), lambda i: i > 0))
        return _once(F.struct(F.array_distinct(at).alias("at"), right.alias("bold"), error.alias("error"), x["scheme"].alias("scheme")), settled)

    def read(x: Column) -> Column:
        found = F.coalesce(F.transform(x["tokens"], lambda t: exact_position(labels, t)), none)
        return _once(F.struct(x["scheme"].alias("scheme"), x["payload"].alias("payload"), x["tokens"].alias("tokens"), found.alias("found")), placed)

    parsed = lambda x: _once(F.struct(x["scheme"].alias("scheme"), x["payload"].alias("payload"), answer_labels(x["payload"]).alias("tokens")), read)
    return _once(F.struct(label_scheme(labels).alias("scheme"), answer_payload(line).alias("payload")), parsed)
