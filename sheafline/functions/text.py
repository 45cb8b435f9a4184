"""Text normalisers, classifiers and formatters as Column functions.

Keys made by different normalisers are not comparable with each other. Only NFC, case folding and
character names, which Spark has no expression for, run in Arrow functions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Limits, word lists and patterns that define the results.
QUESTION_MAX, OPTION_MAX, EXPLANATION_MAX = 255, 100, 200
QUESTION_STARTS = ("какой", "какая", "какое", "какие", "кто", "где", "когда", "что", "в чем", "почему", "как ", "каким", "какую")
MOJIBAKE = "Рџ|РЅ|Рє|Р°|Рё|Рµ|СЃ|С‚|С‹|СЏ|Ð|Ñ"
LETTER = "A-Za-zА-Яа-яЁёӘәҒғҚқҢңӨөҰұҮүҺһІі"
ZERO_WIDTH = "​‌‍﻿⁠"
WIDE_SPACES = "   "
#: Characters that NFC leaves as they are whatever stands around them, and such that case folding is lower case.
NFC_SAFE = r"\x{0}-\x{2FF}\x{370}-\x{373}\x{388}-\x{482}\x{48A}-\x{58F}\x{1E00}-\x{1EFF}\x{2002}-\x{20CF}\x{2100}-\x{2125}\x{2127}-\x{2129}\x{212C}-\x{2328}\x{232B}-\x{2ADB}\x{3000}-\x{3029}\x{3030}-\x{3098}\x{309B}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7A3}\x{FF00}-\x{FFFD}\x{1F300}-\x{1FAFF}"
FOLD_SAFE = r"\x{0}-\x{B4}\x{B6}-\x{DE}\x{E0}-\x{FF}\x{400}-\x{482}\x{48A}-\x{4FF}\x{2010}-\x{205E}"
DATE_LINE = r"(?iU)^\s*\d{1,2}\s+мая\s*$"
SECTION_LINE = r"(?iU)^\s*(УТРО|ОБЕД|ВЕЧЕР|повтор.*)\s*$"
OPTION_LINE = r"(?iU)^\s*([AАBВCСDД])(?:\)|\.\s+)\s*(.+)$"
ROMAN_LINE = r"(?i)^\s*[IVXLCDM]+\.\s+\S+"
LEADING_PHRASE = r"(?iu)^(Это|В этот день|В указанном периоде|В годы|После)\s+"
ANSWER_PREFIX = r"(?iu)^\s*(?:✔️|✅)?\s*(?:Ответ\s*[:：]\s*)?"
CANONICAL_ANSWERS = (
    ("кишкентай", "Кишкентай"),
    ("декларация о государственном суверенитете казахской сср", "Декларация о государственном суверенитете Казахской ССР"),
    ("сырдарьинская область", "Сырдарьинская область"),
    ("ограничению власти биев и султанов", "ограничение власти биев и султанов"),
    ("противостояние с большевиками", "противостояние большевикам"),
    ("устав о сибирских киргизах", "Устав о сибирских киргизах"),
    ("жиембет-жырау", "Жиембет-жырау"),
    ("централизация производства и распределения", "централизация производства и распределения"),
    ("знания своих семи предков", "знание семи предков"),
    ("объединить силы трех жузов", "объединение сил трех жузов"),
    ("массовый голод", "массовый голод и сокращение населения"),
)


def _or(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def collapse(x: Column) -> Column:
    """NBSP and every run of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)[\s ]+", " "))


def collapse_inline(x: Column) -> Column:
    """As collapse() for spaces and tabs alone; line breaks stay."""
    return F.regexp_replace(F.regexp_replace(F.translate(x, " ", " "), r"[ \t]+", " "), r"^\s+|\s+$", "")


def without_zero_width(x: Column) -> Column:
    return collapse(F.translate(x, ZERO_WIDTH, ""))


@F.pandas_udf(StringType())
def _composed(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def nfc(x: Column) -> Column:
    """The NFC form; only texts with a character that may change, or change one before it, go to Python."""
    open_ = x.rlike(r"[\x{300}-\x{10FFFF}]") & x.rlike(f"[^{NFC_SAFE}]")  # one range is much faster than many
    return F.coalesce(_composed(F.when(open_, x)), x)


@F.pandas_udf(StringType())
def _folded(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else s.casefold())


def casefold(x: Column) -> Column:
    """Case folded; only texts with a character whose lower case is not that go to Python."""
    open_ = x.rlike(r"[\x{80}-\x{10FFFF}]") & x.rlike(f"[^{FOLD_SAFE}]")
    return F.coalesce(_folded(F.when(open_, x)), F.lower(x))


@F.pandas_udf(StringType())
def character_name(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.name(s[0], "") if s else None)


def normalize_lines(x: Column) -> Column:
    """NFC, LF line ends, white space collapsed inside each line, ends trimmed."""
    lf = F.regexp_replace(F.translate(nfc(x), WIDE_SPACES, "   "), "\r\n?", "\n")
    lines = F.transform(F.split(lf, "\n"), lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def content_hash(x: Column) -> Column:
    """sha256 of the NFC text with wide spaces made plain; nothing is collapsed."""
    return F.concat(F.lit("sha256:"), F.sha2(F.translate(nfc(x), WIDE_SPACES, "   "), 256))


def key(x: Column) -> Column:
    return casefold(without_zero_width(x))


def simple_key(x: Column) -> Column:
    """The part of key() that SQL can express: lower case, sharp s resolved."""
    return F.replace(F.lower(collapse(x)), F.lit("ß"), F.lit("ss"))


def encoding_issues(x: Column) -> Column:
    """Codes of what looks damaged in a text."""
    return F.array_compact(
        F.array(
            F.when(F.contains(x, F.lit("�")), F.lit("text_contains_replacement_char")),
            F.when(x.rlike(MOJIBAKE), F.lit("text_mojibake_detected")),
            F.when(x.rlike(rf"[{LETTER}]\?{{2,}}[{LETTER}]"), F.lit("text_encoding_suspect")),
        )
    )


def is_question(x: Column, collapsed: bool = False) -> Column:
    s = x if collapsed else collapse(x)
    start = F.lower(F.substring(s, 1, max(map(len, QUESTION_STARTS))))
    return s.endswith("?") | _or([start.startswith(w) for w in QUESTION_STARTS])


def is_prompt(x: Column, collapsed: bool = False) -> Column:
    """Ends with a colon, is no date, section or option, and says more than eight characters."""
    s = x if collapsed else collapse(x)
    other = _or([s.rlike(p) for p in (DATE_LINE, SECTION_LINE, OPTION_LINE)])
    return s.endswith(":") & ~other & (F.length(F.trim(F.regexp_replace(s, ":+$", ""))) > 8)


def inline_answer(x: Column, collapsed: bool = False) -> Column:
    """struct(question, answer) of a line that holds both, else null: split at ':', ' — ' or ' - '."""
    s = x if collapsed else collapse(x)

    def cut(mark: str) -> Column:
        at = F.instr(s, mark)
        left = F.trim(F.substring(s, F.lit(1), at - 1))
        right = F.trim(F.substring(s, at + len(mark), F.length(s)))
        return F.when((at > 0) & (F.length(left) > 8) & (F.length(right) > 2), F.struct(left.alias("question"), right.alias("answer")))

    colon = F.when(~F.lower(s).startswith("контекст"), cut(":"))
    return F.when(F.length(s) >= 8, F.coalesce(colon, cut(" — "), cut(" - ")))


def option_parts(x: Column, collapsed: bool = False) -> Column:
    """Texts of all options on one line; empty unless the line starts with an option label."""
    mark = r"(?iU)(?<!\w)[AАBВCСDД](?:\)|\.\s+)\s*"
    s = x if collapsed else collapse(x)
    # split() makes its pattern anew for each row, so labels become line breaks first, which no collapsed text has
    cut = F.split(F.regexp_replace(s, mark, "\n"), "\n")
    parts = F.filter(F.transform(cut, lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    return F.when(s.rlike("^" + mark), parts).otherwise(F.array().cast("array<string>"))


def option_label(x: Column) -> Column:
    """Position 1 to 4 of a line that is one option in the Latin or Cyrillic scheme, else null."""
    label = F.upper(F.regexp_extract(x, r"^\s*([A-Da-dА-Га-г])(?:\)|\.\s)", 1))
    at = F.greatest(F.instr(F.lit("ABCD"), label), F.instr(F.lit("АБВГ"), label))
    return F.when((label != "") & (at > 0), at)


def clean_answer(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(collapse(x), ANSWER_PREFIX, ""), "^[✔️✅]+", ""))


def ellipsized(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.rtrim(F.substring(x, 1, most - 1)), F.lit("…"))).otherwise(x)


def explanation(x: Column, most: int = EXPLANATION_MAX) -> Column:
    return ellipsized(clean_answer(x), most)


def compact_answer(x: Column, most: int = OPTION_MAX) -> Column:
    """An answer short enough for an option: a canonical wording, the first sentence, or cut."""
    answer = clean_answer(x)
    low = F.lower(answer)
    canonical = F.coalesce(*[F.when(F.contains(low, F.lit(n)), F.lit(r)) for n, r in CANONICAL_ANSWERS if len(r) <= most])
    rest = F.regexp_replace(answer, LEADING_PHRASE, "")
    first = F.trim(F.get(F.split(rest, "[.;]"), F.lit(0)))
    short = F.when(~rest.rlike(ROMAN_LINE) & F.length(first).between(3, most), first)
    return F.coalesce(canonical, short, ellipsized(rest, most))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(collapse(x)), r"(?U)[^\w]+", "-"), "^-+|-+$", "")


def code_point(x: Column) -> Column:
    """U+XXXX of the first character."""
    return F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(x)), 4, "0"))


def script_of(x: Column) -> Column:
    return (
        F.when(x.rlike(r"^\p{IsLatin}"), "latin").when(x.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("unknown")
    )


def masked(x: Column, shown: int = 4) -> Column:
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(x) - shown, F.lit(0))), F.right(x, F.lit(shown)))


def quote_balance(x: Column) -> Column:
    """Opening less closing quotation marks."""
    n = lambda marks: F.length(x) - F.length(F.translate(x, marks, ""))
    return n("«“") - n("»”")


def looks_corrupt(title: Column) -> Column:
    """Empty, the bare word for context, or with question marks and no Cyrillic letter."""
    s = F.trim(F.coalesce(title, F.lit("")))
    return s.isin("") | (F.lower(s) == "контекст") | (F.contains(s, F.lit("?")) & ~F.lower(s).rlike("[а-яё]"))


def title_tokens(x: Column) -> Column:
    """Different words of five letters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(x), F.lit(rf"[{LETTER}]+"), F.lit(0)), lambda t: F.length(t) >= 5))


def group_label(date: Column, section: Column) -> Column:
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(F.nullif(F.concat_ws(" ", filled(date), filled(section)), F.lit("")), F.lit("Без группы"))


def without_image_marks(x: Column) -> Column:
    return collapse_inline(F.regexp_replace(x, r"\[IMAGE[^\]]*\]", ""))


def json_object(x: Column) -> Column:
    """The text from the first { to the last } as VARIANT, null if it is no JSON."""
    return F.try_parse_json(F.regexp_extract(x, r"(?s)\{.*\}", 0))
