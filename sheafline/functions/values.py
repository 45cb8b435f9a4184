"""Functions over answer indexes, ranges, media references and other small values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_hash(**fields: Column) -> Column:
    """sha256 of a JSON object with sorted keys."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())])), 256))


def midpoint(low: Column, high: Column) -> Column:
    return (low + high) / 2


def percent(done: Column, total: Column) -> Column:
    """0 to 100, halves rounded to even."""
    share = F.when(total > 0, F.bround(100.0 * done / total)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0), F.least(F.lit(100), share.cast("int")))


def valid_answers(answers: Column, options: Column) -> Column:
    """Different one-based indexes inside the options, in order."""
    return F.array_distinct(F.filter(answers, lambda a: (a >= 1) & (a <= F.size(options))))


def index_line(line: Column, n_options: Column) -> Column:
    """Indexes of a line of at least two different numbers, all in range; else null."""
    found = F.transform(F.regexp_extract_all(line, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    usable = line.rlike(r"^[\d\s,;]+$") & (F.size(found) >= 2) & (F.size(F.array_distinct(found)) == F.size(found))
    return F.when(usable & F.forall(found, lambda i: (i >= 1) & (i <= n_options)), found)


def answer_texts(options: Column, answers: Column) -> Column:
    return F.transform(answers, lambda i: F.try_element_at(options, i))


def century_distractors(number: Column) -> Column:
    """Three neighbours of a century, all positive."""
    return F.slice(F.filter(F.array(number - 1, number + 1, number + 2, number - 2), lambda x: x > 0), F.lit(1), F.lit(3))


def year_distractors(year: Column) -> Column:
    """Three neighbours of a year, all positive."""
    return F.slice(F.filter(F.array(*[year + d for d in (-1, 1, 5, -5, 10, -10)]), lambda x: x > 0), F.lit(1), F.lit(3))


ROMAN = ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")
TENS = ("", "X", "XX", "XXX")


def roman(number: Column) -> Column:
    """Roman numeral of 1 to 39."""
    digit = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), i.cast("int"))
    return F.concat(digit(TENS, F.floor(number / 10)), digit(ROMAN, number % 10))


MEDIA_SUFFIXES = ("png", "jpg", "jpeg", "webp", "gif")


def safe_media(ref: Column) -> Column:
    """Relative, inside its folder, with an image suffix."""
    return ~ref.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)|\\") & F.lower(ref).rlike(rf"\.({'|'.join(MEDIA_SUFFIXES)})$")


def date_token(name: Column) -> Column:
    return F.regexp_extract(name, r"\d{1,2} мая", 0)


def next_attempt(now: Column, delay_s: Column) -> Column:
    """Not before 30 seconds from now."""
    return now + F.make_dt_interval(secs=F.greatest(F.lit(30), delay_s))
