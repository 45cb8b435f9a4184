"""Selecting rows in a global order, first failures, texts made different: no window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.operators.merge import upsert
from sheafline.operators.ordered import with_suffix
from sheafline.operators.prefix import SIZE, running
from sheafline.scratch import written

#: Questions in one list, characters of a title with its suffix.
MAX_QUESTIONS, MAX_TITLE = 200, 300


def numbered_in_order(rows: DataFrame, key: str, name: str = "place", size: int = SIZE) -> DataFrame:
    """`rows` with their place, from 1, by a whole-number key that is unique: counts per range of keys, then a prefix over the ranges."""
    return running(rows, [], key, sums={name: F.lit(1)}, size=size)


def limited(rows: DataFrame, key: str, start: int | None, limit: int | None, size: int = SIZE) -> DataFrame:
    """Rows from `start` on, in the order of `key`, up to `limit` of them; a limit is looked at after a row is taken, so 0 gives one row."""
    from_start = rows if start is None else rows.where(F.col(key) >= start)
    if limit is None:
        return from_start
    return numbered_in_order(from_start, key, "__place", size).where(F.col("__place") <= max(limit, 1)).drop("__place")


def until_first(rows: DataFrame, key: str, stops: Column) -> DataFrame:
    """Rows in the order of `key` up to the first that stops, that one included: one aggregate, then a filter that reaches the scan."""
    at = rows.where(stops).agg(F.min(key)).first()[0]
    return rows if at is None else rows.where(F.col(key) <= at)


def merged_in_order(old: DataFrame, new: DataFrame, key: str, name: str = "place", size: int = SIZE) -> DataFrame:
    """Rows of both by key, new ones win, with their place in the order of the key."""
    return numbered_in_order(written(upsert(old, new, key), "merged"), key, name, size)


def list_failures(rows: DataFrame, unit: str, pos: str, text: str, most: int = MAX_QUESTIONS) -> DataFrame:
    """(unit, rows, duplicate, original, code): the first rule that each list breaks; null codes where none does.

    The first row, by `pos`, whose text came before (trimmed, lower case) is told with the row that it repeats; only
    then the length of the list is looked at. `pos` is unique in a unit. Each text gives its first place, and the rows that are no first
    place their smallest, so that a text that all rows share is no group of its own.
    """
    keyed = rows.select(unit, pos, F.lower(F.trim(text)).alias("__key"))
    firsts = keyed.groupBy(unit, "__key").agg(F.min(pos).alias(pos))
    repeats = keyed.join(firsts, [unit, pos], "left_anti").groupBy(unit).agg(F.min(F.struct(pos, "__key")).alias("r"))
    repeats = repeats.select(unit, F.col(f"r.{pos}").alias("duplicate"), F.col("r.__key").alias("__key"))
    of = repeats.join(firsts.withColumnRenamed(pos, "original"), [unit, "__key"], "left").select(unit, "duplicate", "original")
    n = rows.groupBy(unit).agg(F.count(F.lit(1)).alias("rows"))
    code = F.when(F.col("duplicate").isNotNull(), "duplicate_question").when(F.col("rows") > most, "too_many_questions")
    return n.join(of, unit, "left").select(unit, "rows", "duplicate", "original", code.alias("code"))


def made_different(rows: DataFrame, unit: str, pos: str, text: str, key: Column | None = None, most: int = MAX_TITLE) -> DataFrame:
    """`rows` with title: repeats of a key get " (контекст n)", n the how-manieth of their key they are, and so does a text that an
    earlier row was given by that.

    Titles are settled in rounds: a row whose own key equals a title given further up gets a suffix, which may be the
    key of a later row. Each round joins new titles with keys not yet taken; as many rounds as suffixes are nested.
    """
    own = F.lower(F.trim(text)) if key is None else key
    keyed = rows.withColumn("__key", own)
    n = running(written(keyed.select(unit, pos, "__key"), "keys"), [unit, "__key"], pos, sums={"__n": F.lit(1)})
    d = written(keyed.join(n, [unit, pos, "__key"]), "numbered")
    suffixed = with_suffix(F.col(text), F.col("__n"), most)
    told = written(d.where("__n > 1").select(unit, pos, suffixed.alias("title")), "titles")
    new, every = told, told
    while True:
        given = new.groupBy(unit, F.lower(F.trim("title")).alias("__key")).agg(F.min(pos).alias("__from"))
        hit = d.where("__n = 1").join(given, [unit, "__key"]).where(F.col(pos) > F.col("__from"))
        new = written(hit.join(every, [unit, pos], "left_anti").select(unit, pos, suffixed.alias("title")), "titles")
        if new.isEmpty():
            break
        every = written(every.unionByName(new), "titles")
    return d.join(every, [unit, pos], "left").withColumn("title", F.coalesce("title", text)).drop("__key", "__n")
