"""Operators over ordered items. Every one names the order and the unit that it runs in.

Windows are partitioned by that unit (a quiz, a conversation, a run), never by nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from sheafline.operators.prefix import SIZE, running


def _upto(unit: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carry_forward(df: DataFrame, unit: Sequence[str], order: Sequence[str], value: Column, sets: Column, resets: Column, name: str) -> DataFrame:
    """The last value set, null after a reset: a reset is a struct with a null, which is not null."""
    state = F.when(sets | resets, F.struct(F.when(sets, value).alias("v")))
    return df.withColumn(name, F.last(state, ignorenulls=True).over(_upto(unit, order))["v"])


def changed(df: DataFrame, unit: Sequence[str], order: Sequence[str], key: Column, name: str = "changed") -> DataFrame:
    """Whether the key differs, nulls compared too, from the row before (null before the first)."""
    w = Window.partitionBy(*unit).orderBy(*order)
    return df.withColumn(name, ~F.lag(key).over(w).eqNullSafe(key))


def prelude(df: DataFrame, unit: Sequence[str], order: Sequence[str], key: Column, mode: str) -> Column:
    """Whether a row sends its context: always, or once for each change to a context."""
    if mode == "per-question":
        return F.lit(True)
    w = Window.partitionBy(*unit).orderBy(*order)
    return key.isNotNull() & ~F.lag(key).over(w).eqNullSafe(key)


def numbered(df: DataFrame, unit: Sequence[str], order: Sequence[str], counts: Column, name: str, prefix: str, width: int = 4) -> DataFrame:
    """prefix-0001 for rows that count, the running number for all."""
    n = F.sum(counts.cast("int")).over(_upto(unit, order))
    return df.withColumn(f"{name}_index", n).withColumn(f"{name}_id", F.when(counts, F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))))


def islands(df: DataFrame, unit: Sequence[str], order: Sequence[str], key: Column, name: str = "island") -> DataFrame:
    """Number of the run of equal, non-empty keys that a row is in; a null key is a run of one row."""
    w = Window.partitionBy(*unit).orderBy(*order)
    starts = key.isNull() | F.coalesce(F.lag(key).over(w) != key, F.lit(True))
    return df.withColumn("__starts", starts.cast("int")).withColumn(name, F.sum("__starts").over(_upto(unit, order))).drop("__starts")


def blanks_before(df: DataFrame, unit: Sequence[str], order: Sequence[str], blank: Column, name: str = "blank_before") -> DataFrame:
    """How many blank rows stand right before a row."""
    seen = F.sum((~blank).cast("int")).over(_upto(unit, order))
    run = Window.partitionBy(*unit, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("__run", seen - F.when(blank, 0).otherwise(1)).withColumn("__blank", blank.cast("int"))
    return df.withColumn(name, F.sum("__blank").over(run) - F.col("__blank")).drop("__run", "__blank")


def pack(df: DataFrame, unit: str, order: str, size: str, parts: int) -> DataFrame:
    """Deals ordered blocks of one unit into parts of about equal size, advancing one part at most."""
    schema = df.select(unit, order, size).schema

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        target, placed, part, out = pdf[size].sum() / parts, 0, 0, []
        for n in pdf[size]:
            if part < parts - 1 and placed >= target * (part + 1):
                part += 1
            out.append(part)
            placed += n
        return pdf.assign(part=out)

    return df.select(unit, order, size).groupBy(unit).applyInPandas(fold, schema.add("part", IntegerType()))


def chunk_owner(position: Column, core: int = 240) -> Column:
    """The chunk whose core holds a one-based position."""
    return F.floor((position - 1) / core).cast("int")


def chunks_seeing(position: Column, total: Column, core: int = 240, lookback: int = 100) -> Column:
    """All chunks whose window (core and what comes before it) holds a position."""
    last = F.floor((F.least(position + lookback, total) - 1) / core).cast("int")
    return F.sequence(chunk_owner(position, core), F.greatest(last, chunk_owner(position, core)))


def nth_repeat(unit: Sequence[str], key: Column, order: Sequence[str]) -> Column:
    """1 for the first row with a key, 2 for the next, and so on."""
    return F.row_number().over(Window.partitionBy(*unit, key).orderBy(*order))


def with_suffix(text: Column, n: Column, most: int = 300) -> Column:
    """A numbered suffix; the whole stays within `most` characters."""
    suffix = F.concat(F.lit(" (контекст "), n.cast("string"), F.lit(")"))
    return F.concat(F.rtrim(F.substring(text, F.lit(1), most - F.length(suffix))), suffix)


def disambiguated(text: Column, n: Column, most: int = 300) -> Column:
    """Repeats get a numbered suffix."""
    return F.when(n > 1, with_suffix(text, n, most)).otherwise(text)


def thirds(df: DataFrame, unit: Sequence[str], pos: str, most: int, name: str = "part", size: int = SIZE) -> DataFrame:
    """Three contiguous parts of equal size, the size capped, the rest in the last; by a whole-number position, unique in a unit.

    Rows are numbered per range of positions, so that a unit with most of the rows is no single task.
    """
    n = df.groupBy(*[F.col(u).alias(f"__{u}") for u in unit]).agg(F.count(F.lit(1)).alias("__n"))
    placed = running(df, unit, pos, sums={"__at": F.lit(1)}, size=size)
    same = F.lit(True)
    for u in unit:
        same = same & F.col(u).eqNullSafe(F.col(f"__{u}"))
    each = F.least(F.lit(most), F.ceil(F.col("__n") / 3))
    part = F.least(F.floor((F.col("__at") - 1) / each), F.lit(2)).cast("int")
    return placed.join(n, same).select(*df.columns, part.alias(name))


def nearest(df: DataFrame, unit: Sequence[str], position: str, anchor: Column, ahead: int, back: int, name: str) -> DataFrame:
    """Position of the nearest anchor: the next one within `ahead`, else the last one within `back`."""
    forward = Window.partitionBy(*unit).orderBy(position).rangeBetween(0, ahead)
    behind = Window.partitionBy(*unit).orderBy(position).rangeBetween(-back, -1)
    at = F.when(anchor, F.col(position))
    return df.withColumn(name, F.coalesce(F.min(at).over(forward), F.max(at).over(behind)))
