"""Reports on questions: quality warnings, reused distractors, parts of a split, totals of a build, rows to undo or skip."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions.text import collapse

# Limits and marks of the quality report.
SHORT, FRAGMENT, SENTENCE_MARKS, CUT_MARKS = 15, 45, "[.!?;:]", r"…|\.\.\."


def zipped(left: DataFrame, right: DataFrame, unit: str, pos: str) -> DataFrame:
    """Rows of both lists by their place; a place that `right` does not have gives nulls, one that `left` does not have is left out."""
    return left.join(right, [unit, pos], "left")


def quality_warnings(rows: DataFrame, keys: list[str], options: str, raw_context: Column, context: Column) -> DataFrame:
    """(keys, code, option): short contexts, fragments of contexts, options that look cut. A raw context that is a text comes before the parsed one."""
    told = F.coalesce(raw_context, context, F.lit(""))
    issue = lambda code, option=F.lit(None).cast("int"): F.struct(F.lit(code).alias("code"), option.cast("int").alias("option"))
    cut = F.coalesce(F.filter(F.transform(options, lambda o, i: F.when(o.rlike(CUT_MARKS), i + 1)), lambda i: i.isNotNull()), F.array().cast("array<int>"))
    found = F.concat(
        F.when(F.length(told).between(1, SHORT - 1), F.array(issue("short_context")))
        .when(F.length(told).between(SHORT, FRAGMENT - 1) & ~told.rlike(SENTENCE_MARKS), F.array(issue("context_fragment"))).otherwise(F.array().cast("array<struct<code:string,option:int>>")),
        F.transform(cut, lambda i: issue("truncated_option", i)),
    )
    return rows.select(*keys, F.inline(found))


def reused_distractors(options: Column, right: Column, raw_options: Column, raw_right: Column, heuristic: Column) -> Column:
    """The wrong options that a heuristic had already made up, in their order; none where the raw question's were no guesses."""
    key = lambda x: F.lower(collapse(x))
    guessed = F.array_except(F.transform(raw_options, key), F.transform(raw_right, key))
    own = F.transform(right, key)
    reused = F.filter(options, lambda o: ~F.array_contains(own, key(o)) & F.array_contains(guessed, key(o)))
    return F.when(heuristic, reused).otherwise(F.array().cast("array<string>"))


def split_report(rows: DataFrame, unit: str, part: str, order: str, context: Column, media: Column) -> DataFrame:
    """(unit, part, questions, context_runs, media_refs): a run is a stretch of one context that is not empty."""
    w = Window.partitionBy(unit, part).orderBy(order)
    told = F.coalesce(context, F.lit(""))
    d = rows.withColumns({"__c": told, "__m": F.coalesce(F.size(media), F.lit(0))})
    starts = (F.col("__c") != "") & (F.coalesce(F.lag("__c").over(w), F.lit("")) != F.col("__c"))
    return d.withColumn("__s", starts).groupBy(unit, part).agg(
        F.count(F.lit(1)).alias("questions"), F.count_if("__s").alias("context_runs"), F.sum("__m").alias("media_refs")
    )


def totals(**tables: DataFrame) -> DataFrame:
    """(name, n): rows of each table, one aggregate a table."""
    each = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, each)


def chunks(total: Column, core: int = 240) -> Column:
    """Windows that so many rows are cut into."""
    return F.ceil(total / core)


def steps_to(net: DataFrame, run: str, index: str, kind: Column, next_index: DataFrame, target: Column) -> DataFrame:
    """(run, action, index): what continuing from `target` undoes (uploaded rows from there on) or skips (rows up to there), one row each.

    `net` has the net event of each row, `next_index` (run, next_index) where each run stands. Undoing goes from the last row down.
    """
    at = next_index.withColumn("__target", target)
    undone = net.where(kind == "uploaded").join(at.where("__target < next_index"), run).where(F.col(index) >= F.col("__target")).select(run, F.lit("undo").alias("action"), F.col(index).cast("long").alias("index"))
    skipped = at.where("__target > next_index").select(run, F.lit("skip").alias("action"), F.explode(F.sequence(F.col("next_index").cast("long"), F.col("__target").cast("long") - 1)).alias("index"))
    return undone.unionByName(skipped)
