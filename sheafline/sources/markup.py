"""Line-oriented sources as ordinary DataFrames: block streams and marker files.

Both are read as (unit, pos, line) and structured with running sums over the unit's lines, so a
file is one window partition and many files run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.operators.ordered import carry_forward


def lines_of(df: DataFrame, unit: str, text: str = "value") -> DataFrame:
    """(unit, pos, line) of whole texts."""
    return df.select(unit, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("pos", "line"))


def _sum(flag: Column, unit: str) -> Column:
    return F.sum(flag.cast("int")).over(Window.partitionBy(unit).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))


def meta_map(meta: Column) -> Column:
    """The key=value parts of a header as a map."""
    pairs = F.filter(F.transform(F.split(meta, r"\s*\|\s*"), lambda p: F.trim(p)), lambda p: F.contains(p, F.lit("=")))
    return F.map_from_entries(
        F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)), F.trim(F.regexp_replace(p, "^[^=]*=", ""))))
    )


def block_stream(lines: DataFrame, unit: str) -> DataFrame:
    """(unit, order, block_id, kind, meta, text): what `[BLOCK id | kind | k=v]` headers and the lines below say."""
    header = r"^\[(BLOCK|IMAGE)\s+([^|\]\s]+)\s*(?:\|([^\]]*))?\]\s*$"
    rows = lines.withColumn("is_head", F.col("line").rlike(header)).withColumn("block", _sum(F.col("is_head"), unit)).where("block > 0")
    heads = F.max(F.when(F.col("is_head"), F.col("line")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_head"), F.struct("pos", "line")))), lambda x: x.line), "\n")
    found = rows.groupBy(unit, "block").agg(heads.alias("head"), body.alias("body"))
    image = F.col("head").startswith("[IMAGE")
    meta = F.regexp_extract("head", header, 3)
    first = F.trim(F.get(F.split(meta, r"\|"), F.lit(0)))
    kind = F.when(~F.contains(first, F.lit("=")) & (first != ""), first).when(image, "image").otherwise("paragraph")
    return found.select(
        unit, F.col("block").alias("order"), F.regexp_extract("head", header, 2).alias("block_id"), kind.alias("kind"),
        meta_map(meta).alias("meta"), F.when(~image, T.collapse_inline(F.col("body"))).alias("text"),
    )


MARKERS = ("#CONTEXT", "#END_CONTEXT", "#RESET_CONTEXT", "#Q", "#A", "#A*", "#EXPLANATION", "#END_Q")


def marker_items(lines: DataFrame, unit: str) -> DataFrame:
    """(unit, item, type, section, context, question, options, answers, explanation, media) of marker files.

    Items are sections, contexts, resets and questions. A section starts without a context; a
    context replaces the last one; questions carry what holds where they stand.
    """
    s = F.trim("line")
    marker = F.when(s.startswith("#SECTION"), "#SECTION").when(s.isin(*MARKERS), s)
    rows = lines.withColumn("s", s).withColumn("marker", marker)
    starts = F.col("marker").isin("#SECTION", "#CONTEXT", "#RESET_CONTEXT", "#Q")
    # an item begins with a marker, so that what holds within it is told by one order of the file's lines, sorted once
    upto = Window.partitionBy(unit).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    options_so_far = F.sum(F.coalesce(F.col("marker").isin("#A", "#A*"), F.lit(False)).cast("int")).over(upto)
    rows = rows.withColumns({"item": _sum(F.coalesce(starts, F.lit(False)), unit), "part": F.last(F.col("marker"), ignorenulls=True).over(upto), "so_far": options_so_far})
    rows = rows.withColumn("nth", F.col("so_far") - F.last(F.when(starts, F.col("so_far")), ignorenulls=True).over(upto)).where("item > 0 AND s <> ''")
    media = F.regexp_extract("s", r"^!\[[^\]]*\]\(([^)]+)\)$", 1)
    rows = rows.withColumn("media", F.when(media != "", media))
    say = F.col("marker").isNull() & F.col("media").isNull()

    def body(test: Column) -> Column:
        kept = F.sort_array(F.collect_list(F.when(say & test, F.struct("pos", "s"))))
        return F.array_join(F.transform(kept, lambda x: x.s), "\n")

    option = F.when(F.col("part").isin("#A", "#A*") & say, F.struct("nth", "pos", "s"))
    items = rows.groupBy(unit, "item").agg(
        F.min_by("marker", "pos").alias("start"),
        F.min_by("s", "pos").alias("head"),
        body(F.col("part").isin("#SECTION", "#CONTEXT", "#Q")).alias("text"),
        body(F.col("part") == "#EXPLANATION").alias("explanation"),
        F.sort_array(F.collect_list(option)).alias("o"),
        F.sort_array(F.collect_set(F.when(F.col("marker") == "#A*", F.col("nth")))).alias("answers"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("media").isNotNull(), F.struct("pos", "media")))), lambda x: x.media).alias("media"),
    )
    numbers = F.array_sort(F.array_distinct(F.transform("o", lambda x: x.nth)))
    options = F.transform(numbers, lambda n: F.array_join(F.transform(F.filter("o", lambda x: x.nth == n), lambda x: x.s), " "))
    title = F.coalesce(F.nullif(F.trim(F.regexp_replace("head", r"^#SECTION:?", "")), F.lit("")), F.substring_index("text", "\n", 1))
    kind = F.when(F.col("start") == "#SECTION", "title").when(F.col("start") == "#CONTEXT", "context").when(F.col("start") == "#RESET_CONTEXT", "reset_context").otherwise("question")
    items = items.withColumn("type", kind).withColumn("options", options)
    items = carry_forward(items, [unit], ["item"], title, F.col("type") == "title", F.lit(False), "section")
    items = carry_forward(items, [unit], ["item"], F.col("text"), F.col("type") == "context", F.col("type").isin("title", "reset_context"), "context")
    items = carry_forward(items, [unit], ["item"], F.col("media"), F.col("type") == "context", F.col("type").isin("title", "reset_context"), "context_media")
    question = F.when(F.col("type") == "question", F.col("text"))
    return items.select(unit, "item", "type", "section", "context", "context_media", question.alias("question"), "options", "answers", "explanation", "media")


def marker_issues(lines: DataFrame, unit: str) -> DataFrame:
    """(unit, pos, code) of lines that the marker grammar has no place for."""
    s = F.trim("line")
    rows = lines.withColumn("s", s).where("s <> ''")
    opens, closes = F.col("s").isin("#CONTEXT", "#Q"), F.col("s").isin("#END_CONTEXT", "#END_Q")
    rows = rows.withColumn("depth", _sum(opens, unit) - _sum(closes, unit))
    code = (
        F.when(F.col("s").startswith("#SECTION") & ~F.col("s").rlike("^#SECTION(:|$)"), "strict_section_marker_invalid")
        .when(F.col("s").startswith("#") & ~F.col("s").isin(*MARKERS) & ~F.col("s").startswith("#SECTION"), "strict_unknown_marker")
        .when((F.col("depth") <= 0) & ~F.col("s").startswith("#") & ~F.lag("s").over(Window.partitionBy(unit).orderBy("pos")).eqNullSafe("#SECTION"), "strict_text_outside_block")
    )
    return rows.select(unit, "pos", code.alias("code")).where("code IS NOT NULL")


def strict_issues(lines: DataFrame, unit: str) -> DataFrame:
    """(unit, pos, code, severity) of all that the marker grammar has no place for, told at the marker that opens it.

    A block runs from its marker to its end marker, or without one to the next opening marker or the
    end of the file, which is an error. Questions need a text, two options with texts and an answer;
    those of a question without an end are not told.
    """
    s = F.trim("line")
    opens = s.isin("#CONTEXT", "#Q") | s.startswith("#SECTION") | (s == "#RESET_CONTEXT")
    closes = s.isin("#END_CONTEXT", "#END_Q")
    rows = lines.withColumn("s", s).withColumn("opens", opens).withColumn("closes", closes)
    rows = rows.withColumn("item", _sum(F.col("opens"), unit)).where("s <> ''")
    within = Window.partitionBy(unit, "item").orderBy("pos")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.first("s").over(upto)).withColumn("start", F.when(F.col("item") > 0, F.col("start")))
    rows = rows.withColumn("ended", F.coalesce(F.sum(F.col("closes").cast("int")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0)
    rows = rows.withColumn("nth", F.sum(F.col("s").isin("#A", "#A*").cast("int")).over(upto))
    rows = rows.withColumn("part", F.last(F.when(F.col("s").startswith("#"), F.col("s")), ignorenulls=True).over(upto))
    in_block = F.coalesce(F.col("start").isin("#CONTEXT", "#Q") & ~F.col("ended"), F.lit(False))
    marker = F.col("s").startswith("#")
    title = F.col("start").startswith("#SECTION") & (F.trim(F.regexp_replace("start", "^#SECTION:?", "")) == "")
    after_title = F.coalesce(title & (F.lag("s").over(within) == F.col("start")) & ~marker, F.lit(False))
    lone = (
        F.when(F.col("s").startswith("#SECTION") & ~F.col("s").rlike("^#SECTION(:|$)"), "strict_section_marker_invalid")
        .when(marker & ~F.col("s").isin(*MARKERS) & ~F.col("s").startswith("#SECTION") & in_block & (F.col("start") == "#Q"), "strict_unknown_marker_in_question")
        .when(marker & ~F.col("s").isin(*MARKERS) & ~F.col("s").startswith("#SECTION"), "strict_unknown_marker")
        .when(~marker & ~in_block & ~after_title, "strict_text_outside_block")
    )
    single = rows.select(unit, "pos", lone.alias("code"), F.lit("error").alias("severity")).where("code IS NOT NULL")
    say = ~marker & ~F.col("ended")
    blocks = rows.where("item > 0").groupBy(unit, "item", "start").agg(
        F.min("pos").alias("pos"), F.bool_or("closes").alias("closed"), F.max("nth").alias("options"), F.bool_or(F.col("s") == "#A*").alias("answered"),
        F.count_if(say & (F.col("part") == F.col("start"))).alias("said"), F.count_if(~marker).alias("any_text"),
        F.count_distinct(F.when(say & F.col("part").isin("#A", "#A*"), F.col("nth"))).alias("filled"),
    )
    q, c = F.col("start") == "#Q", F.col("start") == "#CONTEXT"
    section = F.col("start").rlike("^#SECTION(:|$)") & (F.trim(F.regexp_replace("start", "^#SECTION:?", "")) == "") & (F.col("any_text") == 0)
    told = lambda when, code, severity="error": F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    whole = q & F.col("closed")
    found = F.array_compact(
        F.array(
            told(section, "strict_section_title_empty"),
            told(c & ~F.col("closed"), "strict_context_missing_end"),
            told(c & F.col("closed") & (F.col("said") == 0), "strict_context_empty", "warning"),
            told(q & ~F.col("closed"), "strict_question_missing_end"),
            told(whole & (F.col("said") == 0), "question_text_empty"),
            told(whole & (F.col("filled") < F.col("options")), "option_text_empty"),
            told(whole & (F.col("options") < 2), "too_few_options"),
            told(whole & ~F.col("answered"), "answer_missing"),
        )
    )
    return single.unionByName(blocks.select(unit, "pos", F.inline(found)))
