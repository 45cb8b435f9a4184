"""Writers: partitioned exports and rendered texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T


def export_groups(df: DataFrame, path: str, date: str, section: str) -> None:
    """One folder of JSON lines for each (date, section), named by its slug."""
    slug = T.slug(T.group_label(F.col(date), F.col(section)))
    df.withColumn("group_slug", slug).write.mode("overwrite").partitionBy("group_slug").json(path)


def question_markdown(question: Column, options: Column, answers: Column, context: Column) -> Column:
    """A question for reviewers: quoted context, options with the right ones ticked."""
    ticked = F.transform(
        options, lambda o, i: F.concat(F.lit("- "), F.chr(F.lit(65) + i), F.lit(") "), o, F.when(F.array_contains(answers, i + 1), F.lit(" ✅")).otherwise(F.lit("")))
    )
    quoted = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("> "), F.replace(context, F.lit("\n"), F.lit("\n> "))))
    return F.concat_ws("\n", quoted, F.concat(F.lit("**"), question, F.lit("**")), F.array_join(ticked, "\n"))


def marker_text(items: DataFrame, unit: str, order: str) -> DataFrame:
    """(unit, text): items as a marker file; a section where it changes, a context at its first use."""
    w = Window.partitionBy(unit).orderBy(order)
    first = F.row_number().over(Window.partitionBy(unit, "context").orderBy(order)) == 1
    new_section = ~F.lag("section").over(w).eqNullSafe(F.col("section")) & F.col("section").isNotNull()
    options = F.array_join(
        F.transform("options", lambda o, i: F.concat(F.when(F.array_contains("answers", i + 1), F.lit("#A*\n")).otherwise(F.lit("#A\n")), o)), "\n"
    )
    part = F.concat_ws(
        "\n",
        F.when(new_section, F.concat(F.lit("#SECTION: "), "section")),
        F.when(first & F.col("context").isNotNull(), F.concat(F.lit("#CONTEXT\n"), "context", F.lit("\n#END_CONTEXT"))),
        F.concat(F.lit("#Q\n"), "question"),
        options,
        F.when(F.coalesce("explanation", F.lit("")) != "", F.concat(F.lit("#EXPLANATION\n"), "explanation")),
        F.lit("#END_Q"),
    )
    parts = items.select(unit, F.struct(F.col(order), part.alias("part")).alias("p"))
    return parts.groupBy(unit).agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x.part), "\n").alias("text"))


def block_stream_text(blocks: DataFrame, unit: str) -> DataFrame:
    """(unit, text): blocks as a stream of headed texts; images name the block before them."""
    before = F.lag("block_id").over(Window.partitionBy(unit).orderBy("pos"))
    image = F.concat(F.lit("[IMAGE "), "block_id", F.lit(" | after="), F.coalesce(before, F.lit("")), F.lit("]"))
    head = F.concat(F.lit("[BLOCK "), "block_id", F.lit(" | "), "kind", F.lit("]\n"), "text")
    parts = blocks.where("kind <> 'break'").select(unit, F.struct("pos", F.when(F.col("kind") == "image", image).otherwise(head).alias("part")).alias("p"))
    return parts.groupBy(unit).agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x.part), "\n").alias("text"))
