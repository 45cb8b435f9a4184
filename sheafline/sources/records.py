"""Readers and writers of small record files: raw items, run states, earlier results, texts with plain line ends."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks that list folders, at most; 10,000 unless set.
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def raw_items(files: DataFrame, file: str, doc: str) -> DataFrame:
    """(file, pos, item): entries of a list, or of `questions` of an object, from 1; an entry that is no object is an empty one. Other files give no rows."""
    v = F.col(doc)
    listed = F.coalesce(F.try_variant_get(v, "$.questions", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    each = files.select(F.col(file).alias("file"), F.posexplode(listed).alias("pos", "item"))
    is_object = F.try_variant_get("item", "$", "map<string,variant>").isNotNull()
    return each.select("file", (F.col("pos") + 1).alias("pos"), F.when(is_object, F.col("item")).otherwise(F.parse_json(F.lit("{}"))).alias("item"))


def invalid_lists(files: DataFrame, file: str, doc: str) -> DataFrame:
    """(file) of files that hold no list of items."""
    v = F.col(doc)
    listed = F.coalesce(F.try_variant_get(v, "$.questions", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    return files.where(listed.isNull()).select(F.col(file).alias("file"))


def run_states(spark: SparkSession, path: str, name: str = "state.json") -> DataFrame:
    """(run, state) of every run folder below a path: the folder's name and its state as VARIANT; files that are no JSON are left out."""
    raw = whole_texts(spark, path, name)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return raw.select(F.element_at(parts, -2).alias("run"), F.try_parse_json("value").alias("state")).where("state IS NOT NULL")


def safe_state(state: Column) -> Column:
    """What may be shown of a state: id, status, counts and the name of its source without folders."""
    get = lambda p, t: F.try_variant_get(state, p, t)
    return F.struct(
        get("$.run_id", "string").alias("run_id"), get("$.status", "string").alias("status"), F.coalesce(F.size(get("$.uploaded", "array<int>")), F.lit(0)).alias("uploaded"),
        F.coalesce(F.size(get("$.skipped", "array<int>")), F.lit(0)).alias("skipped"), get("$.next", "int").alias("next"), F.element_at(F.split(get("$.source", "string"), r"[/\\]"), -1).alias("source"),
    )


def usable_results(files: DataFrame, file: str, value: str, required: dict[str, str]) -> DataFrame:
    """(file, pos, fields) of the entries of `questions` that have every required field (name -> type) and no null in it; all others are dropped, as are broken files."""
    v = F.try_parse_json(F.coalesce(F.col(value), F.lit("")))
    each = files.select(F.col(file).alias("file"), F.posexplode(F.try_variant_get(v, "$.questions", "array<variant>")).alias("pos", "item"))
    d = each.select("file", (F.col("pos") + 1).alias("pos"), *[F.try_variant_get("item", f"$.{n}", t).alias(n) for n, t in required.items()])
    whole = F.lit(True)
    for n, t in required.items():
        whole = whole & F.col(n).isNotNull()
        if t.startswith("array"):
            whole = whole & ~F.exists(n, lambda x: x.isNull())
    return d.where(whole)


def plain_lines(text: Column) -> Column:
    """Line ends of any system as line feeds."""
    return F.regexp_replace(text, "\r\n?", "\n")


def write_texts(rows: DataFrame, path: str, key: str, text: str) -> None:
    """Each text as a UTF-8 file in a folder of its key, line ends plain and one at the end; a key has one text, a null one is empty.

    Tasks write side by side through Arrow's file systems, each file once in its place: there is no commit in which the
    driver moves one folder after the other. A task that runs again writes the same files.
    """

    def write(batches):
        where, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, value in zip(*batch.to_pydict().values(), strict=True):
                folder = f"{root}/{key}={_folder(name)}"
                where.create_dir(folder)
                with where.open_output_stream(f"{folder}/part-00000.txt") as out:
                    out.write(f"{value or ''}\n".encode())
            yield pa.RecordBatch.from_pydict({"files": [batch.num_rows]})

    named = rows.select(F.col(key).cast("string").alias("name"), plain_lines(F.col(text)).alias("value"))
    named.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def _folder(name: str | None) -> str:
    """A key as Spark names its folder."""
    if not name:
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"""["#%'*/:=?\\{\[\]^\x00-\x1f\x7f]""", lambda c: f"%{ord(c.group()):02X}", name)


def whole_texts(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(value) of every file of a name below a path, each whole. A task lists many folders, not one, as it is by default."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(8 * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path, wholetext=True)
    finally:
        spark.conf.set(_LISTING, before)


def message(system: str, parts: Column, schema: str) -> Column:
    """The JSON of a request to a language model: a system message, the parts as user message, the wanted schema."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.struct(F.array(say("system", F.lit(system)), say("user", parts)).alias("messages"), F.lit(schema).alias("schema")))
