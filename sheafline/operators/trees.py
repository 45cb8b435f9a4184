"""JSON trees of any shape as rows: flattened level by level, redacted by their paths, put together again in a canonical form.

A node is a row (tree, path, parent, key, pos, kind, text); path is a string that sorts and joins. Each
level is one pass over the containers of the level above (variant_explode), so work grows with the
nodes and rounds with the depth; nothing is nested in one row until it is put together again.

A tree that is one row to begin with needs none of this for its canonical forms: forms() works them out row by row.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from sheafline.scratch import written

#: Parts of names of fields that are never shown.
SECRET_PARTS = ("access_key", "api_hash", "apihash", "api_key", "apikey", "credential", "password", "phone", "secret", "session", "token")
ROOT = "$"


def kind_of(v: Column) -> Column:
    """object, array or scalar."""
    as_kind = lambda t: F.try_variant_get(v, "$", t).isNotNull()
    return F.when(as_kind("map<string,variant>"), "object").when(as_kind("array<variant>"), "array").otherwise("scalar")


def nodes(trees: DataFrame, tree: str, doc: str) -> DataFrame:
    """(tree, path, parent, key, pos, depth, kind, text, shielded) of every node; text is the JSON of a scalar.

    `shielded` tells nodes at or below an array that stands in an array: no names are looked at there. A null `doc` has no nodes.
    """
    spark = trees.sparkSession
    level = trees.where(F.col(doc).isNotNull()).select(
        F.col(tree).alias("tree"), F.lit(ROOT).alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("pos"),
        F.lit(0).alias("depth"), F.col(doc).alias("v"), F.lit(False).alias("shielded"),
    )
    level = written(level.withColumn("kind", kind_of(F.col("v"))), "level")
    out = None
    while True:
        here = level.select("tree", "path", "parent", "key", "pos", "depth", "kind", F.when(F.col("kind") == "scalar", F.to_json("v")).alias("text"), "shielded")
        out = here if out is None else out.unionByName(here)
        inner = level.where("kind <> 'scalar'").select("tree", F.col("path").alias("above"), "depth", "v", F.col("kind").alias("outer_kind"), "shielded")
        each = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select("pos", "key", F.col("value").alias("child")))
        each = each.withColumn("kind", kind_of(F.col("child")))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.to_json(F.struct(F.col("key").alias("k"))))).otherwise(F.concat(F.lit("["), F.lpad(F.col("pos").cast("string"), 9, "0"), F.lit("]")))
        level = written(
            each.select(
                "tree", F.concat("above", step).alias("path"), F.col("above").alias("parent"), "key", F.col("pos").cast("int").alias("pos"), (F.col("depth") + 1).alias("depth"),
                F.col("child").alias("v"), (F.col("shielded") | ((F.col("outer_kind") == "array") & (F.col("kind") == "array"))).alias("shielded"), "kind",
            ),
            "level",
        )
        if level.isEmpty():
            return out


def secret(key: Column) -> Column:
    """Whether the name of a field tells that its value is not to be shown."""
    return F.coalesce(F.lower(key).rlike("|".join(SECRET_PARTS)), F.lit(False))


def redacted(flat: DataFrame) -> DataFrame:
    """`flat` without fields of secret names and all that is in them, level by level."""
    flat = written(flat, "nodes")
    gone = flat.where(secret(F.col("key")) & ~F.col("shielded")).select("tree", "path")
    every = written(gone, "gone")
    while True:
        gone = written(flat.join(gone.withColumnRenamed("path", "parent"), ["tree", "parent"], "left_semi").select("tree", "path"), "gone")
        if gone.isEmpty():
            break
        every = every.unionByName(gone)
    return flat.join(every, ["tree", "path"], "left_anti")


def canonical(flat: DataFrame) -> DataFrame:
    """(tree, text): JSON without spaces, names in code point order, numbers in their shortest form, other letters as they are."""
    flat = written(flat, "nodes")
    depth = flat.agg(F.max("depth")).first()[0] or 0
    done = written(flat.where(F.col("depth") == depth).select("tree", "path", "parent", "key", "pos", _closed(F.col("text"), F.col("kind")).alias("text")), "texts")
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("key").alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1)
    for d in range(depth - 1, -1, -1):
        member = F.struct(F.coalesce("key", F.lit("")).alias("key"), "pos", F.when(F.col("key").isNotNull(), F.concat(quoted, F.lit(":"), F.col("text"))).otherwise(F.col("text")).alias("text"))
        inside = done.groupBy("tree", F.col("parent").alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(member)), lambda m: m["text"]), ",").alias("inside"))
        here = flat.where(F.col("depth") == d).join(inside, ["tree", "path"], "left")
        done = written(here.select("tree", "path", "parent", "key", "pos", _closed(F.coalesce("text", "inside"), F.col("kind")).alias("text")), "texts")
    return done.select("tree", "text")


def _closed(text: Column, kind: Column) -> Column:
    inside = F.coalesce(text, F.lit(""))
    return F.when(kind == "object", F.concat(F.lit("{"), inside, F.lit("}"))).when(kind == "array", F.concat(F.lit("["), inside, F.lit("]"))).otherwise(inside)


def hashed(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


class _Spelt(str):
    """A number as it is spelt."""


def _forms(x, shielded: bool = False) -> tuple[str, str, int, int]:
    """(whole, shown, nodes, depth) of a value: canonical JSON with and without fields of secret names, as canonical() and redacted() give it."""
    if isinstance(x, dict):
        of = [(k, json.dumps(k, ensure_ascii=False), _forms(v, shielded)) for k, v in sorted(x.items())]
        whole, shown = (f"{k}:{f[0]}" for _, k, f in of), (f"{k}:{f[1]}" for name, k, f in of if shielded or not any(p in name.lower() for p in SECRET_PARTS))
        whole, shown, below = "{" + ",".join(whole) + "}", "{" + ",".join(shown) + "}", [f for _, _, f in of]
    elif isinstance(x, list):
        below = [_forms(v, shielded or isinstance(v, list)) for v in x]
        whole, shown = ("[" + ",".join(f[i] for f in below) + "]" for i in (0, 1))
    else:
        whole = x if isinstance(x, _Spelt) else json.dumps(x, ensure_ascii=False)
        return whole, whole, 1, 0
    return whole, shown, 1 + sum(f[2] for f in below), 1 + max((f[3] for f in below), default=-1)


@lru_cache(4096)
def _secret(name: str) -> bool:
    return any(p in name.lower() for p in SECRET_PARTS)


def _counted(x, shielded: bool = False) -> tuple:
    """(value without secret fields, nodes below, depth below) of an object or array; scalars are not looked at."""
    inside, nodes, depth = isinstance(x, dict), len(x), 0 if x else -1
    out = {} if inside else []
    for k, v in x.items() if inside else enumerate(x):
        if isinstance(v, (dict, list)):
            kept, n, d = _counted(v, shielded or not inside and isinstance(v, list))
            nodes, depth = nodes + n, max(depth, d + 1)
        else:
            kept = v
        if not inside:
            out.append(kept)
        elif shielded or not _secret(k):
            out[k] = kept
    return out, nodes, depth


def _forms_of(text: str) -> tuple[str, str, int, int]:
    """_forms() of a text, by Python's own writer where no number has a point or an exponent."""
    odd: list[str] = []
    x = json.loads(text, parse_float=lambda s: odd.append(s) or 0.0)
    if odd or not isinstance(x, (dict, list)):
        return _forms(json.loads(text, parse_int=_Spelt, parse_float=_Spelt))
    shown, nodes, depth = _counted(x)
    as_text = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode
    return as_text(x), as_text(shown), nodes + 1, depth + 1


@F.pandas_udf(StructType([StructField("whole", StringType()), StructField("shown", StringType()), StructField("nodes", LongType()), StructField("depth", IntegerType())]))
def _all_forms(texts: pd.Series) -> pd.DataFrame:
    rows = [_forms_of(t) for t in texts]
    return pd.DataFrame(rows, columns=["whole", "shown", "nodes", "depth"])


def forms(trees: DataFrame, tree: str, doc: str) -> DataFrame:
    """(tree, whole, shown, nodes, depth) of trees that are one row each: no shuffle, and no more held than a batch of rows. A null `doc` gives no row."""
    found = trees.where(F.col(doc).isNotNull()).select(F.col(tree).alias("tree"), _all_forms(F.to_json(doc)).alias("f"))
    return found.select("tree", "f.*")
