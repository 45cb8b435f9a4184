"""Vector code compression: codebooks learned on distinct integer parts, codes joined back to the vectors.

Every component becomes floor(256 * x); a vector is cut into PARTS equal consecutive parts. Equal parts
of one position are counted once with their weight, so that Lloyd's rounds and the last assignment read
each distinct part once. A round is one pass: tasks assign their parts (numpy) and give sums per entry,
at most PARTS * ENTRIES rows a task, which Spark adds up; the new codebook, PARTS * ENTRIES rows, is the only
thing that the driver holds. The codes of the distinct parts are then joined with the parts of the
vectors, those of hot parts by broadcast, and folded per vector into two 64-bit numbers and a sum.

Defined results: vectors that are null or hold a null or non-finite component are dropped. An empty
vector and one whose length PARTS does not divide get parts of ceil(length / PARTS) components, the last ones shorter or
empty. Vectors of several lengths share the codebooks: a missing component of a shorter one counts as 0
in distances and sums, and entries are as long as the longest part. Rows without an id come last among those
that start the codebooks; rows of one id there are told apart by their integers. Repeated rows are kept
and coded alike. With fewer than ENTRIES vectors the codebooks have as many entries. Integer components
beyond +-2**26 (|x| > 262,144) are held there, so that every error fits 64 bits. Columns named like a
result are replaced, all others pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.llm._joins import told
from sheafline.llm._store import written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Factor of the integers and their bound.
SCALE, MOST = 256, 1 << 26
#: Distances worked out at once in a task.
BLOCK = 1 << 21
#: More labels than this are joined by shuffle, but for hot ones.
BROADCAST_LABELS = 100_000


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component as int; null where the vector is null or has a null or non-finite component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.transform(wide, lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * SCALE))).cast("int"))
    return F.when(fine, held)


def parts_of(ints: Column) -> Column:
    """Array of PARTS (pos, part) structs."""
    width = F.ceil(F.size(ints) / PARTS).cast("int")
    one = lambda p: F.struct(p.alias("pos"), F.slice(ints, p * width + 1, width).alias("part"))
    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), one)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each row, ties to the lower index; all int64."""
    at, far = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    step = max(1, BLOCK // max(1, book.size))
    largest = max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0))
    exact = largest <= 1 << 20 and book.shape[1] <= 1 << 10  # every sum below is an integer under 2**53
    for lo in range(0, len(parts), step):
        some = parts[lo : lo + step]
        if exact:
            a, b = some.astype(np.float64), book.astype(np.float64)
            squares = (a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
        else:
            gaps = some[:, None, :] - book[None, :, :]
            squares = np.einsum("rec,rec->re", gaps, gaps)
        at[lo : lo + step] = squares.argmin(axis=1)
        far[lo : lo + step] = squares.min(axis=1)
    return at, far


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """int64 matrix of a list column, padded with zeros to `width`."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy().astype(np.int64)
    sizes, first = np.diff(ends), ends[0]
    out = np.zeros((len(column), width), np.int64)
    if len(flat):
        row = np.repeat(np.arange(len(column)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - first, sizes)] = flat
    return out


def _assigned(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each position in a batch: (position, rows, their parts, index, distance)."""
    pos = batch.column("pos").to_numpy(zero_copy_only=False)
    parts = _matrix(batch.column("part"), books.shape[2])
    for p in np.unique(pos):
        rows = np.flatnonzero(pos == p)
        yield int(p), rows, parts[rows], *nearest(parts[rows], books[p])


def _sums(books: np.ndarray):
    """Weighted sums of the parts per position and entry; halves of 32 bits, so that no sum passes 64 bits."""

    def run(batches):
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            out = []
            for p, rows, parts, at, _ in _assigned(batch, books):
                for entry in np.unique(at):
                    mine = at == entry
                    weight = n[rows[mine]]
                    total = [sum(int(a) * int(b) for a, b in zip(col, weight)) for col in parts[mine].T] if weight.max() > (1 << 20) else (parts[mine] * weight[:, None]).sum(axis=0).tolist()
                    out += [(p, int(entry), i, str(total[i]), int(weight.sum())) for i in range(len(total))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["pos", "entry", "i", "total", "weight"])

    return run


def _codes(books: np.ndarray):
    def run(batches):
        for batch in batches:
            code, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for _, rows, _, at, d in _assigned(batch, books):
                code[rows], far[rows] = at, d
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("part"), batch.column("n"), pa.array(code), pa.array(far)], names=["pos", "part", "n", "code", "far"])

    return run


def distinct_parts(rows: DataFrame, ints: str = "__ints") -> DataFrame:
    """(pos, part, n): every different part of each position with the number of vectors that have it."""
    return rows.select(F.explode(parts_of(F.col(ints))).alias("p")).groupBy("p.pos", "p.part").agg(F.count(F.lit(1)).alias("n"))


def first_books(rows: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """(position, entry, component) from the `entries` smallest ids, nulls last."""
    width = rows.agg(F.max(F.ceil(F.size("__ints") / PARTS))).first()[0] or 0
    start = rows.orderBy(F.col("__id").asc_nulls_last(), "__ints").limit(entries).select(parts_of(F.col("__ints")).alias("p")).collect()
    books = np.zeros((PARTS, len(start), int(width)), np.int64)
    for e, row in enumerate(start):
        for p, part in row.p:
            books[p, e, : len(part)] = part
    return books


def learned(parts: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after Lloyd's rounds over weighted distinct parts: floor(sum / count), unused entries stay."""
    for _ in range(rounds if books.size else 0):
        found = parts.mapInArrow(_sums(books), "pos long, entry long, i long, total string, weight long")
        found = found.groupBy("pos", "entry", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("weight").alias("weight"))
        books = books.copy()
        for r in found.collect():  # one row a component of the codebooks
            books[r.pos, r.entry, r.i] = int(r.total) // r.weight
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in books.reshape(-1).tolist()).encode()).hexdigest()


def coded(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(`vectors` that are kept, with code, error and label_error; codebooks by position, entry and component)."""
    named = [c for c in ("code", "error", "label_error", "codebooks_sha256") if c in vectors.columns and c not in (vec_id, vector, label)]
    rows = vectors.drop(*named).withColumns({"__ints": integers(F.col(vector)), "__id": F.col(vec_id)})
    rows = written(rows.where("__ints IS NOT NULL").withColumn("__row", F.monotonically_increasing_id()))  # ids are fixed once written
    total = rows.count()
    parts = written(distinct_parts(rows))
    books = learned(parts, first_books(rows))
    codes = written(parts.mapInArrow(_codes(books), "pos int, part array<int>, n long, code long, far long"))
    split = rows.select("__row", F.explode(parts_of(F.col("__ints"))).alias("p")).select("__row", "p.pos", "p.part")
    found = told(split, codes, ["pos", "part"], "n", total * PARTS).select("__row", "pos", "code", "far")
    half = lambda lo: F.sum(F.when(F.col("pos").between(lo, lo + 7), F.expr(f"shiftleft(code, 8 * ({lo + 7} - pos))")).otherwise(0))
    folded = found.groupBy("__row").agg(half(0).alias("hi"), half(8).alias("lo"), F.sum("far").alias("error"))
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    folded = folded.select("__row", F.concat(hexed("hi"), hexed("lo")).alias("code"), "error")
    out = written(rows.drop("__ints", "__id").join(folded, "__row").drop("__row"))
    sums = written(out.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__n")))
    known = out.withColumns({"__null": F.col(label).isNull(), "__key": F.coalesce(F.col(label).cast("string"), F.lit(""))})
    sums = sums.select(F.col("__label").isNull().alias("__null"), F.coalesce(F.col("__label").cast("string"), F.lit("")).alias("__key"), "label_error", "__n")
    if sums.count() <= BROADCAST_LABELS:
        out = known.join(F.broadcast(sums.drop("__n")), ["__null", "__key"])
    else:
        out = told(known, sums, ["__null", "__key"], "__n", total)
    return out.drop("__null", "__key"), books


def op12(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    found, books = coded(vectors)
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assign(name: str, book: str) -> str:
    """SQL: every distinct part with its nearest entry of `book`."""
    return f"""{name} AS MATERIALIZED (
  SELECT pos, part, n, min(struct_pack(far := far, entry := entry)) AS best FROM (
    SELECT d.pos, d.part, d.n, b.entry, list_sum(list_transform(generate_series(1, len(d.part)), lambda i: (d.part[i] - b.part[i]) * (d.part[i] - b.part[i]))) AS far
    FROM d JOIN {book} b ON b.pos = d.pos) GROUP BY pos, part, n)"""


def _update(name: str, assigned: str, book: str) -> str:
    """SQL: `book` with every used entry replaced by the floored mean of its parts."""
    return f"""{name} AS MATERIALIZED (
  WITH s AS (
    SELECT pos, best.entry AS entry, i, sum(n * part[i])::HUGEINT AS s, sum(n)::HUGEINT AS c
    FROM (SELECT *, unnest(generate_series(1, len(part))) AS i FROM {assigned}) GROUP BY ALL),
  m AS (SELECT pos, entry, list(((s - ((s % c) + c) % c) // c)::BIGINT ORDER BY i) AS part FROM s GROUP BY ALL)
  SELECT b.pos, b.entry, coalesce(m.part, b.part) AS part FROM {book} b LEFT JOIN m ON m.pos = b.pos AND m.entry = b.entry)"""


#: For vectors of one length that the number of parts divides.
ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, pos, ints[pos * (len(ints) // {PARTS}) + 1 : (pos + 1) * (len(ints) // {PARTS})] AS part
  FROM (SELECT *, unnest(generate_series(0, {PARTS - 1})) AS pos FROM v)),
d AS MATERIALIZED (SELECT pos, part, count(*) AS n FROM p GROUP BY pos, part),
o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS entry FROM v),
b0 AS MATERIALIZED (SELECT p.pos, o.entry, p.part FROM p JOIN o ON o.vec_id = p.vec_id WHERE o.entry < {ENTRIES}),
{_assign("a0", "b0")}, {_update("b1", "a0", "b0")}, {_assign("a1", "b1")}, {_update("b2", "a1", "b1")}, {_assign("a2", "b2")},
x AS (
  SELECT p.vec_id, any_value(p.label) AS label, string_agg(format('{{:02x}}', a2.best.entry), '' ORDER BY p.pos) AS code, CAST(sum(a2.best.far) AS BIGINT) AS error
  FROM p JOIN a2 ON a2.pos = p.pos AND a2.part = p.part GROUP BY p.vec_id),
h AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM x, h
"""
