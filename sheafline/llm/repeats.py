"""Removal of byte strings that occur more than once, by enhanced suffix arrays of small pieces.

A string of LEAST bytes that starts at two places has the same smallest 200-byte gram at both. Every
text is therefore cut into runs of start positions that share their smallest gram; the piece of a
run holds all strings that start in it. Pieces meet by gram, so equal strings meet. Pieces that are
equal as a whole are known to repeat; where different pieces share a gram, their suffixes are sorted,
the stack scan of the common-prefix lengths gives the interval tree, and intervals of at least LEAST
bytes whose occurrences differ in the byte before them are maximal repeats, all occurrences of which
are marked. Pieces of a gram with very many of them are cut by the place of the gram in a string into
parts; parts that share their core but differ are resolved by digests of their strings instead.

Pieces are told apart by a digest among those of one gram only. Texts are UTF-8 bytes; strings never cross documents; what is judged is the input, so overlaps and
repeats inside one document count. Equal texts are one class: with copies and LEAST bytes or more,
all of its bytes go.

Defined results: null and empty texts have 0 bytes and keep the empty string; shorter texts keep
all; repeated rows are copies of each other; ids may be null or repeat; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm import _arrays as A
from sheafline.llm._store import written
from sheafline.llm.ngram_join import _gathered, _groups

LEAST, GRAM = 400, 200
#: Different pieces of one gram that one suffix array takes.
PIECES = 384
#: Of more, strings that hold the gram at as many neighbouring places are compared together.
PART = 16
_LOW = np.uint64(0xFFFFFFFF)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours, by block-wise running minima from both sides."""
    m = len(v) - w + 1
    padded = np.full(-(-len(v) // w) * w, np.iinfo(v.dtype).max, dtype=v.dtype)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], ahead[w - 1 : w - 1 + m])


def _runs(batches):
    """(key, piece, class, doc_id, starts, length) of (doc_id, class, text)."""
    for batch in batches:
        raw, offsets = A.flat(batch.column("text"))
        for lo, hi in A.chunks(offsets):
            part, ends = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            if len(part) < LEAST:
                continue
            sums = A.prefix_hash(part)
            at = np.arange(len(part) - GRAM + 1)
            gram = A.range_hash(sums, at, at + GRAM)
            least = sliding_min((gram & ~_LOW) | at.astype(np.uint64), LEAST - GRAM + 1)
            where = (least & _LOW).astype(np.int64)
            change = np.zeros(len(part) + 1, dtype=np.int64)
            np.add.at(change, ends[:-1], 1)
            np.add.at(change, np.maximum(ends[:-1], ends[1:] - LEAST + 1), -1)
            start = np.flatnonzero(np.cumsum(change)[: len(where)] > 0)
            if not len(start):
                continue
            pos = where[start]
            first = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (start[1:] != start[:-1] + 1)]))
            last = np.concatenate([first[1:], [len(start)]]) - 1
            s1, stop = start[first], start[last] + LEAST
            key, piece = gram[pos[first]], A.range_hash(sums, s1, stop)
            row = np.searchsorted(ends, s1, "right") - 1
            order = np.lexsort((s1, piece, key, row))
            key, piece, row, s1, stop = key[order], piece[order], row[order], s1[order], stop[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])]))
            bounds = np.concatenate([new, [len(row)]]).astype(np.int32)
            take = pa.array(row[new] + lo)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[new].view(np.int64)),
                    pa.array(piece[new].view(np.int64)),
                    batch.column("class").take(take),
                    batch.column("doc_id").take(take),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array((s1 - ends[row]).astype(np.int32))),
                    pa.array((stop - s1)[new].astype(np.int32)),
                ],
                ["key", "piece", "class", "doc_id", "starts", "length"],
            )


def _cut(batches):
    """(key, piece, pieces, bytes) of (text, keys, pieces, counts, starts, lengths): pieces as bytes."""
    for batch in batches:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for text, keys, pieces, counts, starts, lengths in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            data = text.encode()
            for k, p, m, s, n in zip(keys, pieces, counts, starts, lengths, strict=True):
                for column, value in zip(out, (k, p, m, data[s : s + n]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
            ["key", "piece", "pieces", "bytes"],
        )


def common(a: memoryview, b: memoryview, known: int) -> int:
    """Length of the common prefix, at least `known` bytes of which are equal."""
    lo, hi = known, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def maximal_repeats(pieces: list[bytes], least: int = LEAST) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """(suffixes, repeats): sorted suffixes (piece, start) and maximal repeats (length, from, to).

    A repeat's occurrences are suffixes[from:to], all of them. Its length is at least `least`. The
    byte before the start of a piece is unknown and counts as different from every other.
    """
    suffixes = [(f, s) for f, piece in enumerate(pieces) for s in range(len(piece) - least + 1)]
    suffixes.sort(key=lambda x: pieces[x[0]][x[1] :])
    views = [memoryview(p) for p in pieces]
    heads = [pieces[f][s : s + least] for f, s in suffixes]
    found: list[tuple[int, int, int]] = []
    stack: list[list] = []  # [length, first suffix, byte before, or -1 where it differs]
    for i in range(len(suffixes) + 1):
        length, before = 0, -1
        if 0 < i < len(suffixes) and heads[i] == heads[i - 1]:
            (f, s), (g, t) = suffixes[i - 1], suffixes[i]
            length = common(views[f][s:], views[g][t:], least)
        left = i - 1
        if i:
            f, s = suffixes[i - 1]
            before = pieces[f][s - 1] if s else -1
        while stack and stack[-1][0] > length:
            top = stack.pop()
            top[2] = top[2] if top[2] == before else -1
            if top[2] < 0:
                found.append((top[0], top[1], i))
            left, before = top[1], top[2]
        if stack and stack[-1][0] == length:
            stack[-1][2] = stack[-1][2] if stack[-1][2] == before else -1
        elif length >= least:
            stack.append([length, left, before])
        elif stack:
            stack[-1][2] = stack[-1][2] if stack[-1][2] == before else -1
    return suffixes, found


def spans_of(mark: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return edges[::2].tolist(), edges[1::2].tolist()


def _suffix_arrays(batches):
    """(key, piece, lo, hi): what repeats of each piece, for gathered keys."""
    for table in _gathered(batches, "key"):
        keys = table.column("key").to_numpy()
        ids = table.column("piece").to_pylist()
        data = table.column("bytes")
        out: tuple[list, list, list, list] = ([], [], [], [])
        for lo, hi in _groups(keys):
            pieces = data.slice(lo, hi - lo).to_pylist()
            suffixes, found = maximal_repeats(pieces)
            marks = [np.zeros(len(p) + 1, dtype=np.int32) for p in pieces]
            reach = np.zeros(len(suffixes), dtype=np.int64)
            for length, a, b in sorted(found):
                reach[a:b] = length
            for k in np.flatnonzero(reach).tolist():
                f, s = suffixes[k]
                marks[f][s] += 1
                marks[f][s + reach[k]] -= 1
            for f, mark in enumerate(marks):
                a, b = spans_of(np.cumsum(mark)[:-1] > 0)
                if a:
                    for column, value in zip(out, (int(keys[lo]), ids[lo + f], a, b), strict=True):
                        column.append(value)
        yield _intervals(*out)


def _intervals(keys, pieces, lo, hi) -> pa.RecordBatch:
    ints = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(pieces, pa.int64()), pa.array(lo, ints), pa.array(hi, ints)], ["key", "piece", "lo", "hi"]
    )


def _parts(batches):
    """(key, piece, at, n, core, own): the strings of a piece by the place of its gram in them, PART places at a time.

    Equal strings hold the gram at the same place, so they lie in parts of equal number, and all strings
    of a part hold its core, the bytes common to them.
    """
    for batch in batches:
        rows: list[tuple] = []
        for key, piece, data in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            raw = np.frombuffer(data, dtype=np.uint8)
            sums, at = A.prefix_hash(raw), np.arange(len(raw) - GRAM + 1)
            gram = int(np.flatnonzero(A.range_hash(sums, at, at + GRAM).view(np.int64) == key)[0])
            part = np.arange(max(0, gram - len(raw) + LEAST) // PART, gram // PART + 1)
            first = np.maximum(0, gram - part * PART - PART + 1)
            stop = np.minimum(len(raw), gram - part * PART + LEAST)
            core = A.range_hash(sums, gram - part * PART, gram - part * PART + LEAST - PART + 1)
            core = A.mixed(core + part.astype(np.uint64))
            own = A.range_hash(sums, first, stop)
            rows += zip([key] * len(part), [piece] * len(part), first.tolist(), (stop - first).tolist(), core.view(np.int64).tolist(), own.view(np.int64).tolist(), strict=True)
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "piece", "at", "n", "core", "own"])


def _digests(batches):
    """(core, own, at, one, two): two digests of every string of LEAST bytes in a part."""
    for batch in batches:
        for core, own, data in zip(batch.column("core").to_pylist(), batch.column("own").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            raw = np.frombuffer(data, dtype=np.uint8)
            at = np.arange(len(raw) - LEAST + 1)
            one = A.range_hash(A.prefix_hash(raw), at, at + LEAST)
            two = A.range_hash(A.prefix_hash(raw ^ np.uint8(0x5A)), at, at + LEAST)
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, core)), pa.array(np.full(n, own)), pa.array(at.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                ["core", "own", "at", "one", "two"],
            )


def _by_parts(many: DataFrame) -> DataFrame:
    """(key, piece, lo, hi) for grams with very many different pieces (key, piece, bytes), all written.

    Only parts that share a core but differ are looked at string by string, one of each.
    """
    parts = written(many.mapInArrow(_parts, "key long, piece long, at int, n int, core long, own long"))
    owns = parts.groupBy("core", "own").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("key", "piece", "at", "n")).alias("one"))
    several = owns.groupBy("core").agg(F.count(F.lit(1)).alias("owns")).where("owns > 1").drop("owns")
    mixed = owns.join(several, "core").select("core", "own", "one.*")
    data = many.join(mixed, ["key", "piece"]).select("core", "own", F.substring("bytes", F.col("at") + 1, F.col("n")).alias("bytes"))
    strings = written(data.mapInArrow(_digests, "core long, own long, at int, one long, two long"))
    again = strings.groupBy("one", "two").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    found = strings.join(again, ["one", "two"]).groupBy("core", "own").agg(F.collect_list("at").alias("lo"))
    found = found.withColumn("hi", F.transform("lo", lambda x: x + LEAST))
    copies = owns.where("rows > 1").select("core", "own", F.array(F.lit(0)).alias("lo"), F.array("one.n").alias("hi"))
    placed = parts.join(found.unionByName(copies), ["core", "own"])
    return placed.select("key", "piece", *[F.transform(c, lambda x: x + F.col("at")).alias(c) for c in ("lo", "hi")])


def _kept(batches):
    """(class, n_removed, n_spans, kept_sha256) of (class, text, lo, hi)."""
    for batch in batches:
        rows: tuple[list, list, list] = ([], [], [])
        for text, lo, hi in zip(batch.column("text").to_pylist(), batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), strict=True):
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            change = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(change, np.array(lo, dtype=np.int64), 1)
            np.add.at(change, np.array(hi, dtype=np.int64), -1)
            gone = np.cumsum(change)[:-1] > 0
            rows[0].append(int(gone.sum()))
            rows[1].append(len(spans_of(gone)[0]))
            rows[2].append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("class"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())],
            ["class", "n_removed", "n_spans", "kept_sha256"],
        )


SPAN_SCHEMA = "key long, piece long, lo array<int>, hi array<int>"


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, lo, hi) where strings repeat, and (class, text) of all classes that may have such spans.

    docs: (doc_id, text, class), class a digest of the text.
    """
    classes = docs.groupBy("class").agg(F.min("doc_id").alias("first_id"))
    runs = written(
        docs.select("doc_id", "class", "text").mapInArrow(
            _runs, "key long, piece long, class binary, doc_id long, starts array<int>, length int"
        )
    )
    shared = runs.groupBy("key").agg(F.sum(F.size("starts")).alias("n")).where("n > 1").select("key")
    live = runs.join(shared, "key").join(classes, "class").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    live = written(live.select("key", "piece", "class", "doc_id", "starts", "length"))

    pieces = written(
        live.groupBy("key", "piece").agg(
            F.sum(F.size("starts")).alias("n"),
            F.min(F.struct("class", "doc_id", F.element_at("starts", 1).alias("start"), "length")).alias("at"),
        )
    )
    counts = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1")
    mixed = pieces.join(counts, "key").select("key", "piece", "pieces", "at.*")
    wanted = mixed.groupBy("class").agg(
        *[F.collect_list(c).alias(c) for c in ("key", "piece", "pieces", "start", "length")]
    )
    named = live.groupBy("class").agg(F.min("doc_id").alias("first_id"))
    texts = docs.withColumnRenamed("class", "c").join(
        named.hint("shuffle_hash"), (F.col("c") == F.col("class")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    )
    texts = written(texts.select("class", "text"))
    cut = texts.join(wanted, "class").select("text", "key", "piece", "pieces", "start", "length")
    cut = written(cut.mapInArrow(_cut, "key long, piece long, pieces long, bytes binary"))
    few = cut.where(F.col("pieces") <= PIECES).repartition("key").sortWithinPartitions("key")
    spans = few.select("key", "piece", "bytes").mapInArrow(_suffix_arrays, SPAN_SCHEMA)
    many = cut.where(F.col("pieces") > PIECES)
    if many.head(1):
        spans = spans.unionByName(_by_parts(many.select("key", "piece", "bytes")))
    whole = pieces.where("n > 1").select("key", "piece", F.array(F.lit(0)).alias("lo"), F.array("at.length").alias("hi"))
    spans = spans.unionByName(whole)
    placed = live.join(spans, ["key", "piece"])
    shifted = lambda c: F.flatten(F.transform("starts", lambda s: F.transform(c, lambda x: x + s)))
    placed = placed.select("class", shifted("lo").alias("lo"), shifted("hi").alias("hi"))
    return placed.groupBy("class").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("lo", "hi")]), texts


def without_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = slim.withColumn("class", F.unhex(F.md5("text")))  # equal texts meet by 128 bits
    spans, texts = repeated_spans(slim)
    cleaned = texts.join(spans, "class").select("class", "text", "lo", "hi").mapInArrow(
        _kept, "class binary, n_removed long, n_spans long, kept_sha256 string"
    )
    copies = slim.groupBy("class").agg(F.count(F.lit(1)).alias("copies"))
    known = copies.join(cleaned, "class", "left")
    base = slim.select("doc_id", "class", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    out = base.join(known, "class")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LEAST)
    none = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
    )


def op6(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
