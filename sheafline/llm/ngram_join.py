"""N-gram Jaccard join by chosen paths.

Every text becomes the set of its word 5-grams. Equal word sequences form a class with one
representative. A class carries 64 min-hash tokens, which stand for its set: two sets share each of
them with a probability equal to their Jaccard similarity. A run starts with all classes in one
node and splits it on sampled tokens, the same for all classes of a node (1.25 tokens on average,
the reciprocal of the threshold): classes with the same value go on together. Nodes that are small
enough are compared by brute force on all tokens; large ones are split again, and what is still
large after the last level is compared in blocks, whole. Runs are repeated until a pair at the
threshold is met with the target probability.

Candidates closer than a lenient estimate form groups, and inside a group all pairs are verified
exactly on the 5-gram sets (in blocks where a group is large): links are exact, and no link between
members of a group is missed, whether or not a run has met that pair.

Words: runs of ASCII letters, ASCII digits and non-ASCII characters, A-Z lower-cased. A text of one
to four words has one gram, all of its words.

Defined results: texts without words (null, empty) link with nothing; repeated rows are a class and
link with each other; exactly one row of a component is kept, that with the smallest id, of equal ids
that with the smallest key; null ids come last, so a row without an id is linked as any other and is
kept only where no row of its component has an id (component_id is null there); other columns pass
through untouched.

Rows are told apart by a key of their own, a digest of id and text, and not by their id; equal word
sequences meet by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.llm import _arrays as A
from sheafline.llm._graph import components, labels
from sheafline.llm._store import written

N, THRESHOLD = 5, 0.8
TOKENS = 64
LEVELS = 3
RECALL = 0.99
#: Rows that one brute-force comparison takes.
LEAF = 1024
BLOCK = 512
#: Agreeing tokens of 64 for a candidate: a pair at 0.8 has fewer in 3 of 100,000 cases.
LENIENT = 39

_DRAW = np.random.default_rng(20240501)
_FACTORS = _DRAW.integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _DRAW.integers(0, 2**63, TOKENS, dtype=np.uint64)


def runs_for(recall: float, threshold: float = THRESHOLD, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold has met, whatever the number of levels."""
    split = 1 / threshold - 1  # probability of a second token
    survives = 1.0
    for _ in range(levels):  # survives a level, then a branch of the rest
        met = threshold * survives
        survives = (1 - split) * met + split * (1 - (1 - met) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - survives))


def _starts(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row


def grams(column: pa.Array, n: int = N) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of rows: (lo, hi, row of each gram sorted, gram, words per row, two digests per row)."""
    for lo, hi, row, words in A.word_hashes(column, A.NOT_WORD):
        count = np.bincount(row, minlength=hi - lo)
        digest = np.zeros((2, hi - lo), dtype=np.uint64)
        if len(row):
            at = np.arange(len(row)) - np.concatenate([[0], np.cumsum(count)[:-1]])[row]
            starts = _starts(row)
            for k, factor in enumerate((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
                placed = A.mixed(words + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(factor))
                digest[k, row[starts]] = A.mixed(np.add.reduceat(placed, starts) + count[row[starts]].astype(np.uint64))
        g_row, g = A.run_hashes(row, words, n)
        if len(g_row) and (g_row[1:] < g_row[:-1]).any():
            order = np.argsort(g_row, kind="stable")
            g_row, g = g_row[order], g[order]
        yield lo, hi, g_row, g, count, digest.view(np.int64)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits of a row: rows share them only if id and text are equal, nulls included."""
    told = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.md5(F.col(c).cast("string"))))
    return F.unhex(F.md5(F.concat(told(doc_id), told(text))))


def _sketch(batches):
    """(doc_id, key, row, words, one, two, tokens) of (doc_id, key, row, text)."""
    for batch in batches:
        for lo, hi, row, g, count, digest in grams(batch.column("text")):
            tokens = np.zeros((hi - lo, TOKENS), dtype=np.uint32)
            if len(row):
                starts = _starts(row)
                for k in range(TOKENS):
                    tokens[row[starts], k] = np.minimum.reduceat(((g * _FACTORS[k] + _ADDED[k]) >> np.uint64(32)).astype(np.uint32), starts)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "key", "row")],
                    pa.array(count.astype(np.int32)),
                    pa.array(digest[0]),
                    pa.array(digest[1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo) * TOKENS + 1, TOKENS, dtype=np.int32)), pa.array(tokens.view(np.int32).ravel())),
                ],
                ["doc_id", "key", "row", "words", "one", "two", "tokens"],
            )


def _gathered(batches, key: str):
    """Rows of a partition sorted by `key`, as tables that hold whole keys."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if kept and kept[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        if len(change):
            yield pa.Table.from_batches([*kept, batch.slice(0, change[-1])])
            kept = [batch.slice(change[-1])]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _groups(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _leaves(batches):
    """Brute force inside nodes: (a, b) joining the classes of each candidate group."""
    for table in _gathered(batches, "node"):
        keys = table.column("node").to_numpy()
        ids = table.column("class").to_numpy()
        tokens = _matrix(table.column("tokens"), TOKENS)
        left, right = [], []
        pend_i, pend_j, n = [], [], 0

        def flush():
            i, j = np.concatenate(pend_i), np.concatenate(pend_j)
            for lo in range(0, len(i), 50_000):
                p, q = i[lo : lo + 50_000], j[lo : lo + 50_000]
                near = (tokens[p] == tokens[q]).sum(1) >= LENIENT
                left.append(p[near])
                right.append(q[near])

        for lo, hi in _groups(keys):
            if hi - lo < 2:
                continue
            i, j = np.triu_indices(hi - lo, 1)
            pend_i.append(i + lo)
            pend_j.append(j + lo)
            n += len(i)
            if n > 200_000:
                flush()
                pend_i, pend_j, n = [], [], 0
        if n:
            flush()
        if left:
            label = labels(len(ids), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["a", "b"])


def _blocks(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Splits keys with more than `block` rows into pairs of blocks, so that each two rows meet."""
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(F.col("class"), F.lit(17)), n.cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    rows = rows.withColumn("__own", own).withColumn("__other", other)
    return rows.withColumn(key, F.xxhash64(key, F.least("__own", "__other"), F.greatest("__own", "__other"))).drop("__own", "__other")


def candidates(classes: DataFrame, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """(a, b): chosen paths over written classes (class, tokens)."""

    def children(node, tokens):
        token = lambda salt: F.pmod(F.xxhash64(node, F.lit(salt)), F.lit(TOKENS)).cast("int")
        go = lambda at: F.xxhash64(node, at, F.get(tokens, at))
        second = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(1000)) < int(1000 * (1 / THRESHOLD - 1))
        return F.array_distinct(F.array_compact(F.array(go(token(1)), F.when(second, go(token(2))))))

    n_runs = runs_for(recall)
    runs = F.explode(F.array(*[F.lit(r).cast("long") for r in range(n_runs)]))
    rows = classes.select("class", "tokens", runs.alias("node"))
    hot = max(leaf + 1, classes.count() * n_runs // 1000)  # nodes of this size: at most 2 ** level thousand
    found = None
    for level in range(1, LEVELS + 1):
        rows = rows.select("class", F.explode(children(F.col("node"), F.col("tokens"))).alias("node"))
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        told = rows.join(F.broadcast(sizes.where(F.col("size") >= hot).withColumnRenamed("size", "__hot")), "node", "left")
        rest = told.where("__hot IS NULL").drop("__hot").join(sizes.where(F.col("size") < hot), "node")
        live = written(rest.unionByName(told.where("__hot IS NOT NULL").withColumnRenamed("__hot", "size")))
        small = live.where(F.col("size") <= leaf)
        large = live.where(F.col("size") > leaf)
        rest = bool(large.head(1))
        if level == LEVELS and rest:
            small = small.unionByName(_blocks(large, "node", "size", leaf // 2))
        with_tokens = small.join(classes, "class").select("node", "class", "tokens")
        pairs = with_tokens.repartition("node").sortWithinPartitions("node").mapInArrow(_leaves, "a long, b long")
        found = pairs if found is None else found.unionByName(pairs)
        if not rest:
            break
        rows = large.join(classes, "class").select("class", "tokens", "node")
    return found


def _sets(batches):
    """(comp, n_comp, class, size, grams sorted and distinct) of (comp, n_comp, class, size, one, two, text)."""
    for batch in batches:
        for lo, hi, row, g, _, digest in grams(batch.column("text")):
            part = batch.slice(lo, hi - lo)
            order = np.lexsort((g, row))
            row, g = row[order], g[order]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (g[1:] != g[:-1])]) if len(g) else np.zeros(0, bool)
            row, g = row[new], g[new]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(g.view(np.int64)))
            out = pa.RecordBatch.from_arrays([part.column("comp"), part.column("n_comp"), part.column("class"), part.column("size"), sets], ["comp", "n_comp", "class", "size", "grams"])
            yield out.filter(pa.array((part.column("one").to_numpy() == digest[0]) & (part.column("two").to_numpy() == digest[1])))


def _verify(threshold: float):
    """Exact links inside groups: per class the rows linked, and the class it hangs on."""
    over = round(threshold * 1000)

    def run(batches):
        for table in _gathered(batches, "group"):
            keys = table.column("group").to_numpy()
            ids, size, single = (table.column(c).to_numpy() for c in ("class", "size", "single"))
            own = table.column("own").to_numpy()
            lists = table.column("grams").combine_chunks()
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            for lo, hi in _groups(keys):
                n = hi - lo
                if n < 2:
                    continue
                length = np.diff(ends[lo : hi + 1]).astype(np.int64)
                row = np.repeat(np.arange(n), length)
                gram, at, count = np.unique(values[ends[lo] : ends[hi]], return_inverse=True, return_counts=True)
                shared = count[at] > 1
                row, at = row[shared], at[shared]
                _, at = np.unique(at, return_inverse=True)
                inter = np.zeros((n, n), dtype=np.float32)
                order = np.argsort(at, kind="stable")
                row, at = row[order], at[order]
                width = max(1, (1 << 22) // n)
                for first in range(0, int(at[-1]) + 1 if len(at) else 0, width):
                    a, b = np.searchsorted(at, [first, first + width])
                    grid = np.zeros((n, min(width, int(at[-1]) + 1 - first)), dtype=np.float32)
                    grid[row[a:b], at[a:b] - first] = 1
                    inter += grid @ grid.T
                union = length[:, None] + length[None, :] - inter
                link = inter * 1000 >= over * union
                np.fill_diagonal(link, False)
                if not single[lo]:  # a pair of one block counts in that block's own group alone
                    blocks = np.unique(own[lo:hi])
                    if len(blocks) > 1:
                        link &= own[lo:hi][:, None] != own[lo:hi][None, :]
                i, j = np.nonzero(np.triu(link))
                label = labels(n, i, j)
                linked = link @ size[lo:hi]
                some = np.flatnonzero(linked > 0)
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo:hi][some]), pa.array(linked[some].astype(np.int64)), pa.array(ids[lo:hi][label[some]]), pa.array(single[lo:hi][some])],
                        ["class", "linked", "root", "single"],
                    )

    return run


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, key, class, n_links, component_id, kept_key, kept) for every row of `docs`, in any order.

    `key` is row_key() of the row and kept_key that of the row that stays of its component. Rows that
    are equal in id and text share a key; `kept` marks one row of a component alone. Rows without
    words are all kept.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("key"))
    numbered = slim.withColumn("row", F.monotonically_increasing_id())  # tells equal rows apart once it is written
    sketch = written(numbered.mapInArrow(_sketch, "doc_id long, key binary, row long, words int, one long, two long, tokens array<int>"))
    classes = written(
        sketch.where("words > 0").groupBy("one", "two").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key", "row")).alias("first"),
            F.count(F.lit(1)).alias("size"),
            F.first("tokens").alias("tokens"),
        ).withColumn("class", F.monotonically_increasing_id())
    )
    groups = components(candidates(classes.select("class", "tokens"), recall))
    n_group = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n_comp"))
    members = groups.join(n_group, "root").select(F.col("node").alias("class"), F.col("root").alias("comp"), "n_comp")
    members = members.join(classes.select("class", "one", "two", "size", F.col("first.key").alias("of")), "class")
    # a text of each class, by the key of its first row; equal rows share it and count once
    texts = slim.select("key", "text").join(members.hint("shuffle_hash"), F.col("key") == F.col("of"))
    sets = texts.select("comp", "n_comp", "class", "size", "one", "two", "text").mapInArrow(
        _sets, "comp long, n_comp long, class long, size long, grams array<long>"
    )
    n = F.ceil(F.col("n_comp") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("class", F.lit(17)), n.cast("long")).cast("int")
    placed = sets.withColumn("single", n == 1).withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    placed = placed.withColumn("group", F.xxhash64("comp", F.least("own", "other"), F.greatest("own", "other")))
    placed = placed.select("group", "class", "size", "single", "own", "grams").dropDuplicates(["group", "class"])
    links = written(
        placed.repartition("group").sortWithinPartitions("group").mapInArrow(
            _verify(threshold), "class long, linked long, root long, single boolean"
        )
    )
    spread = components(links.where(~F.col("single")).select(F.col("class").alias("a"), F.col("root").alias("b")))
    root = links.where("single").select("class", "root").unionByName(spread.select(F.col("node").alias("class"), "root"))
    linked = links.groupBy("class").agg(F.sum("linked").alias("linked"))
    known = classes.drop("tokens").join(root, "class", "left").join(linked, "class", "left")
    known = known.withColumn("root", F.coalesce("root", "class"))
    named = known.groupBy("root").agg(F.min("first").alias("kept"))
    known = known.join(named, "root").select(
        "one", "two", "class", F.col("kept.doc_id").alias("component_id"), F.col("kept.key").alias("kept_key"), F.col("kept.row").alias("kept_row"), (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    )
    return sketch.drop("tokens").join(known, ["one", "two"], "left").select(
        "doc_id",
        "key",
        "class",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("kept_key", "key").alias("kept_key"),
        F.coalesce(F.col("row") == F.col("kept_row"), F.lit(True)).alias("kept"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", "n_links", "component_id", "kept")
