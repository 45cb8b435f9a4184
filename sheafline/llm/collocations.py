"""Phrase collocations by level-wise passes: a phrase of k words is counted only where both phrases of k - 1 words inside it are frequent.

Pass k reads all texts, cuts them into pieces and words (numpy over whole Arrow batches, words told
apart exactly by a dictionary), and gives each phrase of k words with its count in a stretch of text;
Spark adds the counts up, so a common phrase is combined before the shuffle. The frequent phrases of
the pass before are broadcast as a table of BITS bits: a phrase in it is always found, so nothing frequent is
lost, and one that is found by chance only costs a count, since the exact counts decide. Its size does not depend on
the corpus. Level tables hold the exact counts of frequent phrases, and candidates are scored by
joining them with the parts of their cuts there.

Defined results: a null text has no words; a null language is `und`, together with rows that say so;
repeated rows count as often as they stand there; without a frequent phrase the result is empty. Texts
of any length are cut at the ends of pieces, never inside one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafline.llm._arrays import LOWERED, flat, mixed, prefix_hash, range_hash, tokens
from sheafline.llm._joins import told
from sheafline.llm._store import small_batches, written

#: Least count of a phrase, longest phrase, phrases a language.
LEAST, LONGEST, TOP = 30, 4, 2000
#: Bits that tell frequent phrases: 16 MB in each task, whatever the corpus.
BITS = 1 << 27
#: Bytes of text that are counted at once.
STRETCH = 1 << 20
#: Rows that Python gets at once.
BATCH = 1000
#: Groups that share the first sort of a language's candidates, and scores that count as one to find where its best end.
SALTS, COARSE = 256, 1000
#: More languages than this are joined by shuffle instead of broadcast.
BROADCAST_LANGS = 100_000

BREAKS = np.zeros(256, dtype=bool)
BREAKS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
NO_WORD = BREAKS.copy()
NO_WORD[[0x20, 0x09]] = True


def stretches(raw: np.ndarray, offsets: np.ndarray, most: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of at most `most`, cut only between texts or after the end of a piece."""
    cuts = np.union1d(np.flatnonzero(BREAKS[raw]) + 1, offsets[1:])
    lo = 0
    while lo < len(raw):
        at = int(np.searchsorted(cuts, lo + most, "right")) - 1
        hi = int(cuts[at]) if at >= 0 and cuts[at] > lo else int(cuts[np.searchsorted(cuts, lo, "right")])
        yield lo, hi
        lo = hi


def words_of(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """For each word in bytes lo to hi: (row, piece, word as dictionary array, hash)."""
    part = LOWERED[raw[lo:hi]]
    rows = np.clip(offsets, lo, hi) - lo
    row, start, end = tokens(part, rows, NO_WORD)
    piece = np.cumsum(BREAKS[part])[start] + row if len(start) else start  # rows end pieces, too
    size = end - start
    ends = np.concatenate([[0], np.cumsum(size)])
    kept = part[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])] if len(start) else part[:0]
    text = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(kept))])
    return row, piece, text.dictionary_encode(), range_hash(prefix_hash(part), start, end)


def lang_hash(langs: list[str]) -> np.ndarray:
    data = [x.encode() for x in langs]
    raw = np.frombuffer(b"".join(data), dtype=np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    return range_hash(prefix_hash(raw), ends[:-1], ends[1:])


def run_hash(lang: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the language and k words from each place; the last k - 1 places have none."""
    n = len(words) - k + 1
    total = lang[: max(n, 0)].copy()
    for i in range(k if n > 0 else 0):
        total = mixed(total * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n])
    return total


def _known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _batch(column: pa.Array, langs: pa.Array, k: int, bits: np.ndarray | None, most: int) -> Iterator[pa.RecordBatch]:
    codes = pc.fill_null(langs, "und").dictionary_encode()
    names = codes.dictionary.to_pylist()
    hashes, of_all = lang_hash(names), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(column):  # rows of about one stretch at a time, so that only those are copied
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + most, "right")))
        raw, offsets = flat(column.slice(first, last - first))
        of_row = of_all[first:last]
        first = last
        yield from _counted(raw, offsets, of_row, codes, hashes, k, bits, most)


def _counted(raw: np.ndarray, offsets: np.ndarray, of_row: np.ndarray, codes, hashes: np.ndarray, k: int, bits: np.ndarray | None, most: int) -> Iterator[pa.RecordBatch]:
    for lo, hi in stretches(raw, offsets, most):
        row, piece, text, word_hash = words_of(raw, offsets, lo, hi)
        if len(row) < k:
            continue
        lang = of_row[row]
        ids, vocabulary = text.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(text.dictionary)
        at = np.flatnonzero(piece[: len(piece) - k + 1] == piece[k - 1 :])
        if k > 1:
            known = _known(bits, run_hash(hashes[lang], word_hash, k - 1))
            at = at[known[at] & known[at + 1]]
        key = lang[at]
        for i in range(k):  # each step tells (phrase so far, next word) apart exactly
            key = key * vocabulary + ids[at + i]
            if i in (1, 2) and i < k - 1:
                key = np.unique(key, return_inverse=True)[1]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        at = at[first]
        phrase = pc.binary_join_element_wise(*[text.dictionary.take(pa.array(ids[at + i])) for i in range(k)], pa.scalar(" ", pa.large_string())) if k > 1 else text.dictionary.take(pa.array(ids[at]))
        yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(lang[at])).cast(pa.string()), phrase.cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"])


def counted(docs: DataFrame, k: int, frequent=None, text: str = "text", lang: str = "lang", stretch: int = STRETCH) -> DataFrame:
    """(lang, phrase, n) of phrases of k words whose two phrases of k - 1 words are in `frequent` (a broadcast bit table)."""

    def run(batches):
        for batch in batches:
            yield from _batch(batch.column(0), batch.column(1), k, None if frequent is None else frequent.value, stretch)

    found = docs.select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(run, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bit_table(spark: SparkSession, level: DataFrame, k: int):
    """The phrases of k words of a level as a broadcast table of BITS bits."""

    def run(batches):
        for batch in batches:
            raw, offsets = flat(batch.column(1))
            row, _, _, words = words_of(raw, offsets, 0, len(raw)) if len(raw) else (np.zeros(0, np.int64),) * 4
            if not len(row):
                continue
            codes = batch.column(0).dictionary_encode()
            lang = lang_hash(codes.dictionary.to_pylist())[codes.indices.to_numpy(zero_copy_only=False)][row]
            at = run_hash(lang, words, k)[np.searchsorted(row, np.arange(batch.num_rows))] & np.uint64(BITS - 1)
            slot, inverse = np.unique((at >> np.uint64(6)).astype(np.int64), return_inverse=True)
            word = np.zeros(len(slot), np.uint64)
            np.bitwise_or.at(word, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(word.view(np.int64))], names=["slot", "word"])

    set_bits = level.select("lang", "phrase").mapInArrow(run, "slot long, word long").groupBy("slot").agg(F.bit_or("word").alias("word"))
    table = np.zeros(BITS >> 6, np.uint64)
    told_by = set_bits.toArrow()  # BITS / 64 rows at most
    table[told_by.column("slot").to_numpy()] = told_by.column("word").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(table)


def levels(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, n) of all frequent phrases, (lang, words) of all words)."""
    spark = docs.sparkSession
    every = written(counted(docs, 1, None, text, lang))
    words = written(every.groupBy("lang").agg(F.sum("n").alias("words")))
    level = written(every.where(F.col("n") >= least))
    out = level.select("lang", F.lit(1).alias("k"), "phrase", "n")
    for k in range(2, longest + 1):
        frequent = bit_table(spark, level, k - 1)
        level = written(counted(docs, k, frequent, text, lang).where(F.col("n") >= least))
        frequent.unpersist()
        out = out.unionByName(level.select("lang", F.lit(k).alias("k"), "phrase", "n"))
    return out, words


def words_from(phrase, start, count):
    return F.array_join(F.slice(F.split(phrase, " "), start, count), " ")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `top` candidates of each language."""
    with small_batches(docs.sparkSession, BATCH):
        found, words = levels(docs, text=text, lang=lang, least=least, longest=longest)
    total = words.agg(F.sum("words").alias("n")).first().n or 0
    phrases = found.where("k > 1")
    # a part with n occurrences has n / least phrases around it at most, so parts that are not hot are in few cuts
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"first": words_from(F.col("phrase"), 1, F.col("cut")), "rest": words_from(F.col("phrase"), F.col("cut") + 1, F.col("k"))})
    for side, name in (("first", "l"), ("rest", "r")):
        facts = found.select("lang", F.col("phrase").alias(side), F.col("n").alias(name), F.col("n").alias("__n"))
        cuts = told(cuts, facts, ["lang", side], "__n", total)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("CAST((CAST(a AS DECIMAL(19,0)) * 2000000BD) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    scored = cuts.groupBy("lang", "phrase", "a", "k").agg(best)
    inside = found.where("k > 2").select("lang", "k", "n", F.col("phrase").alias("longer"))
    inside = inside.select("lang", "n", "longer", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inside = inside.select("lang", "n", "longer", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    inside = inside.groupBy("lang", words_from(F.col("longer"), F.col("at"), F.col("size")).alias("phrase")).agg(F.max("n").alias("most"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.col("most").isNull() | (wide("most") * 100 < wide("a") * 80))
    kept = written(kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    # coarse scores tell where a language's best end, so that only about `top` of them meet in one task; ties beyond are dealt by salt first
    coarse = kept.groupBy("lang", F.floor(F.col("score") / COARSE).alias("__b")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy(F.col("__b").desc()))  # 1000000 / COARSE + 1 rows a language
    ends = coarse.withColumn("upto", upto).where(F.col("upto") >= top).groupBy("lang").agg(F.max("__b").alias("__end"))
    kept = kept.join(F.broadcast(ends) if words.count() <= BROADCAST_LANGS else ends, "lang", "left")
    kept = kept.where(F.col("__end").isNull() | (F.floor(F.col("score") / COARSE) >= F.col("__end"))).drop("__end")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = kept.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("__at", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("__at") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")  # SALTS * top rows at most
    out = some.withColumn("rank", rank).where(F.col("rank") <= top).join(F.broadcast(words) if words.count() <= BROADCAST_LANGS else words, "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


def op11(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


ORACLE = r"""
WITH p AS (
  SELECT lang, unnest(pieces) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang,
      regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
    FROM documents)),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, k, unnest(list_transform(generate_series(1, len(ws) - k + 1), lambda i: array_to_string(ws[i : i + k - 1], ' ')))
  FROM w, (VALUES (2), (3), (4)) AS s(k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (
  SELECT lang, phrase, n AS a, cut, array_to_string(string_split(phrase, ' ')[1 : cut], ' ') AS first, array_to_string(string_split(phrase, ' ')[cut + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM f WHERE k > 1)),
s AS (
  SELECT c.lang, c.phrase, c.a, min(struct_pack(score := CAST((2000000 * c.a::HUGEINT) // (x.n::HUGEINT + y.n::HUGEINT) AS BIGINT), cut := cut, l := x.n, r := y.n)) AS best
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest GROUP BY ALL),
i AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[pos : pos + size - 1], ' ') AS phrase, max(n) AS most FROM (
    SELECT lang, phrase, n, size, unnest(generate_series(1, k - size + 1)) AS pos FROM (SELECT *, unnest(generate_series(2, k - 1)) AS size FROM f WHERE k > 2)) GROUP BY ALL),
r AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY best.score DESC, a DESC, s.phrase) AS rank, s.phrase, a, best.l AS l, best.r AS r, best.score AS score
  FROM s LEFT JOIN i ON i.lang = s.lang AND i.phrase = s.phrase WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT)
SELECT r.lang, rank, phrase, a, l, r, t.n, score FROM r JOIN t ON t.lang = r.lang WHERE rank <= 2000
"""
