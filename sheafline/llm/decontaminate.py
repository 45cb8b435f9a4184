"""Benchmark decontamination by winnowing, with DataFrame functions only.

Both sides are cut into words (A-Z lower-cased; runs of ASCII letters, ASCII digits and non-ASCII
characters). Of every few consecutive k-grams the smallest hash is kept, once for as long as it stays the
smallest; the choice depends on these words alone, so any shared run of `window` words begins with a
shared fingerprint. Training and test fingerprints are joined and each hit is extended to the windows of words
that begin where it is the smallest, which are compared as text, so nothing is lost and nothing is matched by
hash only. Windows of all lengths (short items are one window) are told in the same pass over the documents.

Defined results: a null or empty text has no words and is never hit; an item without words is
ignored; an item with a null id hits as any other and is left out of the list `items` alone, and
op10's n_items counts all such items of a document as one, as its SQL does; items shorter than
`window` are one window of their own length; repeated rows get equal
results; extra columns of `docs` pass through, those named like a result are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.llm._store import written

WINDOW = 13
#: Words of a gram, and grams of which the smallest is kept: any shared run of 11 words or more shows.
GRAM, KEEP = 8, 4
#: More test fingerprints (or windows) than this are joined by shuffle instead of broadcast.
BROADCAST_ROWS = 500_000
#: So are windows of more bytes in all (a word may be very long).
BROADCAST_BYTES = 256 << 20
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words with A-Z lower-cased; lower() does just that to a text of ASCII characters only."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATOR), "")


def _paired(left: Column, right: Column, shift: int, what) -> Column:
    """what(left[i], right[i + shift]) for each i that has both."""
    n = F.greatest(F.least(F.size(left), F.size(right) - shift), F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(shift + 1), n), what)


def _over(df: DataFrame, column: str, n: int, what) -> tuple[DataFrame, str]:
    """Adds what() of each n neighbours in `column`, made of two runs half as long."""
    if n == 1:
        return df, column
    df, half = _over(df, column, n - n // 2, what)
    name = f"{column}_{n}"
    return df.withColumn(name, _paired(F.col(half), F.col(half), n // 2, what)), name


def _fingerprints(df: DataFrame, n: int) -> tuple[DataFrame, str]:
    """Adds the winnowed fingerprints of runs of n words: at i, the smallest gram of a window there.

    Grams of 2k words are hashes of two grams of k words (of overlapping ones where k is odd).
    """
    k = min(GRAM, n)
    df = df.withColumn("__h", F.transform("w", lambda x: F.xxhash64(x)))
    df, grams = _over(df, "__h", k, lambda a, b: F.xxhash64(a, b))
    return _over(df, grams, min(KEEP, n - k + 1), lambda a, b: F.least(a, b))


def _runs(mark: str, n: int) -> Column:
    """Array of (n, start, last, print): fingerprints thinned to one where they change, with the windows that they stand for."""
    at = F.filter(F.sequence(F.lit(0), F.size(mark)), lambda i: (i > 0) & ((i == 1) | (F.get(mark, i - 1) != F.get(mark, i - 2))))
    # the next change is looked up by place; 0 is left out above, so an empty list gives an empty array
    return F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), i.alias("start"), F.get(mark, i - 1).alias("print")))


def _with_last(runs: str, size: Column) -> Column:
    """`runs` with last, the window before the next run begins (`size` windows in all)."""
    return F.transform(
        runs, lambda r, j: F.struct(r["n"].alias("n"), r["start"].alias("start"), (F.coalesce(F.get(runs, j + 1)["start"], size + 1) - 1).alias("last"), r["print"].alias("print"))
    )


def _marked(df: DataFrame, lengths: list[int]) -> DataFrame:
    """`df` with runs: the thinned fingerprints for windows of every length, worked out in one pass over the words."""
    out = []
    for n in lengths:
        df, mark = _fingerprints(df, n)
        df = df.withColumn(f"__runs_{n}", _runs(mark, n))
        out.append(_with_last(f"__runs_{n}", F.size(mark)))
    return df.withColumn("runs", F.concat(*out))


def _test_side(items: DataFrame, lengths: list[int], window: int) -> tuple[DataFrame, DataFrame]:
    """((n, print, shared) fingerprints, (n, window, item_id, met) windows) of all items, each in the length of its windows."""
    prints, windows = [], []
    for n in lengths:
        of = items.where(F.size("w") >= window) if n == window else items.where(F.size("w") == n)
        tests, mark = _fingerprints(of, n)
        prints.append(tests.select(F.explode_outer(mark).alias("print")).select(F.lit(n).alias("n"), "print"))
        at = F.explode_outer(F.sequence(F.lit(1), F.size("w") - (n - 1))).alias("at")
        windows.append(of.select("item_id", "w", at).select(F.lit(n).alias("n"), "item_id", F.array_join(F.slice("w", F.col("at"), n), " ").alias("window")))
    both = lambda parts: reduce(DataFrame.unionByName, parts).distinct()
    return both(prints).withColumn("shared", F.lit(True)), both(windows).withColumn("met", F.lit(True))


def _places(docs: DataFrame, items: DataFrame, lengths: list[int], window: int) -> DataFrame:
    """Rows (rid, carried columns, n_words, start, n, item_id): windows of items in documents.

    Each document has one more row, with start 0, that carries n_words. A hit may have no item_id. One thinned fingerprint gives one row;
    only where it is met, the windows it stands for are cut out and compared. explode_outer: for
    explode, Spark infers a filter on the array and moves it below the projections, where it
    would compute every fingerprint a second time, inside its own lambdas.
    """
    prints, windows = _test_side(items, lengths, window)
    size = items.agg(F.sum(F.size("w")).alias("rows"), F.sum(F.octet_length(F.array_join("w", " ")) * window).alias("bytes")).first()
    if (size.rows or 0) > BROADCAST_ROWS or (size.bytes or 0) > BROADCAST_BYTES:
        return _by_shuffle(written(docs), lengths, prints, windows)
    carried = [c for c in docs.columns if c != "w"]
    none = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("start"), F.lit(0).alias("last"), F.lit(None).cast("long").alias("print")))
    rows = _marked(docs, lengths).select(*carried, "w", F.explode_outer(F.concat(none, "runs")).alias("r")).select(*carried, "w", "r.*")
    rows = rows.join(F.broadcast(prints), ["n", "print"], "left").where((F.col("start") == 0) | F.col("shared"))
    rows = rows.select(*carried, "w", "n", F.explode(F.sequence("start", "last")).alias("start"))
    rows = rows.where(F.col("start") + (F.col("n") - 1) <= F.size("w"))
    text = F.when(F.col("start") > 0, F.array_join(F.slice("w", F.greatest("start", F.lit(1)), F.col("n")), " "))
    rows = rows.select(*carried, F.size("w").alias("n_words"), "start", "n", text.alias("window"))
    found = rows.join(F.broadcast(windows), ["n", "window"], "left")
    return found.where((F.col("start") == 0) | F.col("met")).select(*carried, "n_words", "start", "n", "item_id")


def _by_shuffle(docs: DataFrame, lengths: list[int], prints: DataFrame, windows: DataFrame) -> DataFrame:
    """_places() where the test side is too large to broadcast: only (rid, n, start, last, print) of a text is shuffled, by its print.

    Runs met go back to their text once, as one list, and only there the windows are cut out. `docs` are written, so their rid is fixed.
    """
    carried = [c for c in docs.columns if c != "w"]
    runs = _marked(docs, lengths).select("rid", F.explode_outer("runs").alias("r")).select("rid", "r.*").where("print IS NOT NULL")
    met = runs.join(prints, ["n", "print"]).groupBy("rid").agg(F.collect_set(F.struct("n", "start", "last")).alias("runs"))
    starts = F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["start"], r["last"]), lambda i: F.struct(r["n"].alias("n"), i.alias("start")))))
    fits = F.filter(starts, lambda x: x["start"] + x["n"] - 1 <= F.size("w"))
    cut = docs.select("rid", "w").join(met, "rid").select("rid", F.explode(F.transform(fits, lambda x: F.struct(x["n"].alias("n"), x["start"].alias("start"), F.array_join(F.slice("w", x["start"], x["n"]), " ").alias("window")))).alias("x"))
    found = cut.select("rid", "x.*").join(windows, ["n", "window"]).select("rid", "start", "n", "item_id")
    of_doc = docs.select(*carried, F.size("w").alias("n_words"))
    none = [F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("item_id")]
    hit = of_doc.join(found, "rid").select(*carried, "n_words", "start", "n", "item_id")
    return hit.unionByName(of_doc.select(*carried, "n_words", *none))


def hits(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """(rid, carried columns, n_words, n_hit, items, nameless) for documents (rid, text, carried columns).

    `nameless` is 1 where an item without an id is among the hits, else 0.
    """
    cut = docs.withColumn("w", words(F.col("text"))).drop("text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0)
    lengths = sorted(r.n for r in items.select(F.least(F.size("w"), F.lit(window)).alias("n")).distinct().collect())  # `window` rows at most
    found = _places(cut, items, lengths or [window], window)
    carried = [F.first(c).alias(c) for c in docs.columns if c not in ("rid", "text")]
    per_doc = found.groupBy("rid").agg(
        *carried,
        F.max("n_words").cast("long").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("start") > 0, F.struct("start", "n")))).alias("places"),
        F.sort_array(F.collect_set("item_id")).alias("items"),
        F.max(((F.col("start") > 0) & F.col("item_id").isNull()).cast("int")).alias("nameless"),
    )
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto")),
        lambda a, x: F.struct(
            (a.hit + F.greatest(F.lit(0), x.start + x.n - 1 - F.greatest(a.upto, x.start - 1))).alias("hit"),
            F.greatest(a.upto, x.start + x.n - 1).alias("upto"),
        ),
    )
    return per_doc.withColumn("n_hit", covered["hit"].cast("long")).drop("places")


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """At least one word in `share` is hit."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """`docs` with n_words, n_hit, items (sorted strings) and contaminated."""
    both = F.struct(F.xxhash64(F.col(doc_id), F.col(text)).alias("a"), F.xxhash64(F.lit(1), F.col(doc_id), F.col(text)).alias("b"))  # 128 bits
    rows = docs.drop("n_words", "n_hit", "items", "contaminated").withColumn("__rid", both)
    found = hits(rows.select(F.col("__rid").alias("rid"), F.col(text).alias("text")), benchmark, window=window).drop("nameless")
    return (
        rows.join(found.withColumnRenamed("rid", "__rid"), "__rid")
        .drop("__rid")
        .withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))
    )


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id",
        "n_words",
        "n_hit",
        (F.size("items") + F.col("nameless")).cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i
    FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM cut, lens WHERE len(w) >= n)),
found AS (SELECT p.doc_id, p.n, p.i, x.item_id FROM places p JOIN wins x ON p.n = x.n AND p.win = x.win),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (
    SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT c.doc_id, CAST(len(c.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(c.w) AS contaminated
FROM cut c LEFT JOIN hit h USING (doc_id) LEFT JOIN named m USING (doc_id)
"""
