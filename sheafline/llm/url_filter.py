"""Filtering URLs by rules and, where none fits, by two character models, with DataFrame functions only.

URLs that the rules accept and those that they reject train one variable-order Markov model each: the
counts of all strings of up to ORDER + 1 characters, smoothed by Witten and Bell's estimate towards the
next shorter context. A string is kept where it makes up a PRUNE-th of the characters learned from, so
each length keeps PRUNE strings at most, whatever the size of the table, and the length of a context
follows from what was seen. The difference of the two log-likelihoods, divided by the length of the URL,
is compared with a threshold that makes the two error rates smallest on a held-out fifth of the URLs.

ln P(accepted) - ln P(rejected) of a URL is a sum over positions and context lengths. Each kept string
holds its share of that sum in millionths (what it adds to the next shorter one, plus what leaving it as
a context costs), so a URL is scored by one broadcast join of its strings and one integer sum, which
does not depend on any order.

Defined results: a null URL is judged as an empty one; without `://` host and path are empty and no rule
fits, but the models judge the URL; repeated rows are judged alike; rules of equal length are tried in
code point order; where the rules accept or reject nothing, every score is 0 and the threshold 0 (allow);
an empty table gives an empty result. Columns named like a result are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.llm._joins import told
from sheafline.llm._store import written

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: Longest context in characters, and the most strings that are kept of one length.
ORDER, PRUNE = 4, 50_000
#: Characters that are cut into strings at once.
STEP = 128
#: Probability of a character that was never seen, the same in both models.
UNSEEN = 2.0**-16
#: Millionths in one bin of calibration, and the last bin on either side (20 nats a character).
BIN, LAST_BIN = 10_000, 2_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path after the first `://`, both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lowered(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last one asked comes first
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def strings(rows: DataFrame, url: str, keep: list[str]) -> DataFrame:
    """(keep, gram): every string of up to ORDER + 1 characters by its last character, marks of start and end included.

    A URL is first cut into stretches of STEP characters, so a long one is never held as one array.
    """
    marked = F.concat(F.lit(START), lowered(F.col(url)), F.lit(END))
    cuts = F.sequence(F.lit(0), F.floor((F.char_length(marked) - 1) / STEP).cast("int"))
    first = lambda c: F.greatest(F.lit(1), c * STEP + 1 - ORDER)
    parts = F.transform(cuts, lambda c: F.struct(F.substring(marked, first(c), c * STEP + STEP - first(c) + 1).alias("s"), (c * STEP + 2 - first(c)).alias("at")))
    cut = rows.select(*keep, F.explode(parts).alias("p")).select(*keep, "p.s", "p.at")
    ends = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(ORDER + 1), i)), lambda m: F.substring(F.col("s"), i - m + 1, m))
    return cut.select(*keep, F.explode(F.flatten(F.transform(F.sequence(F.col("at"), F.char_length("s")), ends))).alias("gram"))


def fit(urls: DataFrame, url: str = "url") -> tuple[DataFrame, int]:
    """(gram, value) and what leaving the empty context costs, from URLs with n and accepted (true or false).

    All URLs count. The table has (ORDER + 1) * PRUNE rows at most.
    """
    yes, no = F.col("accepted"), ~F.col("accepted")
    counted = written(
        strings(urls, url, ["n", "accepted"])
        .groupBy("gram")
        .agg(F.sum(F.when(yes, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(no, F.col("n")).otherwise(0)).alias("r"))
    )
    seen = counted.where(F.char_length("gram") == 1).agg(F.sum(F.col("a") + F.col("r")).alias("n")).first().n or 0
    kept = written(counted.where(F.col("a") + F.col("r") >= max(2, -(-seen // PRUNE))))
    inner = kept.where(F.col("gram") != START).withColumn("h", F.expr("substring(gram, 1, char_length(gram) - 1)"))
    count = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    contexts = written(inner.groupBy("h").agg(F.sum("a").alias("na"), count("a").alias("ta"), F.sum("r").alias("nr"), count("r").alias("tr")))
    escape = lambda n, t: F.when(F.col(n) > 0, F.col(t) / (F.col(n) + F.col(t)).cast("double")).otherwise(1.0)
    contexts = contexts.withColumn("e", millionths(escape("na", "ta"), escape("nr", "tr")))
    shorter, out = None, []
    for m in range(1, ORDER + 2):
        level = inner.where(F.char_length("gram") == m).join(F.broadcast(contexts), "h")
        if shorter is None:
            level = level.withColumns({"pa0": F.lit(UNSEEN), "pr0": F.lit(UNSEEN), "s0": F.lit(0).cast("long")})
        else:
            tail = F.expr("substring(gram, 2)")
            below = shorter.select(F.col("gram").alias("tail"), F.col("pa").alias("pa0"), F.col("pr").alias("pr0"), F.col("s").alias("s0"))
            level = level.withColumn("tail", tail).join(F.broadcast(below), "tail")
        smooth = lambda c, n, t, p: F.when(F.col(n) > 0, (F.col(c) + F.col(t) * F.col(p)) / (F.col(n) + F.col(t))).otherwise(F.col(p))
        level = level.withColumns({"pa": smooth("a", "na", "ta", "pa0"), "pr": smooth("r", "nr", "tr", "pr0")})
        level = level.withColumn("s", millionths(F.col("pa"), F.col("pr")))
        shorter = written(level.select("gram", "pa", "pr", "s", (F.col("s") - F.col("e") - F.col("s0")).alias("d")))
        out.append(shorter.select("gram", "d"))
    values = kept.where(F.col("gram") == START).select("gram", F.lit(0).cast("long").alias("d"))
    for level in out:
        values = values.unionByName(level)
    leave = contexts.select(F.col("h").alias("gram"), "e")
    values = values.join(F.broadcast(leave), "gram", "left").select("gram", (F.col("d") + F.coalesce("e", F.lit(0))).alias("value"))
    root = contexts.where(F.col("h") == "").first()
    return written(values), root.e if root else 0


def millionths(accepted: Column, rejected: Column) -> Column:
    return F.round(F.lit(1e6) * (F.log(accepted) - F.log(rejected))).cast("long")


def scored(urls: DataFrame, model: tuple[DataFrame, int], key: str, url: str = "url") -> DataFrame:
    """`urls` (one row a `key`) with score: millionths of a nat for each character and the end, rounded down."""
    values, root = model
    sums = strings(urls, url, [key]).join(F.broadcast(values), "gram").groupBy(key).agg(F.sum("value").alias("__sum"))
    length = (F.char_length(F.coalesce(F.col(url), F.lit(""))) + 1).cast("long")
    out = urls.join(sums, key, "left").withColumns({"__n": length, "__sum": F.coalesce("__sum", F.lit(0)) + length * root})
    return out.withColumn("score", F.expr("(__sum - pmod(__sum, __n)) div __n")).drop("__sum", "__n")


def bin_of(score: Column) -> Column:
    return F.greatest(F.lit(-LAST_BIN), F.least(F.lit(LAST_BIN), F.floor(score / BIN))).cast("long")


def threshold(held: DataFrame) -> int:
    """The bin from which URLs are allowed: smallest sum of both error rates on scored rows with n and accepted.

    A threshold stands half-way between two bins that hold rows. Of equal ones the one nearest 0 counts,
    then the lower one. There are 2 * LAST_BIN + 1 bins at most.
    """
    part = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    bins = held.groupBy(bin_of(F.col("score")).alias("bin")).agg(part(F.col("accepted")).alias("a"), part(~F.col("accepted")).alias("r"))
    every, below = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    wide = lambda c: c.cast("decimal(19,0)")
    lost, let_in = F.coalesce(F.sum("a").over(below), F.lit(0)), F.sum("r").over(every) - F.coalesce(F.sum("r").over(below), F.lit(0))
    errors = wide(lost) * wide(F.sum("r").over(every)) + wide(let_in) * wide(F.sum("a").over(every))
    half = F.col("bin") - F.coalesce(F.floor((F.col("bin") - F.lag("bin").over(Window.partitionBy(F.lit(1)).orderBy("bin"))) / 2), F.lit(0))
    best = bins.select(half.alias("bin"), errors.alias("e"), F.sum("a").over(every).alias("a"), F.sum("r").over(every).alias("r"))
    best = best.where("a > 0 AND r > 0").orderBy("e", F.abs("bin"), "bin").first()
    return best.bin if best else 0


def judged(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """`pages` with host, path, rule and verdict; each different URL is scored once."""
    host, path = host_and_path(F.col(url))
    rule, verdict = rule_of(host, path, rules)
    rows = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url])
    rows = rows.withColumns({"__key": F.md5(F.coalesce(F.col(url), F.lit(""))), "__host": host, "__path": path, "__rule": rule, "__verdict": verdict})
    urls = written(
        rows.groupBy("__key")
        .agg(F.min(url).alias("url"), F.max("__verdict").alias("verdict"), F.count(F.lit(1)).alias("n"))
        .withColumn("accepted", F.col("verdict") == "allow")
        .withColumn("held", F.conv(F.substring("__key", 1, 4), 16, 10).cast("int") % 5 == 0)
    )
    model = fit(urls.where("verdict IS NOT NULL AND NOT held"))
    found = written(scored(urls.where("verdict IS NULL OR held"), model, "__key"))
    least = threshold(found.where("verdict IS NOT NULL"))
    told_by = found.where("verdict IS NULL").select("__key", "n", F.when(bin_of(F.col("score")) >= least, "allow").otherwise("block").alias("__said"))
    total = urls.agg(F.sum("n").alias("n")).first().n or 0
    open_rows = told(rows.where("__verdict IS NULL").drop("__verdict"), told_by, ["__key"], "n", total).withColumnRenamed("__said", "__verdict")
    out = rows.where("__verdict IS NOT NULL").unionByName(open_rows).drop("__key", *([url] if url in ("host", "path", "rule", "verdict") else []))
    return out.withColumnsRenamed({f"__{c}": c for c in ("host", "path", "rule", "verdict")})


def op13(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict")


def _levels() -> str:
    """The level tables p1 to p5 of the SQL, one string length after the other."""
    out = []
    for m in range(1, ORDER + 2):
        below = f"p{m - 1}"
        shorter = (f"{UNSEEN!r}::DOUBLE", f"{UNSEEN!r}::DOUBLE", "0") if m == 1 else (f"{below}.pa", f"{below}.pr", f"{below}.s")
        join = "" if m == 1 else f" JOIN {below} ON {below}.gram = substr(k.gram, 2)"
        out.append(
            f"q{m} AS (SELECT k.gram, c.e, {shorter[2]} AS s0,"
            f" CASE WHEN c.na > 0 THEN (k.a + c.ta * {shorter[0]}) / (c.na + c.ta) ELSE {shorter[0]} END AS pa,"
            f" CASE WHEN c.nr > 0 THEN (k.r + c.tr * {shorter[1]}) / (c.nr + c.tr) ELSE {shorter[1]} END AS pr"
            f" FROM k JOIN c ON c.h = substr(k.gram, 1, length(k.gram) - 1){join} WHERE length(k.gram) = {m} AND k.gram <> chr(2)),\n"
            f"p{m} AS MATERIALIZED (SELECT *, CAST(round(1e6 * (ln(pa) - ln(pr))) AS BIGINT) AS s FROM q{m}),"
        )
    return "\n".join(out)


def _fits(text: str) -> str:
    name, slash, start = text.partition("/")
    return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{start}')"


_LONGEST = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
_ANY = " UNION ALL ".join(f"SELECT gram, s - e - s0 AS d FROM p{m}" for m in range(1, ORDER + 2))
ORACLE = rf"""
WITH u0 AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u1 AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u0),
u2 AS (
  SELECT *, CASE {' '.join(f"WHEN {_fits(t)} THEN '{t}'" for _, t in _LONGEST)} END AS rule,
    CASE {' '.join(f"WHEN {_fits(t)} THEN '{v}'" for v, t in _LONGEST)} END AS told FROM u1),
u AS MATERIALIZED (
  SELECT url, any_value(told) AS told, count(*) AS n, CAST('0x' || substr(md5(url), 1, 4) AS BIGINT) % 5 = 0 AS held,
    chr(2) || translate(url, '{UPPER}', '{LOWER}') || chr(3) AS t FROM u2 GROUP BY url),
ends AS (SELECT *, unnest(generate_series(1, length(t))) AS i FROM u),
g AS MATERIALIZED (SELECT * EXCLUDE (m), substr(t, i - m + 1, m) AS gram FROM (SELECT *, unnest(generate_series(1, least({ORDER + 1}, i))) AS m FROM ends)),
w AS (
  SELECT gram, CAST(sum(CASE WHEN told = 'allow' THEN n ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN told = 'block' THEN n ELSE 0 END) AS BIGINT) AS r
  FROM g WHERE told IS NOT NULL AND NOT held GROUP BY gram),
k AS MATERIALIZED (
  SELECT * FROM w WHERE a + r >= greatest(2, (SELECT ceil(coalesce(sum(a + r), 0) / {PRUNE}.0) FROM w WHERE length(gram) = 1))),
c0 AS (
  SELECT substr(gram, 1, length(gram) - 1) AS h, sum(a) AS na, count(*) FILTER (a > 0) AS ta, sum(r) AS nr, count(*) FILTER (r > 0) AS tr
  FROM k WHERE gram <> chr(2) GROUP BY 1),
c AS MATERIALIZED (
  SELECT *, CAST(round(1e6 * (ln(CASE WHEN na > 0 THEN ta / (na + ta)::DOUBLE ELSE 1.0 END) - ln(CASE WHEN nr > 0 THEN tr / (nr + tr)::DOUBLE ELSE 1.0 END))) AS BIGINT) AS e FROM c0),
{_levels()}
v AS MATERIALIZED (
  SELECT x.gram, x.d + coalesce(c.e, 0) AS value
  FROM ({_ANY} UNION ALL SELECT gram, 0 FROM k WHERE gram = chr(2)) x LEFT JOIN c ON c.h = x.gram),
s0 AS (
  SELECT u.url, u.told, u.n, length(u.url) + 1 AS len,
    CAST(coalesce(s.total, 0) + (length(u.url) + 1) * coalesce((SELECT e FROM c WHERE h = ''), 0) AS BIGINT) AS total
  FROM u LEFT JOIN (SELECT url, sum(value) AS total FROM g JOIN v USING (gram) GROUP BY url) s USING (url) WHERE u.told IS NULL OR u.held),
s AS (
  SELECT url, told, n, greatest(-{LAST_BIN}, least({LAST_BIN}, floor(((total - ((total % len) + len) % len) // len) / {BIN}.0))) AS bin FROM s0),
b AS (SELECT bin, sum(CASE WHEN told = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN told = 'block' THEN n ELSE 0 END) AS r FROM s WHERE told IS NOT NULL GROUP BY bin),
e AS (
  SELECT bin - coalesce(floor((bin - lag(bin) OVER (ORDER BY bin)) / 2.0), 0) AS bin, coalesce(sum(a) OVER below, 0) * sum(r) OVER () + (sum(r) OVER () - coalesce(sum(r) OVER below, 0)) * sum(a) OVER () AS errors,
    sum(a) OVER () AS a, sum(r) OVER () AS r FROM b WINDOW below AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT coalesce((SELECT bin FROM e WHERE a > 0 AND r > 0 ORDER BY errors, abs(bin), bin LIMIT 1), 0) AS least)
SELECT page_id, host, path, rule, coalesce(u2.told, CASE WHEN s.bin >= (SELECT least FROM t) THEN 'allow' ELSE 'block' END) AS verdict
FROM u2 LEFT JOIN s ON s.url = u2.url AND s.told IS NULL
"""
