"""Language-model scores from a hierarchical Pitman-Yor model with sampled seating.

Every word seen in training is a context with a restaurant of its own, as is the start of a text; the
dishes of a restaurant are the words that follow. All context restaurants share one parent, the
restaurant of single words, whose base is uniform over the vocabulary and one unseen word. A table
in a context is a customer of the parent.

Seats are sampled by Gibbs sweeps (see seating.py): all customers of a dish leave and sit down again given
the other dishes. A pair of words seen once has one customer, hence one table, and needs no sampling; so the
pairs seen at least twice form a Spark table that each sweep reads and writes, with the parent's
probabilities and the context's tables of the sweep before (restaurants move side by side, as is
usual for distributed samplers). Predictive probabilities are averaged over the sweeps.

Pairs and words stay packed, a row for each bucket and kind, through counting, sweeps and scoring. A sweep is two
passes: pairs sit down and tell words how many tables they have, words sit down and tell pairs their probabilities. Only
pairs of two rare words need a message of their own; the other rare words live in the bucket of their pairs.

What grows with the corpus stays in Spark tables: pairs, contexts, words. Broadcast are only words
and pairs with a share of 1 / HOT or more of the training tokens, so at most HOT of each; whatever
involves a rarer word is dealt out by that word, the rest by the pair, so that no key is hot. To
score, every text sends its pairs, packed by bucket, to where their counts and tables are; pairs of
two rare words make two steps. Counts of pairs are taken there from the training texts themselves.

Tokens: A-Z lower-cased, runs of bytes other than white space, then one end. Defined results: a null
or empty text is one end token; texts are scored whole; repeated rows get equal scores; ids may be
null or repeat; without training rows N and V are 0 and every token is unseen; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.llm import _arrays as A
from sheafline.llm._store import dropped, small_batches, written
from sheafline.llm.language import remainder
from sheafline.llm.ngram_join import _gathered, _groups
from sheafline.llm.seating import reseat

#: Words and pairs with at least this share of the tokens are broadcast: at most HOT of each.
HOT = 1_000_000
SWEEPS, BURN_IN = 2, 0
SAMPLES = SWEEPS - BURN_IN
STRENGTH = 1.0
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Tokens that one bucket holds on average, with about BYTES bytes each.
BUCKET, BYTES = 1_000_000, 6
#: Rows whose sums meet in one task at the end.
GROUP = 20_000
#: Texts or packed rows that go to Python at once.
BATCH = 1_000

# What a packed row holds: (a, b, r, x) of texts, tables and results, as bytes of 64-bit numbers.
RARE_HOT, RARE_RARE, WORD = 0, 1, 2  # dealt by the rare word that follows
HOT_HOT, RARE_THEN, FORWARDED, RESULT, SCORE = 4, 5, 6, 10, 11
# State of the sampler: pairs (u, w, n, tables of every sample), hot-hot ones by u * k + w; WORD and HOT_WORD are
# (w, pairs seen once, n, weight of every sample). All have the stretches `s` of their tables, `h` for each row.
PAIR_HOT_HOT, PAIR_HOT_RARE, PAIR_RARE_THEN, PAIR_RARE_RARE, HOT_WORD = 20, 21, 22, 23, 24
ONCE = 30  # (u, -, pairs seen once) of rare contexts
FED, TABLES, TABLES_RARE_RARE = 31, 32, 33  # to rare words: (w, -, -, pairs seen once and more often), (w, -, tables), (w, u, tables)
WEIGHT, WEIGHT_RARE_RARE, HOT_WEIGHT = 34, 35, 36  # from words: (w, -, -, weight), (u, w, -, weight)
SUM, STAT = 40, 41  # sums over hot words, by position, as words k more; sums over all rows
PACKED = "bucket long, kind int, a binary, b binary, r binary, x binary"
STATE = PACKED + ", h binary, s binary"
PAIR_KINDS = ((PAIR_HOT_HOT, True, True), (PAIR_HOT_RARE, True, False), (PAIR_RARE_THEN, False, True), (PAIR_RARE_RARE, False, False))
#: Tokens that a task counts before it sends words or pairs on.
MANY = 4_000_000
#: Hot words whose sums meet in one group.
RANGE = 65_536


def discount_of(ones: float, twos: float) -> float:
    """From the numbers of dishes with one and two customers."""
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5


def _tokens(column: pa.Array):
    """For chunks of rows: (lo, hi, row of each token, token), the end of each row included, in order."""
    for lo, hi, row, words in A.word_hashes(column, A.SPACES):
        out = np.full(len(words) + hi - lo, END)
        out[np.arange(len(words)) + row] = words  # an end stands after each row before
        yield lo, hi, np.repeat(np.arange(hi - lo), np.bincount(row, minlength=hi - lo) + 1), out


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(a place of each distinct key, in order, and the sums of the values there)."""
    order = np.argsort(keys)
    there = keys[order]
    first = np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return order[first], [np.add.reduceat(v[order], first) if len(keys) else v for v in values]


def _word_counts(buckets: int):
    """Words (w, n) of the texts, packed by bucket."""

    def run(batches):
        kept, many = [], 0
        for batch in batches:
            for *_, w in _tokens(batch.column("text")):
                kept.append(w)
                many += len(w)
                if many >= MANY:
                    yield counted(kept)
                    kept, many = [], 0
        if kept:
            yield counted(kept)

    def counted(kept):
        words, n = np.unique(np.concatenate(kept), return_counts=True)
        return _packed(_bucket(words, buckets), WORD, words, None, n.astype(np.int64))

    return run


def _all_words(batches):
    """Each word once, and as STAT the tokens and the words."""
    tokens = many = 0
    for table in _gathered(batches, "bucket"):
        for lo, hi in _groups(table.column("bucket").to_numpy()):
            w, _, r, _ = _unpacked(table, WORD, lo, hi)
            at, (n,) = _summed(w, r)
            tokens, many = tokens + int(n.sum()), many + len(n)
            yield _row(table.column("bucket")[lo].as_py(), WORD, w[at], None, n)
    yield _row(0, STAT, x=np.array([tokens, many], dtype=float))


def _often(least: int):
    """Words (w, n) seen so often."""

    def run(batches):
        for batch in batches:
            w, _, n, _ = _unpacked(pa.Table.from_batches([batch]), WORD, 0, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(w[n >= least]), pa.array(n[n >= least])], ["w", "n"])

    return run


def _find(known: np.ndarray, words: np.ndarray, absent: int = -1) -> np.ndarray:
    """Positions in the sorted array `known`, `absent` for what is not there."""
    if not len(known):
        return np.full(len(words), absent)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, at, absent)


def _key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A digest of pairs of 64-bit numbers, in this order."""
    return A.mixed(A.mixed(u.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ w.astype(np.uint64))


class Index:
    """Places in an array of sorted, evenly spread 64-bit numbers: the leading bits tell where to look."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.starts = keys, None

    def place(self, x: np.ndarray) -> np.ndarray:
        """Positions, -1 for what is not there."""
        k = len(self.keys)
        bits = k.bit_length() + 2
        shift = np.uint64(64 - bits)
        if self.starts is None:  # not sent along
            self.starts = np.searchsorted(self.keys >> shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
            self.padded = np.append(self.keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        at = self.starts[x >> shift].astype(np.int64)
        left = np.flatnonzero(self.padded[at] < x)
        while len(left):
            at[left] += 1
            left = left[self.padded[at[left]] < x[left]]
        at[(self.padded[at] != x) | (at == k)] = -1
        return at


class Hot:
    """Words that are broadcast, sorted, with the start of a text among them: at most HOT + 1.

    Arrays over them: n (tokens), total and tables (as contexts), fed (pairs seen once and tables, as words), p (of the
    parent). While sampling, tables and p are those of the last sweep; afterwards they have a row for each sample.
    """

    def __init__(self, words: np.ndarray, n: np.ndarray):
        order = np.argsort(words)
        self.words, self.n = words[order], n[order]
        self.index = Index(self.words)
        self.start = int(_find(self.words, np.array([START]))[0])
        self.k = len(words)

    def pairs(self, column: pa.Array):
        """For chunks of rows: (lo, row, u, w, position of u or -1, position of w or -1) of all tokens."""
        for lo, hi, row, w in _tokens(column):
            at = self.index.place(w)
            u, u_at = np.empty_like(w), np.empty_like(at)
            u[1:], u_at[1:] = w[:-1], at[:-1]
            first = np.concatenate([[True], row[1:] != row[:-1]])
            u[first], u_at[first] = START, self.start
            yield lo, hi, row, u, w, u_at, at


def _binary(values: np.ndarray | None, ends: np.ndarray) -> pa.Array:
    """The bytes of `values` between each two of `ends`, which count values."""
    if values is None:
        ends, values = np.zeros(len(ends), dtype=np.int32), np.zeros(0, dtype=np.int64)
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


NAMES = ["bucket", "kind", "a", "b", "r", "x", "h", "s"]


def _packed(bucket, kind, a, b, r, x=None, width=0, state=False):
    """One row for each bucket: the entries of that bucket, in their order."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 65_536 else bucket, kind="stable")
    bucket = bucket[order]
    ends = np.concatenate([np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), [len(bucket)]]) if len(bucket) else np.zeros(1, int)
    n = len(ends) - 1
    columns = [pa.array(bucket[ends[:-1]].astype(np.int64)), pa.array(np.full(n, kind, dtype=np.int32)), *(_binary(None if v is None else v[order], ends) for v in (a, b, r))]
    columns.append(_binary(None, ends) if x is None else _binary(x.reshape(len(order), width or 1)[order].ravel(), ends * (width or 1)))
    columns += [_binary(None, ends)] * (2 * state)
    return pa.RecordBatch.from_arrays(columns, NAMES[: len(columns)])


def _row(bucket: int, kind: int, a=None, b=None, r=None, x=None, h=None, s=None, state: bool = False):
    """All entries as one row."""
    columns = [pa.array([bucket], pa.int64()), pa.array([kind], pa.int32()), *(_binary(v, np.array([0, 0 if v is None else v.size])) for v in (a, b, r, x, h, s)[: 6 if state else 4])]
    return pa.RecordBatch.from_arrays(columns, NAMES[: len(columns)])


def _bucket(keys: np.ndarray, buckets: int, salt: int = 0) -> np.ndarray:
    return (A.mixed(keys.astype(np.uint64) + np.uint64(salt)) % np.uint64(buckets)).astype(np.int64)


def _unpacked(table: pa.Table, kind: int, lo: int, hi: int, state: bool = False):
    """(a, b, r, x) of all packed rows of a kind between lo and hi, concatenated; of a state h and s as well."""
    part = table.slice(lo, hi - lo)
    part = part.filter(pa.array(part.column("kind").to_numpy() == kind))
    out = []
    for name, of in zip(NAMES[2:], (np.int64, np.int64, np.int64, np.float64, np.int32, np.int32)[: 6 if state else 4], strict=False):
        chunks = []
        for c in part.column(name).chunks:
            ends = np.frombuffer(c.buffers()[1], dtype=np.int32, count=len(c) + 1, offset=4 * c.offset) if len(c) else (0, 0)
            if ends[-1] > ends[0]:
                chunks.append(np.frombuffer(c.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(of))
        out.append(np.concatenate(chunks) if chunks else np.zeros(0, dtype=of))
    return out


def _of_hot(sums: np.ndarray):
    """SUM rows of what a task knows of hot words: a column for each, by ranges of their positions."""
    some = np.flatnonzero(sums.any(0))
    return _packed(some // RANGE, SUM, some, None, None, sums[:, some].T, len(sums), True)


def _met(width: int):
    """SUM rows of one range each."""

    def run(batches):
        for table in _gathered(batches, "bucket"):
            for lo, hi in _groups(table.column("bucket").to_numpy()):
                a, _, _, x = _unpacked(table, SUM, lo, hi)
                at, sums = _summed(a, *x.reshape(-1, width).T)
                yield _row(0, SUM, a[at], x=np.column_stack(sums))

    return run


def _hot_sums(df: DataFrame, width: int, k: int) -> np.ndarray:
    """What a written table tells of hot words, of which there are at most HOT + 1: as contexts, then as words."""
    parts = df.where(F.col("kind") == SUM).select(*NAMES[:6]).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met(width), PACKED)
    out = np.zeros((width, 2 * k))
    for row in parts.select("a", "x").toLocalIterator():
        out[:, np.frombuffer(row["a"], np.int64)] = np.frombuffer(row["x"], float).reshape(-1, width).T
    return out.reshape(width, 2, k)


def _stat(df: DataFrame) -> tuple[int, int]:
    """Two sums over the tasks of a written table."""
    found = [np.frombuffer(row["x"], float) for row in df.where(F.col("kind") == STAT).select("x").toLocalIterator()]
    return tuple(int(x) for x in np.sum(found, axis=0)) if found else (0, 0)


# ---------------------------------------------------------------- counting pairs
def _once(u, w, u_at, w_at, k: int, buckets: int):
    """Pairs, each once with its count (in r), packed by bucket."""
    both = (u_at >= 0) & (w_at >= 0)
    pair, n = np.unique(u_at[both] * k + w_at[both], return_counts=True)
    yield _packed(_bucket(pair, buckets), HOT_HOT, pair, None, n.astype(np.int64))
    u, w, u_at, w_at = u[~both], w[~both], u_at[~both], w_at[~both]
    at, (n,) = _summed(_key(u, w), np.ones(len(u), dtype=np.int64))
    u, w, u_at, w_at = u[at], w[at], u_at[at], w_at[at]
    for kind, some in ((RARE_THEN, (u_at < 0) & (w_at >= 0)), (RARE_HOT, u_at >= 0), (RARE_RARE, (u_at < 0) & (w_at < 0))):
        a = u_at[some] if kind == RARE_HOT else u[some]
        b = w_at[some] if kind == RARE_THEN else w[some]
        yield _packed(_bucket(w[some] if kind == RARE_HOT else u[some], buckets), kind, a, b, n[some])


def _pair_rows(shared, buckets: int):
    def run(batches):
        hot = shared.value
        kept, many = [], 0
        for batch in batches:
            for *_, u, w, u_at, w_at in hot.pairs(batch.column("text")):
                kept.append((u, w, u_at, w_at))
                many += len(u)
                if many >= MANY // 2:
                    yield from _once(*(np.concatenate(x) for x in zip(*kept, strict=True)), hot.k, buckets)
                    kept, many = [], 0
        if kept:
            yield from _once(*(np.concatenate(x) for x in zip(*kept, strict=True)), hot.k, buckets)

    return run


def _counted(shared, buckets: int):
    """From packed pairs the state of those seen twice or more, what they tell their words, and as STAT the pairs seen once and twice."""

    def run(batches):
        k = shared.value.k
        sums, ones, twos = np.zeros((3, 2 * k)), 0, 0
        for table in _gathered(batches, "bucket"):
            for lo, hi in _groups(table.column("bucket").to_numpy()):
                bucket, contexts = table.column("bucket")[lo].as_py(), []
                for kind, (to, u_hot, w_hot) in zip((HOT_HOT, RARE_HOT, RARE_THEN, RARE_RARE), PAIR_KINDS, strict=True):
                    a, b, r, _ = _unpacked(table, kind, lo, hi)
                    if not len(r):
                        continue
                    at, (n,) = _summed(a if kind == HOT_HOT else _key(a, b), r)
                    u, w = (a[at] // k, a[at] % k) if kind == HOT_HOT else (a[at], b[at])
                    often = n > 1
                    ones, twos = ones + int((~often).sum()), twos + int((n == 2).sum())
                    if u_hot:
                        sums[:, :k] += np.bincount(u, n, k), np.bincount(u, ~often, k), np.bincount(u, often, k)
                    else:
                        contexts.append((u, ~often))
                    if w_hot:
                        sums[1:, k:] += np.bincount(w, ~often, k), np.bincount(w, often, k)
                    else:
                        some, (once, more) = _summed(w, (~often).astype(float), often.astype(float))
                        yield _packed(_bucket(w[some], buckets), FED, w[some], None, None, np.column_stack([once, more]), 2, True)
                    u, w, n, pair = u[often], w[often], n[often], a[at][often]
                    yield _row(bucket, to, pair if u_hot and w_hot else u, None if u_hot and w_hot else w, n, None, np.zeros(len(n), np.int32), np.zeros(0, np.int32), True)
                    if not w_hot:
                        yield _told(u, w, np.ones(len(n), dtype=np.int64), u_hot, buckets)
                if contexts:
                    u, once = (np.concatenate(x) for x in zip(*contexts, strict=True))
                    at, (once,) = _summed(u, once.astype(np.int64))
                    yield _row(bucket, ONCE, u[at], None, once, state=True)
        yield _of_hot(sums)
        yield _row(0, STAT, x=np.array([ones, twos], dtype=float), state=True)

    return run


def _told(u, w, t, u_hot: bool, buckets: int):
    """What pairs tell rare words of their tables."""
    if not u_hot:
        return _packed(_bucket(w, buckets), TABLES_RARE_RARE, w, u, t, None, 0, True)
    at, (t,) = _summed(w, t)
    return _packed(_bucket(w[at], buckets), TABLES, w[at], None, t, None, 0, True)


def _vocabulary(shared):
    """The state of all words, hot ones by their position, and as STAT the words with one and with two customers."""

    def run(batches):
        hot = shared.value
        one = two = 0
        for table in _gathered(batches, "bucket"):
            for lo, hi in _groups(table.column("bucket").to_numpy()):
                w, _, n, _ = _unpacked(table, WORD, lo, hi)  # each once, in order
                to, _, _, fed = _unpacked(table, FED, lo, hi)
                at = _find(w, to)
                ones, more = (np.bincount(at, x, len(w)).astype(np.int64) for x in fed.reshape(-1, 2).T)
                place = hot.index.place(w.view(np.uint64))
                there = place >= 0
                ones[there], more[there] = hot.fed[:, place[there]]
                one, two = one + int((ones + more == 1).sum()), two + int((ones + more == 2).sum())
                for kind, some in ((WORD, ~there), (HOT_WORD, there)):
                    names = (w if kind == WORD else place)[some]
                    yield _row(table.column("bucket")[lo].as_py(), kind, names, ones[some], n[some], None, np.zeros(len(names), np.int32), np.zeros(0, np.int32), True)
        yield _row(0, STAT, x=np.array([one, two], dtype=float), state=True)

    return run


# ---------------------------------------------------------------- sampling
def _sampled(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """A row of samples for each entry, with one more."""
    return np.column_stack([x.reshape(len(new), -1), new.astype(float)]) if len(new) else x


def _seats(shared, discount: float, parent: tuple[float, float], sweep: int, buckets: int):
    """Pairs after a sweep, and what they tell their words."""

    def run(batches):
        hot = shared.value
        k, sums = hot.k, np.zeros((1, 2 * hot.k))
        for table in _gathered(batches, "bucket"):
            for lo, hi in _groups(table.column("bucket").to_numpy()):
                bucket, all_ = table.column("bucket")[lo].as_py(), []
                for kind, u_hot, w_hot in PAIR_KINDS:
                    a, b, n, x, h, s = _unpacked(table, kind, lo, hi, True)
                    u, w = (a // k, a % k) if u_hot and w_hot else (a, b)
                    if w_hot:
                        p = hot.p[w]
                    elif u_hot:
                        names, _, _, weights = _unpacked(table, WEIGHT, lo, hi)
                        order = np.argsort(names)
                        p = (weights[order][_find(names[order], w)] + parent[0]) / parent[1] if len(w) else np.zeros(0)
                    else:
                        of, names, _, weights = _unpacked(table, WEIGHT_RARE_RARE, lo, hi)
                        names = _key(of, names)
                        order = np.argsort(names)
                        p = (weights[order][_find(names[order], _key(u, w))] + parent[0]) / parent[1] if len(w) else np.zeros(0)
                    all_.append((u, w, n, p, hot.tables[u] if u_hot else None, h, s, x, a, b))
                own = [np.maximum(x[5], 1) for x in all_]  # tables are counted as one before the first sweep
                rare = np.concatenate([all_[2][0], all_[3][0]])
                if len(rare):
                    names, of = np.unique(rare, return_inverse=True)
                    once, _, many, _ = _unpacked(table, ONCE, lo, hi)  # each once, in order
                    at = _find(once, names)
                    tables = (np.bincount(of, np.concatenate(own[2:])) + np.where(at >= 0, many[at], 0))[of]
                else:
                    tables = np.zeros(0)
                tables = np.concatenate([all_[0][4], all_[1][4], tables])
                u, w, n, p, h, s = (np.concatenate([x[i] for x in all_]) for i in (0, 1, 2, 3, 5, 6))
                if not len(u):
                    continue
                rest = STRENGTH + discount * np.maximum(tables - np.concatenate(own), 0)
                s, ends = reseat(s, np.concatenate([[0], np.cumsum(h)]), n, _key(u, w), rest, p, discount, sweep)
                t = np.diff(ends)
                first = 0
                for (kind, u_hot, w_hot), (u, w, n, *_, x, a, b) in zip(PAIR_KINDS, all_, strict=True):
                    last = first + len(u)
                    some = t[first:last]
                    if len(u):
                        x = _sampled(x, some) if sweep >= BURN_IN else x
                        yield _row(bucket, kind, a, b if len(b) else None, n, x, some.astype(np.int32), s[ends[first] : ends[last]], True)
                        if u_hot:
                            sums[0, :k] += np.bincount(u, some, k)
                        if w_hot:
                            sums[0, k:] += np.bincount(w, some, k)
                        else:
                            yield _told(u, w, some, u_hot, buckets)
                    first = last
                names, _, once, _ = _unpacked(table, ONCE, lo, hi)
                if len(names):
                    yield _row(bucket, ONCE, names, None, once, state=True)
        yield _of_hot(sums)

    return run


def _parent_seats(shared, discount: float, rest: float, base: float, sweep: int, buckets: int):
    """Words after a sweep of the parent restaurant, what they tell their pairs, and as STAT customers and tables."""

    def run(batches):
        hot = shared.value
        all_customers = all_tables = 0
        for table in _gathered(batches, "bucket"):
            for lo, hi in _groups(table.column("bucket").to_numpy()):
                bucket = table.column("bucket")[lo].as_py()
                fed, _, t, _ = _unpacked(table, TABLES, lo, hi)
                to, of, t2, _ = _unpacked(table, TABLES_RARE_RARE, lo, hi)
                for kind in (WORD, HOT_WORD):
                    w, ones, n, x, h, s = _unpacked(table, kind, lo, hi, True)
                    if not len(w):
                        continue
                    if kind == WORD:  # each once, in order
                        customers = ones + np.bincount(_find(w, np.concatenate([fed, to])), np.concatenate([t, t2]), len(w)).astype(np.int64)
                    else:
                        customers = ones + hot.fed[1][w].astype(np.int64)
                    own = np.maximum(h, 1)
                    ids = A.mixed(w.astype(np.uint64) + np.uint64(77))
                    s, ends = reseat(s, np.concatenate([[0], np.cumsum(h)]), customers, ids, STRENGTH + np.maximum(rest - discount * own, 0), np.full(len(w), base), discount, 1000 + sweep)
                    tables = np.diff(ends)
                    all_customers, all_tables = all_customers + int(customers.sum()), all_tables + int(tables.sum())
                    weight = customers - discount * tables
                    yield _row(bucket, kind, w, ones, n, _sampled(x, weight) if sweep > BURN_IN else x, tables.astype(np.int32), s, True)
                    if kind == HOT_WORD:
                        yield _row(bucket, HOT_WEIGHT, w, x=weight, state=True)
                        continue
                    some = np.unique(fed)
                    if len(some):
                        yield _row(bucket, WEIGHT, some, x=weight[_find(w, some)], state=True)
                    if len(to):
                        yield _packed(_bucket(of, buckets), WEIGHT_RARE_RARE, of, to, None, weight[_find(w, to)], 1, True)
        yield _row(0, STAT, x=np.array([all_customers, all_tables], dtype=float), state=True)

    return run


class Model:
    """Numbers of the fit, the broadcast words, the packed state of pairs and words, and what weights of words are to be added and divided by."""

    n = v = 0
    discount = 0.5
    buckets = 1
    hot: Hot
    parents: list[tuple[float, float]]
    seated: DataFrame
    vocabulary: DataFrame

    @property
    def unseen(self) -> list[float]:
        return [a / b for a, b in self.parents]

    @property
    def pairs(self) -> DataFrame:
        """Pairs seen twice or more (u_hot, w_hot, u, w, n, ts)."""
        return self.seated.where(F.col("kind").isin([x[0] for x in PAIR_KINDS])).mapInArrow(_pair_table(self.hot.k), "u_hot boolean, w_hot boolean, u long, w long, n long, ts array<int>")

    @property
    def words(self) -> DataFrame:
        """Words (hot, w, n, ps)."""
        return self.vocabulary.where(F.col("kind").isin(WORD, HOT_WORD)).mapInArrow(_word_table(self.parents), "hot boolean, w long, n long, ps array<double>")


def _listed(x: np.ndarray, of: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * SAMPLES), pa.array(x.ravel(), of))


def _pair_table(k: int, least: int = 0):
    def run(batches):
        for batch in batches:
            for kind, u_hot, w_hot in PAIR_KINDS:
                a, b, n, x = _unpacked(pa.Table.from_batches([batch]), kind, 0, batch.num_rows)
                some = n >= least
                u, w = (a // k, a % k) if u_hot and w_hot else (a, b)
                m, ts = int(some.sum()), x.reshape(-1, SAMPLES)[some].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, u_hot)), pa.array(np.full(m, w_hot)), *(pa.array(v[some]) for v in (u, w, n)), _listed(ts, pa.int32())], ["u_hot", "w_hot", "u", "w", "n", "ts"]
                )

    return run


def _probabilities(weights: np.ndarray, parents) -> np.ndarray:
    """A row for each word, a column for each sample."""
    return (weights.reshape(-1, SAMPLES) + np.array([a for a, _ in parents])) / np.array([b for _, b in parents])


def _word_table(parents):
    def run(batches):
        for batch in batches:
            for kind in (WORD, HOT_WORD):
                w, _, n, x = _unpacked(pa.Table.from_batches([batch]), kind, 0, batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), kind == HOT_WORD)), pa.array(w), pa.array(n), _listed(_probabilities(x, parents), pa.float64())], ["hot", "w", "n", "ps"])

    return run


def _together(*parts: DataFrame) -> DataFrame:
    """Packed rows of one bucket in one task."""
    df = parts[0]
    for more in parts[1:]:
        df = df.unionByName(more)
    return df.repartition("bucket").sortWithinPartitions("bucket")


def _of(df: DataFrame, *kinds: int) -> DataFrame:
    return df.where(F.col("kind").isin(*kinds))


def fit(train: DataFrame) -> Model:
    """The model of every row of `train` (text)."""
    spark, m = train.sparkSession, Model()
    share = spark.sparkContext.broadcast
    size = train.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    m.buckets = buckets = max(1, -(-size // (BYTES * BUCKET)))
    words = written(_together(train.select("text").mapInArrow(_word_counts(buckets), PACKED)).mapInArrow(_all_words, PACKED))
    m.n, m.v = _stat(words)
    often = _of(words, WORD).mapInArrow(_often(-(-max(1, m.n) // HOT)), "w long, n long").toPandas()  # at most HOT rows of two numbers
    m.hot = hot = Hot(np.append(often["w"].to_numpy(np.int64).view(np.uint64), START), np.append(often["n"].to_numpy(np.int64), 0))
    k, shared = hot.k, share(hot)
    pairs = written(_together(train.select("text").mapInArrow(_pair_rows(shared, buckets), PACKED)).mapInArrow(_counted(shared, buckets), STATE))
    m.discount = discount_of(*_stat(pairs))
    of_u, of_w = _hot_sums(pairs, 3, k).transpose(1, 0, 2)
    hot.total, ones_of_u, more = of_u
    hot.tables, hot.fed = ones_of_u + more, of_w[1:]  # every pair has a table before the first sweep
    vocabulary = written(_together(_of(words, WORD), _of(pairs, FED).select(*NAMES[:6])).mapInArrow(_vocabulary(share(hot)), STATE))
    dropped(words)
    discount = discount_of(*_stat(vocabulary))
    rest, parent = discount * m.v, None
    tables, ps, m.parents = [], [], []
    for sweep in range(-1, SWEEPS):
        gone = [vocabulary]
        if sweep >= 0:
            state, weights = _of(pairs, ONCE, *[x[0] for x in PAIR_KINDS]), _of(vocabulary, WEIGHT, WEIGHT_RARE_RARE)
            fresh = written(_together(state, weights).mapInArrow(_seats(share(hot), m.discount, parent, sweep, buckets), STATE))
            gone.append(pairs)
            pairs = fresh
            of_u, of_w = _hot_sums(pairs, 1, k)[0]
            hot.tables, hot.fed = ones_of_u + of_u, np.array([hot.fed[0], of_w])
        state, told = _of(vocabulary, WORD, HOT_WORD), _of(pairs, TABLES, TABLES_RARE_RARE)
        vocabulary = written(_together(state, told).mapInArrow(_parent_seats(share(hot), discount, rest, 1.0 / (m.v + 1), sweep + 1, buckets), STATE))
        customers, seated = _stat(vocabulary)
        rest = discount * seated
        parent = (STRENGTH + rest) / (m.v + 1), STRENGTH + customers
        hot.p = np.zeros(k)
        for row in _of(vocabulary, HOT_WEIGHT).select("a", "x").toLocalIterator():
            hot.p[np.frombuffer(row["a"], np.int64)] = (np.frombuffer(row["x"], float) + parent[0]) / parent[1]
        if sweep >= BURN_IN:
            tables.append(hot.tables)
            ps.append(hot.p)
            m.parents.append(parent)
        dropped(*gone)
    hot.tables, hot.p = np.array(tables), np.array(ps)
    m.seated, m.vocabulary = pairs, vocabulary
    return m


# ---------------------------------------------------------------- scoring
class Scorer:
    """What is broadcast for scoring: at most HOT words and HOT pairs."""

    def __init__(self, m: Model):
        self.hot, self.discount, self.parents, self.unseen = m.hot, m.discount, m.parents, np.array(m.unseen)
        k = m.hot.k
        often = _of(m.seated, PAIR_HOT_HOT).mapInArrow(_pair_table(k, -(-max(1, m.n) // HOT)), "u_hot boolean, w_hot boolean, u long, w long, n long, ts array<int>").toPandas()  # at most HOT rows
        u, w = often["u"].to_numpy(np.int64), often["w"].to_numpy(np.int64)
        keys = A.mixed((u * k + w).view(np.uint64))
        order = np.argsort(keys)
        u, w = u[order], w[order]
        self.pair = Index(keys[order])
        ts = np.array(often["ts"].tolist(), dtype=float).reshape(-1, SAMPLES)[order].T
        self.pair_score = np.log10(self.hot_hot(u, w, often["n"].to_numpy(float)[order], ts)) if len(u) else np.zeros(0)

    def mixture(self, n, ts, total, tables, p) -> np.ndarray:
        """Averaged P(w | u); n: pairs, total: of u, and with a row for each sample ts, tables (of u) and p (of w)."""
        own = np.maximum(n - self.discount * ts, 0.0)
        return ((own + (STRENGTH + self.discount * tables) * p) / (STRENGTH + total)).mean(0)

    def hot_hot(self, u, w, n, ts) -> np.ndarray:
        return self.mixture(n, ts, self.hot.total[u], self.hot.tables[:, u], self.hot.p[:, w])


class Scores:
    """Sums by row of what a task finds in its buckets, sent on when they are many: (score) or (known, base, score)."""

    def __init__(self, groups: int):
        self.groups, self.kept, self.many = groups, [], 0

    def add(self, rid: np.ndarray, *values: np.ndarray):
        rows, at = np.unique(rid, return_inverse=True)
        self.kept.append((rows, *(np.bincount(at, v, len(rows)) for v in values)))
        self.many += len(rows)
        if self.many >= MANY // 2:
            yield from self.sent()

    def sent(self):
        if not self.many:
            return
        rid, *values = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        at, values = _summed(rid, *values)
        rid = rid[at]
        if len(values) == 1:
            yield _packed(_bucket(rid, self.groups, 5), SCORE, rid, None, None, values[0], 1)
        else:
            yield _result(rid, np.zeros(len(rid)), *values, self.groups)
        self.kept, self.many = [], 0


def _result(rid, n_tokens, known, base, score, groups: int):
    x = np.column_stack([base, score]).astype(float)
    return _packed(_bucket(rid, groups, 5), RESULT, rid, n_tokens.astype(np.int64), known.astype(np.int64), x, 2)


def _rare_tokens(shared, buckets: int):
    """Tokens of rare words (rid * 2 + whether for training, in r), packed by the word."""

    def run(batches):
        hot = shared.value.hot
        for batch in batches:
            rid, train = batch.column("rid").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
            for lo, _, row, u, w, u_at, w_at in hot.pairs(batch.column("text")):
                mark = (rid[lo + row] << 1) | train[lo + row]
                for kind, some in ((RARE_HOT, (w_at < 0) & (u_at >= 0)), (RARE_RARE, (w_at < 0) & (u_at < 0))):
                    yield _packed(_bucket(w[some], buckets), kind, w[some], u_at[some] if kind == RARE_HOT else u[some], mark[some])

    return run


def _other_tokens(shared, buckets: int, groups: int):
    """Pairs that end in a hot word and are not hot, and what the broadcast tables tell of each row."""

    def run(batches):
        s = shared.value
        hot = s.hot
        for batch in batches:
            rid, train = batch.column("rid").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
            for lo, hi, row, u, w, u_at, w_at in hot.pairs(batch.column("text")):
                n = hi - lo
                mark = (rid[lo + row] << 1) | train[lo + row]
                there = w_at >= 0
                both = there & (u_at >= 0)
                pair = u_at * hot.k + w_at
                at = np.full(len(pair), -1)
                at[both] = s.pair.place(A.mixed(pair[both].view(np.uint64)))
                done = at >= 0
                base = np.where(there, np.log10(hot.n[w_at] + 1.0), 0.0)
                score = np.bincount(row[done], s.pair_score[at[done]], n)
                yield _result(rid[lo:hi], np.bincount(row, minlength=n), np.bincount(row, there, n), np.bincount(row, base, n), score, groups)
                some = both & ~done
                yield _packed(_bucket(pair[some], buckets), HOT_HOT, pair[some], None, mark[some])
                some = there & ~both
                yield _packed(_bucket(u[some], buckets), RARE_THEN, u[some], w_at[some], mark[some])

    return run


def _then(w: np.ndarray, hot: np.ndarray | bool) -> np.ndarray:
    """One name space for positions of hot words and digests of rare ones."""
    return np.where(hot, _key(np.full(len(w), 3), w).view(np.int64), w)


def _tables(keys: np.ndarray, n: np.ndarray, known: np.ndarray, ts: np.ndarray) -> np.ndarray:
    """A row of tables for each sample, for sorted distinct keys seen n times; of pairs seen once, one."""
    ts = ts.reshape(-1, SAMPLES)
    order = np.argsort(known)
    at = _find(known[order], keys)
    out = np.minimum(n, 1)[None, :].repeat(SAMPLES, 0).astype(float)
    some = at >= 0
    out[:, some] = ts[order][at[some]].T
    return out


def _rare_words(shared, buckets: int, groups: int):
    """Scores after hot words; pairs of two rare words go on with the probabilities of the second."""

    def run(batches):
        s, scores = shared.value, Scores(groups)
        for table in _gathered(batches, "bucket"):
            for lo, hi in _groups(table.column("bucket").to_numpy()):
                words, _, counts, weights = _unpacked(table, WORD, lo, hi)  # each once, in order
                counts, ps = np.append(counts, 0), np.vstack([_probabilities(weights, s.parents), s.unseen])
                w, u, mark, _ = _unpacked(table, RARE_HOT, lo, hi)
                w2, u2, mark2, _ = _unpacked(table, RARE_RARE, lo, hi)
                at, at2 = _find(words, w, len(words)), _find(words, w2, len(words))
                if len(w):
                    keys, first, of = np.unique(_key(u, w), return_index=True, return_inverse=True)
                    n = np.bincount(of, mark & 1).astype(np.int64)
                    tu, tw, _, ts = _unpacked(table, PAIR_HOT_RARE, lo, hi)
                    ts = _tables(keys, n, _key(tu, tw), ts)
                    hu = u[first]
                    p = s.mixture(n, ts, s.hot.total[hu], s.hot.tables[:, hu], ps[at[first]].T)
                    score = np.log10(p)[of]
                else:
                    score = np.zeros(0)
                c = counts[np.concatenate([at, at2])]
                yield from scores.add(np.concatenate([mark, mark2]) >> 1, c > 0, np.log10(c + 1.0), np.concatenate([score, np.zeros(len(w2))]))
                yield _packed(_bucket(u2, buckets), FORWARDED, u2, w2, mark2, ps[at2], SAMPLES)
        yield from scores.sent()

    return run


def _other_words(shared, groups: int):
    """Scores of all other pairs; results pass through."""

    def run(batches):
        s, scores = shared.value, Scores(groups)
        for table in _gathered(batches, "bucket"):
            yield from table.filter(pa.array(table.column("kind").to_numpy() == RESULT)).to_batches()
            for lo, hi in _groups(table.column("bucket").to_numpy()):
                pair, _, mark, _ = _unpacked(table, HOT_HOT, lo, hi)
                if len(pair):
                    keys, of = np.unique(pair, return_inverse=True)
                    n = np.bincount(of, mark & 1).astype(np.int64)
                    known, _, _, ts = _unpacked(table, PAIR_HOT_HOT, lo, hi)
                    score = np.log10(s.hot_hot(keys // s.hot.k, keys % s.hot.k, n, _tables(keys, n, known, ts)))
                    yield from scores.add(mark >> 1, score[of])
                u, w, mark, _ = _unpacked(table, RARE_THEN, lo, hi)
                u2, w2, mark2, p2 = _unpacked(table, FORWARDED, lo, hi)
                if len(u) + len(u2):
                    p = np.vstack([s.hot.p[:, w].T, p2.reshape(-1, SAMPLES)])
                    u, w, mark = np.concatenate([u, u2]), np.concatenate([_then(w, True), w2]), np.concatenate([mark, mark2])
                    keys, first, of = np.unique(_key(u, w), return_index=True, return_inverse=True)
                    n = np.bincount(of, mark & 1).astype(np.int64)
                    tu, tw, _, ts = _unpacked(table, PAIR_RARE_THEN, lo, hi)
                    tu2, tw2, _, ts2 = _unpacked(table, PAIR_RARE_RARE, lo, hi)
                    ts = _tables(keys, n, _key(np.concatenate([tu, tu2]), np.concatenate([_then(tw, True), tw2])), np.concatenate([ts, ts2]))
                    _, of_u = np.unique(u[first], return_inverse=True)
                    tables = np.array([np.bincount(of_u, t)[of_u] for t in ts])
                    score = np.log10(s.mixture(n, ts, np.bincount(of_u, n)[of_u], tables, p[first].T))
                    yield from scores.add(mark >> 1, score[of])
        yield from scores.sent()

    return run


def _sums(batches):
    """(rid, n_tokens, n_known, base, score) of packed results."""
    for table in _gathered(batches, "bucket"):
        for lo, hi in _groups(table.column("bucket").to_numpy()):
            rid, n, known, x = _unpacked(table, RESULT, lo, hi)  # every row has one at least
            more, _, _, score = _unpacked(table, SCORE, lo, hi)
            rows, at = np.unique(rid, return_inverse=True)
            total = lambda v: np.bincount(at, v, len(rows))  # noqa: E731, B023
            score = total(x[1::2]) + np.bincount(_find(rows, more), score, len(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(total(n).astype(np.int64)), pa.array(total(known).astype(np.int64)), pa.array(total(x[::2])), pa.array(score)],
                ["rid", "n_tokens", "n_known", "base", "score"],
            )


def _scores(texts: DataFrame, m: Model, groups: int) -> DataFrame:
    """(rid, n_tokens, n_known, base, total) of every text. Each step is written, so that only one has shuffle files at a time."""
    shared, buckets = texts.sparkSession.sparkContext.broadcast(Scorer(m)), m.buckets
    none = F.lit(None).cast("binary")
    state = lambda df, *kinds: _of(df, *kinds).select(*NAMES[:6])
    pairs = lambda *kinds: state(m.seated, *kinds).withColumn("r", none)
    by_word = _together(texts.mapInArrow(_rare_tokens(shared, buckets), PACKED), state(m.vocabulary, WORD).withColumn("b", none), pairs(PAIR_HOT_RARE))
    met = written(by_word.mapInArrow(_rare_words(shared, buckets, groups), PACKED))
    dropped(m.vocabulary)
    dealt = _together(texts.mapInArrow(_other_tokens(shared, buckets, groups), PACKED), _of(met, FORWARDED), pairs(PAIR_HOT_HOT, PAIR_RARE_THEN, PAIR_RARE_RARE))
    scores = written(dealt.mapInArrow(_other_words(shared, groups), PACKED))
    dropped(m.seated)
    sums = written(_together(scores, _of(met, RESULT)).mapInArrow(_sums, "rid long, n_tokens long, n_known long, base double, total double"))
    dropped(met, scores)
    return sums


def scored(docs: DataFrame, held_out: Column, *, text: str = "text") -> DataFrame:
    """`docs` with held_out, n_tokens, n_known, train_tokens, base_score and score, learned from the rows not held out."""
    own = docs.drop("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "rid", "train")
    kept = [c for c in own.columns if c != text]
    rows = own.select(*kept, F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("train", (~F.col("held_out")).cast("long")))
    with small_batches(docs.sparkSession, BATCH):
        m = fit(rows.where(~F.col("held_out")))
        sums = _scores(rows.select("rid", "train", "text"), m, max(1, math.ceil(rows.count() / GROUP)))
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(m.n + m.v + 1)))
    return rows.select(*kept, "held_out", "rid").join(sums, "rid").select(
        *kept, "held_out", "n_tokens", "n_known", F.lit(m.n).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("total").alias("score")
    )


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, remainder(F.col("doc_id"), 7) == 2)
