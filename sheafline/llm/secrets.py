"""Secret scan by grammar inference.

Labelled credentials of each format (labelled_secrets.py, or the caller's own) are laid out as a
prefix tree, whose states are merged while their outgoing frequencies agree within a Hoeffding bound
(red and blue states, breadth first; of several red ones the likeliest, never the first). The result is one small
probabilistic automaton per format, whose states also tell how likely a credential ends there.

Candidates are all stretches of a run of token characters that begin at its start or after what is no
letter or digit, and end at its end or before one of / . = +, so credentials in paths, hosts and
assignments are met, whatever their length. One pass over a run scores all of them under an
automaton: for each state, only the best start is kept. The score is the log likelihood of the
characters and of ending there, less that of the same characters under the likeliest of the automata
learned from kinds of ordinary tokens; a stretch is a secret if the score is at least a margin a
character and no transition is unseen, save for letters and digits in states that have seen many. Of overlapping ones the highest score
stays, of equal scores the one that starts first, then the shorter one. Digests of 16 and more hex digits are a base kind and no format: nothing in
their letters tells them from parts of identifiers.

Spans are (kind, start, end) in code points, end exclusive. The base kinds are found by pattern
alone; the automata only add spans (kind "format"), never remove any.

Defined results: a null or empty text has no spans; a span found by both ways is given once for
each kind; texts are scanned whole; rows are independent, so repeated rows and extra columns need
no care.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm import labelled_secrets

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Characters that a format's credential has at least.
LEAST = 16
#: Confidence of the Hoeffding test: a lower value merges more.
ALPHA = 0.05
#: Nats a character by which a format must beat ordinary tokens.
MARGIN = 0.5
#: A state with more different characters admits letters and digits it has not seen.
VARIED = 6
END = ""


# ---------------------------------------------------------------- automata
class Automaton:
    """A probabilistic automaton inferred from strings by merging prefix-tree states."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        for s in strings:
            state = 0
            for ch in s:
                self.count[state][ch] += 1
                if ch not in self.next[state]:
                    self.next[state][ch] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                state = self.next[state][ch]
            self.count[state][END] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.logs = {q: self._log(q) for q in self.states}
        visits = {q: sum(self.count[q].values()) for q in self.states}
        self.most = {q: max(self.next[q].values(), key=visits.get, default=q) for q in self.states}

    def admits(self, state: int, ch: str) -> bool:
        """Whether a credential may go on so: a character seen here, or any letter or digit where many have been seen."""
        return ch in self.next[state] or (len(self.next[state]) > VARIED and (ch.isalnum() or ch in "-_"))

    def _alike(self, a: int, b: int) -> bool:
        """Whether no frequency below the two states tells them apart."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = sum(self.count[a].values()), sum(self.count[b].values())
            if not n or not m:
                continue
            most = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for ch in {*self.count[a], *self.count[b]}:
                if abs(self.count[a].get(ch, 0) / n - self.count[b].get(ch, 0) / m) > most:
                    return False
                if ch in self.next[a] and ch in self.next[b]:
                    todo.append((self.next[a][ch], self.next[b][ch]))
        return True

    def _fits(self, red: int, blue: int) -> float:
        """Log likelihood of all that was seen below `blue` if it went on from `red`, often visited ones being likelier."""
        todo, total = [(red, blue)], sum(self.count[blue].values()) * math.log(sum(self.count[red].values()))
        while todo:
            a, b = todo.pop()
            n = sum(self.count[a].values())
            for ch, m in self.count[b].items():
                total += m * math.log((self.count[a].get(ch, 0) + 0.05) / (n + 5))
            todo += [(self.next[a].get(ch, red), child) for ch, child in self.next[b].items()]
        return total

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for ch, n in self.count[b].items():
                self.count[a][ch] += n
            for ch, child in self.next[b].items():
                if ch in self.next[a]:
                    todo.append((self.next[a][ch], child))
                else:
                    self.next[a][ch] = child

    def _merge(self) -> None:
        red, blue = [0], deque((0, ch) for ch in sorted(self.next[0]))
        known = {0}
        while blue:
            parent, ch = blue.popleft()
            state = self.next[parent][ch]
            if state in known:
                continue
            like = max((r for r in red[1:] if self._alike(r, state)), key=lambda r: self._fits(r, state), default=None)
            if like is None:
                red.append(state)
                known.add(state)
                blue.extend((state, c) for c in sorted(self.next[state]))
            else:
                self.next[parent][ch] = like
                self._fold(like, state)
                blue.extend((r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c] not in known)
        self.states = red

    def _log(self, state: int) -> dict[str, float]:
        """Log probabilities; the mass of the unseen grows with the number of different characters seen."""
        seen = self.count[state]
        total = sum(seen.values()) + len(seen)
        kept = {ch: math.log(n / total) for ch, n in seen.items()}
        kept[None] = math.log(len(seen) / total / 95)
        return kept

    def step(self, state: int, ch: str) -> tuple[float, int]:
        """(log likelihood, next state); after an unseen character the most visited one that follows."""
        p = self.logs[state].get(ch)
        return (self.logs[state][None], self.most[state]) if p is None else (p, self.next[state][ch])


class Scanner:
    """Automata of every format and the one of ordinary tokens (a few hundred states in all)."""

    def __init__(self, labelled: dict[str, list[str]] | None = None, ordinary: dict[str, list[str]] | None = None, margin: float = MARGIN):
        self.formats = {k: Automaton(v) for k, v in (labelled or labelled_secrets.credentials()).items()}
        self.ordinary = [Automaton(v) for v in (ordinary or labelled_secrets.ordinary()).values()]
        self.margin = margin

    def plain(self, run: str) -> list[list[float]]:
        """For each ordinary kind, the log likelihood of the first characters of a run."""
        out = []
        for a in self.ordinary:
            state, total, upto = 0, 0.0, [0.0]
            for ch in run:
                p, state = a.step(state, ch)
                total += p
                upto.append(total)
            out.append(upto)
        return out

    def credentials(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of the credentials in a run of token characters."""
        plain = self.plain(run)
        guide = max(plain, key=lambda upto: upto[-1])
        starts = [True, *(not a.isalnum() for a in run[:-1])]  # after what is no letter or digit
        ends = [*(b in "/.=+" for b in run[1:]), True]
        found = []
        for a in self.formats.values():
            live: dict[int, tuple[float, int]] = {}  # state -> best score and its start
            for i, ch in enumerate(run):
                if starts[i] and a.admits(0, ch) and (0 not in live or live[0][0] < 0):
                    live[0] = (0.0, i)
                if not live:
                    continue
                now: dict[int, tuple[float, int]] = {}
                for state, (score, start) in live.items():
                    if a.admits(state, ch):
                        p, to = a.step(state, ch)
                        value = score + p - guide[i + 1] + guide[i]
                        if to not in now or now[to][0] < value:
                            now[to] = (value, start)
                live = now
                if ends[i]:
                    for state, (score, start) in live.items():
                        score += a.logs[state].get(END, a.logs[state][None]) + guide[i + 1] - guide[start]
                        score -= max(upto[i + 1] - upto[start] for upto in plain)
                        if i + 1 - start >= LEAST and score >= self.margin * (i + 1 - start):
                            found.append((score, start, i + 1))
        kept: list[tuple[int, int]] = []
        upto: list[int] = []  # starts and ends in turn, of what is kept
        for _, start, end in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            at = bisect.bisect_right(upto, start)
            if at % 2 == 0 and bisect.bisect_left(upto, end) == at:
                upto[at:at] = [start, end]
                kept.append((start, end))
        return kept

    def is_secret(self, token: str) -> bool:
        return (0, len(token)) in self.credentials(token)

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end), sorted."""
        if not text:
            return []
        found = []
        if "=" in text or ":" in text:
            found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        for m in RUN.finditer(text):
            found += [(m.start() + a, 3, m.start() + b) for a, b in self.credentials(m[0])]
        return sorted(found)


SCHEMA = "array<struct<kind:string,start:int,end:int>>"


def with_spans(docs: DataFrame, text: str = "text", *, scanner: Scanner | None = None) -> DataFrame:
    """`docs` with `spans`: array of (kind, start, end) by start, then kind."""
    scanner = scanner or Scanner()

    @F.pandas_udf(SCHEMA)
    def spans_of(column: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.spans(x)] for x in column], dtype=object)

    return docs.withColumn("spans", spans_of(F.col(text)))


def redacted(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", *, scanner: Scanner | None = None) -> DataFrame:
    """`docs` with every span (overlapping ones as one) replaced by `mask`; other texts unchanged."""
    scanner = scanner or Scanner()

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        out = []
        for x in column:
            parts, upto = [], 0
            for a, _, b in scanner.spans(x):
                if a >= upto:
                    parts += [x[upto:a], mask]
                upto = max(upto, b)
            out.append("".join([*parts, x[upto:]]) if parts else x)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, clean(F.col(text)))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_spans(docs).drop("text")

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    base = F.filter("spans", lambda s: s.kind != "format")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def base_digest(text: str | None) -> tuple[int, int, int, str]:
    """The base columns of one text, for tests: plain patterns as in the contract."""
    found = []
    for k, (pattern, least, group) in enumerate(
        [(ASSIGN, 12, 1), (re.compile("AKIA[A-Z0-9]+"), 18, 0), (re.compile("[0-9a-f]+"), 16, 0)]
    ):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    found.sort()
    told = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
    return (*(sum(k == i for _, k, _ in found) for i in range(3)), hashlib.sha256(told.encode()).hexdigest())
