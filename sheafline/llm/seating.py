"""Seats in Pitman-Yor restaurants: all customers of a dish leave and sit down again in every sweep.

Given all other dishes, t tables with n customers have the weight of a seating: (rest + discount * t) * base
for a table that opens and n - discount * t for a customer who sits at one of those there, where `base` is the
parent's probability of the dish and `rest` is the strength plus discount times the tables of the
restaurant's other dishes.

Dishes of up to FULL customers draw their number of tables from its exact distribution, by generalized
Stirling numbers. In larger ones the customers come one after another, and what is drawn are the moments at which
tables open; the seating of the sweep before and TRIES new ones are weighed against each other (importance
weights, the old one kept as one of them), which leaves the distribution as it is. Tables open by a
rate that knows how likely the later customers make it: f * G'(n) / G(customers), with
G(n) = Gamma(n - discount * t) / Gamma(n - discount * (t + 1)). A draw takes as many steps as there are tables,
however many customers. Many dishes are handled at once. Random numbers are digests of dish, sweep
and step, so lost tasks repeat.

A dish is kept as the lengths of the stretches of customers between the openings of its tables: one for each
table, all positive, as many customers in all as there are.
"""

from __future__ import annotations

import functools

import numpy as np

from sheafline.llm import _arrays as A

#: Dishes of up to so many customers draw exactly; of larger ones, so many new seatings are weighed.
FULL, TRIES = 128, 2


def uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    seed = A.mixed(np.array([salt + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (A.mixed(ids ^ seed[0]) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after small numbers are raised by ten."""
    x = np.asarray(x, dtype=np.float64)
    low = np.flatnonzero(x < 10)
    y = x
    if len(low):
        y = x.copy()
        y[low] += 10
    i = 1 / y
    j = i * i
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + i * (1 / 12 - j * (1 / 360 - j * (1 / 1260 - j / 1680)))
    if len(low):
        some, product = x[low], x[low].copy()
        for k in range(1, 10):
            product *= some + k
        out[low] -= np.log(product)
    return out


@functools.lru_cache(maxsize=8)
def _stirling(discount: float) -> np.ndarray:
    """Logarithms of generalized Stirling numbers: row n, column t, up to FULL."""
    out = np.full((FULL + 1, FULL + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(FULL + 1)
    for n in range(FULL):
        with np.errstate(divide="ignore"):
            out[n + 1] = np.log(np.maximum(n - discount * t, 0.0)) + out[n]
        out[n + 1, 1:] = np.logaddexp(out[n + 1, 1:], out[n, :-1])
    return out


def _exact(customers, ids, rest, base, discount, salt) -> np.ndarray:
    """Numbers of tables of dishes of 1 to FULL customers, from their distribution."""
    out = np.ones(len(customers), dtype=np.int64)
    width, upto = 2, 1
    while upto < FULL:
        rows = np.flatnonzero((customers > upto) & (customers <= width))
        cells = max(1, (1 << 18) // width)
        for lo in range(0, len(rows), cells):
            some = rows[lo : lo + cells]
            opened = np.log(base[some])[:, None] + np.log(rest[some][:, None] + discount * np.arange(width))
            w = np.cumsum(opened, axis=1) + _stirling(discount)[customers[some], 1 : width + 1]
            w = np.cumsum(np.exp(w - w.max(1)[:, None]), axis=1)
            out[some] = 1 + (w <= (uniform(ids[some], salt * 4096 + 1) * w[:, -1])[:, None]).sum(1)
        upto, width = width, min(width * 2, FULL)
    return out


def _rate(n, t, discount):
    """G(n) with t tables; no table opens before it is positive."""
    x = n - discount * (t + 1)
    some = x > 1e-9
    x = np.where(some, x, 1.0)
    g = _log_gamma(np.concatenate([x + discount, x]))
    return np.where(some, np.exp(g[: len(x)] - g[len(x) :]), 0.0)


def _drawn(customers, ids, rest, base, discount, salt) -> tuple[np.ndarray, np.ndarray]:
    """(row, seated then) of every table of new seatings, rows and openings in order."""
    c, t, n = customers.astype(np.float64), np.ones(len(customers)), np.ones(len(customers))
    ids = A.mixed(ids)
    rows, when, some, step = [np.arange(len(c))], [np.ones(len(c))], np.flatnonzero(c > 1), 0
    while len(some):
        tables, seated, last = t[some], n[some], c[some]
        before, most = _rate(seated, tables, discount), _rate(last, tables, discount)
        f = (rest[some] + discount * tables) * base[some] / discount
        # the rate summed up to the opening
        goal = before - np.log1p(-uniform(ids[some] + np.uint64(step), salt)) * most / f
        opens = goal < most
        some, tables, seated, last, goal = some[opens], tables[opens], seated[opens], last[opens], goal[opens]
        # G(x) is about (x - discount * t - (discount + 1) / 2) ** discount; the largest x below the last with G(x) <= goal
        with np.errstate(over="ignore"):
            x = np.floor(goal ** (1 / discount) + discount * tables + (discount + 1) / 2)
        x = np.clip(x, seated, last - 1)
        left = np.arange(len(x))
        while len(left := left[(x[left] > seated[left]) & (_rate(x[left], tables[left], discount) > goal[left])]):
            x[left] -= 1
        left = np.arange(len(x))
        while len(left := left[(x[left] < last[left] - 1) & (_rate(x[left] + 1, tables[left], discount) <= goal[left])]):
            x[left] += 1
        t[some] += 1
        n[some] = x + 1
        rows.append(some)
        when.append(x + 1)
        some = some[x + 1 < last]
        step += 1
    rows, when = np.concatenate(rows), np.concatenate(when).astype(np.int64)
    order = np.argsort(rows, kind="stable")
    return rows[order], when[order]


def _weights(row, when, customers, rest, base, discount) -> np.ndarray:
    """Logarithms of what seatings weigh over the probability that they are drawn."""
    held = np.bincount(row, minlength=len(customers))
    first = np.cumsum(held) - held
    t = (np.arange(len(row)) - first[row] + 1).astype(np.float64)
    last = np.ones(len(row), dtype=bool)
    last[:-1] = row[1:] != row[:-1]
    c, start = customers[row].astype(np.float64), when.astype(np.float64)
    end = np.where(last, c, np.append(start[1:] - 1, 0.0))
    out = _log_gamma(end - discount * t) - _log_gamma(start - discount * t)
    f = (rest[row] + discount * t) * base[row]
    scale = np.where(t < c, f / discount / np.maximum(_rate(c, t, discount), 1e-300), 0.0)  # at own tables all, nothing is left to draw
    upto = scale * (_rate(end, t, discount) - _rate(start, t, discount))
    then = scale * (_rate(end + 1, t, discount) - _rate(end, t, discount))
    out += np.where(last, upto, np.log(f) + upto - np.log(np.maximum(-np.expm1(-then), 1e-300)))
    return np.bincount(row, out, len(customers))


def _large(row, when, known, customers, ids, rest, base, discount, salt) -> tuple[np.ndarray, np.ndarray]:
    """(row, seated then) of the tables of large dishes: the seating of before, where known, or one of TRIES new ones."""
    n = len(customers)
    tried = [(row, when), *(_drawn(customers, ids, rest, base, discount, salt * 4096 + 8 * k + 2) for k in range(TRIES))]
    w = np.array([_weights(*x, customers, rest, base, discount) for x in tried[1:]])
    old = np.full(n, -np.inf)
    if len(row):
        found = _weights(row, when, customers, rest, base, discount)
        old[known] = found[known]
    w = np.vstack([old, w])
    w = np.cumsum(np.exp(w - w.max(0)), axis=0)
    taken = (w <= uniform(ids, salt * 4096 + 1) * w[-1]).sum(0)
    rows, whens = (np.concatenate([x[i][taken[x[0]] == k] for k, x in enumerate(tried)]) for i in (0, 1))
    order = np.argsort(rows, kind="stable")
    return rows[order], whens[order]


def reseat(sizes: np.ndarray, ends: np.ndarray, customers: np.ndarray, ids: np.ndarray, rest: np.ndarray, base: np.ndarray, discount: float, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ends) after one sweep: row i has the stretches sizes[ends[i]:ends[i + 1]], all positive.

    Rows without tables are seated for the first time; where `customers` has changed since the last
    sweep, so are all customers of the row.
    """
    n, sizes, held = len(customers), np.asarray(sizes, dtype=np.int64), np.diff(ends)
    tables = np.zeros(n, dtype=np.int64)
    few = np.flatnonzero((customers > 0) & (customers <= FULL))
    tables[few] = _exact(customers[few], ids[few], rest[few], base[few], discount, salt)
    large = np.flatnonzero(customers > FULL)
    row, when = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if len(large):
        upto = np.concatenate([[0], np.cumsum(sizes)])
        known = (upto[ends[1:]] - upto[ends[:-1]])[large] == customers[large]
        place = np.full(n, -1)
        place[large[known]] = np.flatnonzero(known)
        owner = np.repeat(np.arange(n), held)
        some = np.flatnonzero(place[owner] >= 0)
        row, when = place[owner[some]], upto[some] - upto[ends[owner[some]]] + 1
        row, when = _large(row, when, known, customers[large], ids[large], rest[large], base[large], discount, salt)
        tables[large] = np.bincount(row, minlength=len(large))
    out_ends = np.concatenate([[0], np.cumsum(tables)])
    out = np.ones(out_ends[-1], dtype=np.int32)
    out[out_ends[few]] += (customers[few] - tables[few]).astype(np.int32)  # of small dishes only the number of tables counts
    if len(large):
        last = np.ones(len(row), dtype=bool)
        last[:-1] = row[1:] != row[:-1]
        end = np.where(last, customers[large][row] + 1, np.append(when[1:], 0))
        at = out_ends[large[row]] + np.arange(len(row)) - (np.cumsum(tables[large]) - tables[large])[row]
        out[at] = end - when
    return out, out_ends
