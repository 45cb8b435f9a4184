"""Whole Arrow batches of texts as flat numpy arrays: bytes, words, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once inside a batch; a longer text is handled alone.
CHUNK = 1 << 20

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
#: All that is neither an ASCII letter, an ASCII digit nor a byte of a character beyond ASCII.
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = NOT_WORD[128:] = False

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n at least."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, CHUNK + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (a finaliser of shifts and products)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` bytes and `rows` rows each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, hi
        lo = hi


def tokens(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every maximal run of bytes that are no separators, within its row."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    inside = ~separators[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(raw)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = edges[edges > 0] - 1
    last[before] = inside[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Running polynomial hash: entry i covers the first i bytes."""
    up, _ = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes[start:end] for each pair, the same wherever they stand."""
    _, down = _powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start] ^ (end - start).astype(np.uint64))


def word_hashes(column: pa.Array, separators: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks of rows lo to hi: (lo, hi, row of each word less lo, hash of each word, A-Z lower-cased)."""
    raw, offsets = flat(column)
    for lo, hi in chunks(offsets):
        part = LOWERED[raw[offsets[lo] : offsets[hi]]]
        row, start, end = tokens(part, offsets[lo : hi + 1] - offsets[lo], separators)
        yield lo, hi, row, range_hash(prefix_hash(part), start, end)


def run_hashes(row: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each n consecutive words of a row; a row of fewer words gives one of all of them."""
    if not len(words):
        return row, words
    sums, factor = _in_order(words, n), np.uint64(0xD6E8FEB86659FD93)
    counts = np.bincount(row)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    left = (firsts + counts)[row] - np.arange(len(row))  # words from here to the end of the row
    keep = left >= n
    out_row, out = row[keep], sums[keep]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = [int(np.bitwise_xor.reduce(mixed(words[firsts[r] : firsts[r] + counts[r]] + np.arange(counts[r], dtype=np.uint64) * factor))) for r in short]
        out_row = np.concatenate([out_row, short])
        out = np.concatenate([out, mixed(np.array(whole, dtype=np.uint64) + np.uint64(n))])
    return out_row, out


def _in_order(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbours; entries near the end are padded."""
    padded = np.concatenate([words, np.zeros(n - 1, dtype=np.uint64)])
    total = np.zeros(len(words), dtype=np.uint64)
    for k in range(n):
        total = mixed(total * np.uint64(0xD6E8FEB86659FD93) + padded[k : k + len(words)] + np.uint64(k + 1))
    return total
