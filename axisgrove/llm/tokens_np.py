"""Words and n-grams of Arrow string columns as 64-bit hashes, without a Python object a word.

Runs in Python workers. A word is a run of bytes outside space and \\t..\\r (UTF-8 never has those inside a
character); A-Z are lower-cased. A word's hash is a sum of random numbers by byte and position, mixed: equal words
have equal hashes, and other words meet with a chance of about 2^-64.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_RNG = np.random.default_rng(20240607)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(column, most: int = 2_000_000):
    """(first row, last row, bytes, offsets) of runs of rows of an Arrow string array; a run has about `most` bytes or
    one row. Null rows are empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the end): row r has words first[r]:first[r + 1]."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    ink = ~SPACE[data]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    at = offsets[1:-1]
    at = at[at < n]
    begins[at] |= ink[at]  # a word ends with its row
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    where = np.flatnonzero(ink)
    letters = LOWER[data[where]]
    first = np.searchsorted(where, starts)
    lengths = np.diff(np.append(first, len(where)))
    place = np.arange(len(where), dtype=np.int64) - np.repeat(first, lengths)
    power = mix(np.arange(1, int(lengths.max()) + 1, dtype=np.uint64) * STEP) | np.uint64(1)
    hashes = mix(np.add.reduceat(BYTE[letters] * power[place], first) + lengths.astype(np.uint64) * STEP)
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-word window, first window of each row and the end); a row with fewer words, but some, has one
    window with all of them."""
    counts = np.diff(first)
    many = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
    out = np.zeros(int(starts[-1]), dtype=np.uint64)
    if not len(out):
        return out, starts
    row = np.repeat(np.arange(len(counts)), many)
    at = first[row] + (np.arange(len(out)) - starts[row])
    short = counts[row] < n
    with np.errstate(over="ignore"):
        for k in range(n):
            got = hashes[np.minimum(at + k, len(hashes) - 1)]
            out += np.where(short & (k >= counts[row]), np.uint64(k + 1) * STEP, got) * (mix(np.uint64(k + 1) * STEP * np.ones(1, dtype=np.uint64))[0] | np.uint64(1))
        return mix(out), starts
