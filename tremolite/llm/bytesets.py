"""Vectorised word work on the UTF-8 bytes of an Arrow column: no Python object per word.

Texts are taken in runs of about ``RUN`` bytes (one text at least), so memory stays bounded
whatever the size of an Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: A fixed random number for each byte value; capitals A-Z count as a-z in FOLDED.
EXACT = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
FOLDED = EXACT.copy()
FOLDED[65:91] = EXACT[97:123]

#: White space: space and the five control characters from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2^64, of the base of the word hash and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, RUN + 1)
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers.append(np.cumprod(factors))
    return _powers[0][:n], _powers[1][:n]


def shrink_powers() -> None:
    """Forget tables that one very long text made large."""
    if _powers and len(_powers[0]) > 4 * RUN:
        _powers.clear()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def released() -> None:
    """Give memory that is free but still held by this process back to the machine, where the C library can (glibc)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over the batches of a task; then what it freed is released, since Spark keeps idle workers beside those
    of later stages."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return whole


def runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about RUN bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + RUN, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def spans(apart: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words: maximal runs where ``apart`` is false, cut at row ends (``at``)."""
    n = len(apart)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    word = ~apart
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first, last = word.copy(), word.copy()
    first[1:] &= apart[:-1] | edge[1:n]
    last[:-1] &= apart[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(at, starts, side="right") - 1


def prefix_hashes(b: np.ndarray, table: np.ndarray = EXACT) -> np.ndarray:
    """Sums from which ``hashes`` takes the hash of any span."""
    c = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(table[b] * powers(len(b) + 1)[0][: len(b)], out=c[1:])
    return c


def hashes(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes give equal hashes wherever they stand."""
    return mixed((c[ends] - c[starts]) * powers(len(c))[1][starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the k-word shingles, with repeats; a row of fewer words gives its whole sequence once."""
    n = len(words)
    if not n:
        return words, rows
    h = np.zeros(n, np.uint64)
    length = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        inside = rows[j:] == rows[: n - j]
        h[: n - j] = np.where(inside, mixed(h[: n - j] * np.uint64(0x2545F4914F6CDD1D) + words[j:] + np.uint64(j + 1)), h[: n - j])
        length[: n - j] += inside
    first = np.concatenate([[True], rows[1:] != rows[:-1]])
    full = length == k
    take = full | (first & ~full)
    return h[take], rows[take]


def distinct(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row."""
    if not len(h):
        return h, rows
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])])
    return h[new], rows[new]


def shingle_sets(b: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text of a run, and their rows. A-Z count as a-z."""
    starts, ends, rows = spans(SPACE[b], at)
    return distinct(*shingles(hashes(prefix_hashes(b, FOLDED), starts, ends), rows, k))
