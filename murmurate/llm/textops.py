"""Vectorised text kernels: whole Arrow batches of text as one byte array.

Every function works on a *slice*: the concatenated UTF-8 bytes of some rows
(``buf``) and the row offsets (``off``, one more than rows).  Words are found
with byte look-up tables, so the separators must be ASCII; a null text counts
as an empty one.  Word identity is a 64-bit hash; with a billion distinct words
the chance of any collision is about 3 %, and a collision merges two words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 2 << 20
#: Rows of whole texts that Spark sends to a Python worker at once.
BATCH_ROWS = 1000
#: Rows of a batch that are copied at once.
CHUNK_ROWS = 1000
_PERIOD = 1 << 16
_libc = ctypes.CDLL(None)
_trim = getattr(_libc, "malloc_trim", None)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_POWER = np.multiply.accumulate(np.full(_PERIOD, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))

#: Words between the ASCII white space characters.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ASCII letters and digits and of all non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_array(column) -> pa.Array:
    """A column of a batch as plain large strings without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a large_string array, without a copy."""
    n = len(texts)
    _, offsets, data = texts.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def release() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks, and the allocators keep what a batch took."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean() -> None:
    """Lets a Python worker take its Arrow buffers from the C heap, of one arena, so that ``release`` can give them back."""
    pa.set_memory_pool(pa.system_memory_pool())
    if hasattr(_libc, "mallopt"):
        _libc.mallopt(-8, 1)  # M_ARENA_MAX


_resident: dict = {}


def resident(key, make):
    """The model ``key`` of this Python worker; a worker holds one model at a time, so that stages don't add up."""
    if key not in _resident:
        vacate()
        _resident[key] = make()
        release()
    return _resident[key]


def vacate() -> None:
    """Drops the model that an earlier stage left in this Python worker."""
    lean()
    if _resident:
        _resident.clear()
        release()


def small_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of this session at ``BATCH_ROWS`` rows or less: a batch lies in the JVM and in a worker at the same time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) with about ``limit`` bytes each; a longer text is a slice of its own."""
    for a in range(0, len(column), CHUNK_ROWS):
        buf, off = buffers(text_array(column.slice(a, CHUNK_ROWS)))
        n, i = len(off) - 1, 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            j = min(j, n)
            yield a + i, a + j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
    release()


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``mask`` that stay within a row."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | first[:n]))
    last = np.zeros(n + 1, bool)
    last[off[1:]] = True
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | last[1:])) + 1
    return starts, ends


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are disjoint, in order and not empty."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=at[1:])
    total = int(at[-1] + lens[-1])
    rel = np.arange(total, dtype=np.int64) - np.repeat(at, lens)
    if total == len(buf):
        b = buf
    else:
        b = buf[rel + np.repeat(starts, lens)]
    values = _BYTE[b]
    values *= _POWER[rel & (_PERIOD - 1)]
    return mix(np.add.reduceat(values, at) + lens.astype(np.uint64))


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of every word of a slice; the first word of row r is at index first[r] of ``row_starts``."""
    starts, ends = runs(table[buf], off)
    h = hash_spans(LOWER[buf] if lower else buf, starts, ends)
    rows = np.searchsorted(off, starts, "right") - 1
    return h, rows, starts, ends


def row_starts(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Index of the first word of each row, and the number of words at the end."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def combine(*parts: np.ndarray) -> np.ndarray:
    """One hash of hashes, order counts."""
    out = parts[0].copy()
    for p in parts[1:]:
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += p ^ (out >> np.uint64(32))
    return mix(out)


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``k`` words that stays within a row, and the index of its first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = np.ones(len(h) + 1, bool)
    for j in range(1, k):
        late = first[1:] - j
        ok[late[late >= 0]] = False
    # rows shorter than k words: none of their words starts a window
    counts = np.diff(first)
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        ok[first[r] : first[r + 1]] = False
    at = np.flatnonzero(ok[:n])
    return combine(*(h[at + j] for j in range(k))), at
