"""Array helpers for work inside tasks: UTF-8 batches cut into words, hashed without a loop per word.

A word hash is a polynomial over the word's bytes modulo 2**64, read off one prefix array and
then mixed. All functions work on one group of rows at a time; groups are bounded by bytes,
and a single text beyond that bound is cut at separators, so memory follows the longest word
and the number of words of one text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = 2 << 20
SCAN_ROWS = 512
GROUP_BYTES = 1 << 21
SEGMENT_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def bound_batches(spark: SparkSession) -> None:
    """Let the session send rows to Python in Arrow batches of about ``BATCH_BYTES``, or of one longer row.

    The default is thirty times that, which executor and worker each hold twice for every task. Scans
    take ``SCAN_ROWS`` rows at a time: the default of 4,096 texts fills arrays of many megabytes
    in each task, and the heap grows to three times what it holds. Only the cut into batches changes, and no result depends on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)


def give_back() -> None:
    """Return freed memory to the system at the end of a task; idle workers would keep it beside the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` for ``i < n``."""
    if len(_powers.get("up", ())) < n:
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the row bounds in them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups(bounds: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or one longer row."""
    lo, rows = 0, len(bounds) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def _cuts(word: np.ndarray, edges: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(word)
    while lo < n:
        hi = lo + limit
        if hi >= n:
            hi = n
        else:
            edge = int(edges[np.searchsorted(edges, hi)])
            gap, step = n, hi
            while step < n:
                found = np.flatnonzero(~word[step : step + limit])
                if len(found):
                    gap = step + int(found[0])
                    break
                step += limit
            hi = min(edge, gap)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word: a run of bytes marked in ``word`` within one row."""
    all_starts, all_ends, all_hashes = [], [], []
    for lo, hi in _cuts(word, bounds[1:], SEGMENT_BYTES):
        part = word[lo:hi]
        inner = bounds[np.searchsorted(bounds, lo, "right") : np.searchsorted(bounds, hi, "left")] - lo
        before = np.empty(len(part), bool)
        before[0] = False
        before[1:] = part[:-1]
        before[inner] = False
        after = np.empty(len(part), bool)
        after[-1] = False
        after[:-1] = part[1:]
        after[inner - 1] = False
        starts = np.flatnonzero(part & ~before)
        ends = np.flatnonzero(part & ~after) + 1
        up, down = powers(len(part) + 1)
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data[lo:hi]] * up[:-1], out=prefix[1:])
        all_hashes.append(mix((prefix[ends] - prefix[starts]) * down[starts]))
        all_starts.append(starts + lo)
        all_ends.append(ends + lo)
    if not all_starts:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64)
    return np.concatenate(all_starts), np.concatenate(all_ends), np.concatenate(all_hashes)


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def hash_words(items: list[str]) -> np.ndarray:
    """The hash that ``words`` gives to each of ``items``."""
    out = []
    for item in items:
        raw = np.frombuffer(item.encode(), np.uint8)
        up, _ = powers(len(raw) + 1)
        out.append((_BYTE_VALUES[raw] * up[:-1]).sum(dtype=np.uint64))
    return mix(np.array(out, np.uint64))
