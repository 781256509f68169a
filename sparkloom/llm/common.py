"""What the operators share: intermediate tables, Arrow text as byte arrays, word bounds and hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import fresh_path, shared_dir, stored  # noqa: F401

#: ASCII white space as the word contracts define it: \x20 and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: bytes.translate table that lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_NP = np.frombuffer(LOWER, dtype=np.uint8)

_rng = np.random.default_rng(20240607)
#: One random odd-ish 64-bit value for each byte, and the base of the polynomial hashes.
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def tidy() -> None:
    """Gives memory that was freed back to the system. Python workers serve one stage after the other."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow whose tasks leave no freed memory behind in their worker."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return df.mapInArrow(tidied, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unsigned(column):
    """A signed 64-bit column's 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = 1 << 20):
    """(lo, hi) row ranges of about `limit` bytes; a longer text stands alone, whole."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def chunked(texts: pa.Array, limit: int = 1 << 20):
    """(lo, hi, bytes, offsets) of successive row ranges, offsets from 0."""
    data, offsets = text_bytes(texts)
    for lo, hi in row_chunks(offsets, limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def alike(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """(lo, hi) of the runs of rows that agree in all (integer) columns."""
    change = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        change |= np.diff(c.to_numpy(zero_copy_only=False)) != 0
    if len(columns[0]):
        yield from pairwise([0, *(np.flatnonzero(change) + 1).tolist(), len(columns[0])])


#: Bytes outside letters, digits and non-ASCII characters.
NOT_ALNUM = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])


def word_bounds(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of bytes that are not blank (white space); runs never cross rows."""
    ink = ~blank[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(ink)
    before[:1] = True
    before[1:] = ~ink[:-1]
    start = np.flatnonzero(ink & (before | edge[:-1]))
    after = np.empty_like(ink)
    after[-1:] = True
    after[:-1] = ~ink[1:]
    end = np.flatnonzero(ink & (after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n + 1:
        size = max((1 << 20) + 4096, n + 1)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            run = np.full(size, base, dtype=np.uint64)
            run[0] = 1
            _powers[name] = np.multiply.accumulate(run)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which slice_hashes() gets the hash of any slice."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return sums


def slice_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices [start, end), equal for equal bytes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
