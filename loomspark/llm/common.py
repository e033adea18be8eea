"""Helpers shared by the corpus operators: free column names, Arrow text buffers, rolling hashes, bounded bitmaps."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.scratch import materialize, ready

__all__ = ["materialize", "ready"]

U64 = np.uint64
#: Bytes of text that one vectorised step looks at; bounds the memory of the numpy temporaries.
STEP_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from every column in `taken`."""
    have = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- Arrow text


def text_buffers(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string column without making Python strings; null texts are empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    n = len(col)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    valid = np.ones(n, bool) if not col.null_count else np.asarray(col.is_valid())
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0], valid


def _trim():
    """What gives freed memory back to the system, where the C library has such a call."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda keep: 0


TRIM = _trim()


def steps(off: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about `most` bytes together; a longer text stands alone. After the last one the
    worker's freed memory goes back to the system: workers live on, and an executor has several."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
    pa.default_memory_pool().release_unused()
    TRIM(0)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges start, start + 1, ... of the given lengths."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before - starts, counts)


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text) of the runs of non-white bytes; none crosses a text's border."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = off[:-1][(off[:-1] < n)]
    begin[cuts] = inside[cuts]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    last = off[1:][off[1:] > off[:-1]] - 1
    stop[last] = inside[last]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(s, off)


# ---------------------------------------------------------------- hashing

_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n + 1:
        size = max(n + 1, STEP_BYTES + (1 << 18))
        up = np.full(size, _BASE, U64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


class Rolling:
    """Hashes of any substrings of one byte buffer: prefix sums of table values times powers, modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + U64(0x632BE59BD9B4E019) * (end - start).astype(U64))

    def kmers(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


# ---------------------------------------------------------------- bounded bitmap

BITMAP_BITS = 22


def bitmap(df: DataFrame, col: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bit for each hash prefix of a 64-bit hash column: at most 2**bits bits (512 KiB), whatever the input.

    It only saves later shuffles: where many values fill it, more rows pass it and the exact join behind it
    still decides."""
    h = F.col(col)
    word = F.shiftrightunsigned(h, 64 - bits + 6)
    bit = F.shiftrightunsigned(h, 64 - bits).bitwiseAND(F.lit(63)).cast("int")
    rows = df.where(h.isNotNull()).groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("b"))
    out = np.zeros(1 << (bits - 6), np.int64)
    got = rows.toArrow()
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h.view(U64) if h.dtype != U64 else h
    k = int(len(bits)).bit_length() - 1 + 6
    word = (h >> U64(64 - k + 6)).astype(np.int64)
    return ((bits.view(U64)[word] >> ((h >> U64(64 - k)) & U64(63))) & U64(1)).astype(bool)


def hit_rows(df: DataFrame, key: str, bits, hit: bool) -> DataFrame:
    """The rows of df whose 64-bit hash column `key` is in the broadcast bitmap (hit) or not; rows pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = in_bitmap(bits.value, b.column(key).to_numpy())
            b = b.filter(pa.array(got if hit else ~got))
            if b.num_rows:
                yield b

    return df.mapInArrow(run, df.schema)
