"""Content-defined chunking: cut points where a rolling hash of the bytes has low bits of zero.

The hash is linear over XOR, so the state at byte i of a chunk that began at s is a rotation of the XOR of two prefix
sums. Prefix sums are made once for a text; each chunk then tests its whole range of possible cuts at once.
"""

from __future__ import annotations

import numpy as np

MIN_SIZE, MAX_SIZE, MASK_BITS, WINDOW = 1024, 16 * 1024, 13, 48
_U = np.uint64


def byte_values() -> np.ndarray:
    """One pseudo-random word a byte: an FNV-1a walk with a shift."""
    out, x = np.zeros(256, np.uint64), 0xCBF29CE484222325
    for i in range(256):
        x = x * 0x100000001B3 & (1 << 64) - 1
        x ^= x >> 33
        out[i] = x
    return out


_VALUES = byte_values()


def _turn(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = (by % 64).astype(_U)
    return x << by | x >> (_U(64) - by) % _U(64) if by.ndim else x << by | x >> (_U(64) - by) % _U(64)


def cut(data: bytes, min_size: int = MIN_SIZE, max_size: int = MAX_SIZE, mask_bits: int = MASK_BITS) -> list[tuple[int, int]]:
    """(start, end) spans that cover data; none for no bytes, one up to min_size bytes."""
    n = len(data)
    if n <= min_size:
        return [(0, n)] if n else []
    at = np.arange(n)
    term = _VALUES[np.frombuffer(data, np.uint8)]
    if n > WINDOW:
        term[WINDOW:] ^= _turn(_VALUES[np.frombuffer(data, np.uint8)[:-WINDOW]], np.array(WINDOW))
    sums = np.bitwise_xor.accumulate(_turn(term, -at))
    mask = _U((1 << mask_bits) - 1)
    out, start = [], 0
    while start < n:
        lo, hi = start + min_size - 1, min(start + max_size, n)
        before = sums[start - 1] if start else _U(0)
        hit = np.flatnonzero(_turn(sums[lo:hi] ^ before, at[lo:hi]) & mask == 0)
        end = lo + int(hit[0]) + 1 if len(hit) else hi
        out.append((start, end))
        start = end
    return out
