"""Words of whole texts as 64-bit hashes, for a batch of texts at once, in numpy.

A word's hash depends on its bytes alone.  Texts are taken in runs of about ``RUN`` bytes, so that
memory doesn't follow the batch size; a longer text is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN = 1 << 19
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A number for each byte, the same for A-Z as for a-z.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)[_LOWER]
#: Bytes of words: whatever isn't white space; letters, digits and all that isn't ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, ``n`` of each at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 17)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def runs(offsets: np.ndarray, most: int = RUN) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, one text at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts, and where each text's words begin (one more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    first[offsets[:-1][offsets[:-1] < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = True
    starts, stops = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    up, down = powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE[data] * up[:n], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * _MUL)
    return hashes, np.searchsorted(starts, offsets)


def combine(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive numbers; ``len(hashes) - k + 1`` of them, none if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * mix(np.array([(j + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)], np.uint64))[0]
    return mix(out + np.uint64(k))
