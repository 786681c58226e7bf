"""Texts of an Arrow batch as flat numpy arrays: bytes, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
B = 0x9E3779B97F4A7C15 | 1
B_INV = pow(B, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which all bits depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= M1
    x ^= x >> np.uint64(33)
    x *= M2
    x ^= x >> np.uint64(33)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64))
LOWER_BYTE = BYTE[LOWER]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + (1 << 16))
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, where, data = column.buffers()
    at = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows lo..hi with at most `limit` bytes together (or one row): lo, hi, their bytes, each row's begin in these."""
    data, at = flat(batch.column(batch.schema.get_field_index(column)))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive bytes."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(B, len(data)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(B_INV, len(data) - k + 1))


def together(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of 64-bit hashes by size, equal ones in the order of their places, and where in it each different one begins.

    The places are sorted with the first bits of the hashes; where these are the same for different ones, the whole hashes are.
    """
    low = np.uint64((1 << max(len(keys) - 1, 0).bit_length()) - 1)
    packed = np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64))
    order = (packed & low).view(np.int64)
    found = keys[order]
    new = found[1:] != found[:-1]
    if (new & ((packed[1:] ^ packed[:-1]) <= low)).any():
        order = np.argsort(keys, kind="stable")
        found = keys[order]
        new = found[1:] != found[:-1]
    return order, np.flatnonzero(np.append(True, new)) if len(keys) else order


def words(data: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased (A-Z) texts: begins, ends, and the number of the first word of each text (and of one behind)."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # a text's begin ends any word
    edge[at] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, at)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LOWER_BYTE[data] * powers(B, len(data)), out=sums[1:])
    return mix((sums[end] - sums[begin]) * powers(B_INV, len(data) + 1)[begin] + (end - begin).astype(np.uint64) * M1)
