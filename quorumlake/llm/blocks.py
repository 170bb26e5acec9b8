"""UTF-8 text columns as flat byte blocks, with vectorised words, hashes and packed integer lists.

A block is a run of rows whose texts lie one after another in one byte array. Memory for a block is
a small multiple of its bytes; a block has ``block_bytes`` at most, except for one text that is longer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_table(lower: bool, salt: int = 1) -> np.ndarray:
    """A pseudo-random odd 64-bit value for each byte; A-Z share those of a-z if ``lower``."""
    values = mix(np.arange(1, 257, dtype=U64) * U64(BASE) + U64(salt)) | U64(1)
    if lower:
        values[65:91] = values[97:123]
    return values


def space_table() -> np.ndarray:
    """True for the separators space and 0x09-0x0D."""
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


class Prefix:
    """Prefix sums of a polynomial over bytes: the hash of any substring in constant time."""

    def __init__(self, lower: bool = False, salt: int = 1):
        self.table = byte_table(lower, salt)
        self.power = self.inverse = np.ones(1, dtype=U64)

    def grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(n + 1, 1 << 20)
            self.power, self.inverse = (np.concatenate([np.ones(1, dtype=U64), np.cumprod(np.full(size, b, dtype=U64), dtype=U64)]) for b in (BASE, BASE_INVERSE))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data))
        out = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), lengths included."""
        raw = (sums[end] - sums[start]) * self.inverse[start]
        return mix(raw ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, int64 offsets (n + 1) and null mask of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    nulls = np.asarray(column.is_null())
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64), nulls
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if nulls.any():  # a null may cover bytes
        sizes = np.diff(offsets)
        if (sizes[nulls] > 0).any():
            keep = np.repeat(~nulls, sizes)
            sizes[nulls] = 0
            data, offsets = data[keep], np.concatenate([[0], np.cumsum(sizes)])
    return data, offsets, nulls


def release() -> None:
    """Give freed memory back to the system: workers are used again, and what one stage held is missing in the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def blocks(column: pa.Array, block_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets, nulls) for runs of rows."""
    data, offsets, nulls = flat(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], nulls[lo:hi]
        lo = hi
    release()


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and row numbers of the words; no word spans two rows."""
    n = len(data)
    if not n:
        return (np.zeros(0, dtype=np.int64),) * 3
    inside = ~separator[data]
    edge = np.zeros(n + 1, dtype=bool)  # a word can't go on across these
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def ngrams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n words from each word on that has n words of its row, and the positions of their first words."""
    if len(hashes) < n:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    last = len(hashes) - n + 1
    at = np.flatnonzero(row[:last] == row[n - 1 :])
    out = np.zeros(len(at), dtype=U64)
    for k in range(n):
        out = out * U64(0xD1342543DE82EF95) + hashes[at + k]
    return mix(out + U64(n)), at


def row_sets(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, by row and value."""
    if not len(values):
        return values, row
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[first], row[first]


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    if not len(sorted_keys):
        return (np.zeros(0, dtype=np.int64),) * 2
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return starts, np.concatenate([starts[1:], [len(sorted_keys)]])


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as first key, width of differences, and differences."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    small = steps.view(np.uint8).reshape(-1, 8)[:, :width] if len(steps) else np.zeros((0, width), np.uint8)
    return keys[:1].tobytes() + bytes([width]) + np.ascontiguousarray(small).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=U64)
    first, width = np.frombuffer(data, U64, 1), data[8]
    small = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(small), 8), dtype=np.uint8)
    steps[:, :width] = small
    return np.cumsum(np.concatenate([first, steps.reshape(-1).view(U64)]), dtype=U64)


def framed(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unframed(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out
