"""Arrow string columns as flat byte arrays, and words as spans over them.

Texts are never turned into one Python string each: a batch's UTF-8 bytes stay in one numpy
array, and words (or other spans) are start/end positions with a 64-bit hash. Whatever is a
function of a word alone is computed once per distinct word of a chunk and gathered back.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The six ASCII white-space bytes: tab, line feed, vertical tab, form feed, carriage return, space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK_BYTES = 1 << 22
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes, and the first word of each row (n + 1)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    begins[cut] = solid[cut]
    ends[cut - 1] = solid[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans are in order and may be of any length."""
    n, carry, scale, unscale = len(data), 0, 1, 1
    at_start, at_end = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    inverse = np.zeros(len(starts), np.uint64)
    for b in range(0, n, _BLOCK):
        block = data[b : b + _BLOCK]
        k = len(block)
        sums = np.zeros(k + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * _POW[:k], out=sums[1:])
        sums *= np.uint64(scale)
        sums += np.uint64(carry)
        i, j = np.searchsorted(starts, [b, b + k])
        at_start[i:j] = sums[starts[i:j] - b]
        inverse[i:j] = _INV[starts[i:j] - b] * np.uint64(unscale)
        i, j = np.searchsorted(ends, [b, b + k], "right")
        at_end[i:j] = sums[ends[i:j] - b]
        carry = int(sums[k])
        scale = scale * pow(_BASE, k, 1 << 64) & _MASK
        unscale = unscale * pow(_INVERSE, k, 1 << 64) & _MASK
    h = (at_end - at_start) * inverse
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of some occurrence of each distinct hash, and for each hash its number among them."""
    low = np.uint64((1 << max(1, len(hashes)).bit_length()) - 1)
    packed = np.sort((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64))  # far faster than an argsort
    order = (packed & low).astype(np.int64)
    ordered = hashes[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if (new[1:] & (packed[1:] & ~low == packed[:-1] & ~low)).any():  # hashes that differ in their low bits only
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(ordered), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each span, one span after the other."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    full = lengths > 0
    if total:
        at = np.cumsum(lengths[full])
        s, k = starts[full], lengths[full]
        out[0] = s[0]
        out[at[:-1]] = s[1:] - s[:-1] - k[:-1] + 1
    return np.cumsum(out)


def tidy() -> None:
    """Gives freed memory back to the system; a worker lives on through later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of each span."""
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
