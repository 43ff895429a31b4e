"""Whole texts as flat byte arrays: words, word hashes and shingle hashes in NumPy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Separators of words: space and the control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, odd multipliers and their inverses modulo 2**64.
BYTE = _random.integers(0, 2**64, 256, dtype=np.uint64)
BASE = int(_random.integers(0, 2**63)) * 2 + 1
INVERSE = pow(BASE, -1, 2**64)
PLACES = [U64(int(_random.integers(0, 2**63)) * 2 + 1) for _ in range(64)]

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, kind: str = "up") -> np.ndarray:
    """BASE**i (or its inverse) modulo 2**64 for i < n."""
    if len(_powers[kind]) < n:
        step = np.full(n + n // 4, BASE if kind == "up" else INVERSE, np.uint64)
        step[0] = 1
        _powers[kind] = np.multiply.accumulate(step)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


#: Bytes of text that are handled at once.
MOST = 1 << 20


def slices(column: pa.Array | pa.ChunkedArray, most: int = MOST) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` text bytes, or of one longer text."""
    if len(column) == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        limit = (ends[start - 1] if start else 0) + most
        stop = max(start + 1, int(np.searchsorted(ends, limit, "right")))
        yield start, stop
        start = stop


def segments(column: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """The column itself, or, of one text much longer than ``most`` bytes, arrays of one part each, cut before separators."""
    most = most or MOST
    data, offsets = flat(column) if len(column) == 1 else (None, None)
    if data is None or len(data) <= 2 * most:
        yield column
        return
    at = 0
    while at < len(data):
        stop = min(at + most, len(data))
        while stop < len(data):  # on to the next separator
            found = np.flatnonzero(SPACE[data[stop : stop + most]])
            stop = stop + int(found[0]) if len(found) else min(stop + most, len(data))
            if len(found):
                break
        yield pa.array([data[at:stop].tobytes()], pa.large_binary())
        at = stop


def release() -> None:
    """Give freed memory back to the system; a worker that waits for its next task should not hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def flat(column: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty), each followed by ``end``, and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if end:
        column = pc.binary_join_element_wise(column, pa.scalar(b"", pa.large_binary()), pa.scalar(end, pa.large_binary()))
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat bytes, start and end of each word, and the n + 1 bounds of the documents' words."""
    data, offsets = flat(column, b"\n")
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 1, np.int8)
    np.logical_not(SPACE[data], out=inside[1:].view(bool))
    turn = np.diff(inside, append=np.int8(0))
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    return data, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(data), "down")[starts])


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lowered, and the n + 1 bounds of the documents' words; a long text in segments."""
    hashes, counts = [], None
    for part in segments(column):
        data, starts, ends, bounds = words(part)
        hashes.append(word_hashes(data, starts, ends))
        counts = np.diff(bounds) + (0 if counts is None else counts)
    return np.concatenate(hashes), np.append(0, np.cumsum(counts))


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct hashes of k successive words, or of all its words if fewer."""
    hashes, bounds = hashed_words(column)
    n = len(hashes)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k if n >= k else 0):
        rolled += hashes[j : n - k + 1 + j] * PLACES[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            one = np.sort(rolled[a : b - k + 1])
            keep = np.ones(len(one), bool)
            np.not_equal(one[1:], one[:-1], out=keep[1:])
            out.append(one[keep])
        elif b > a:
            short = (hashes[a:b] * np.array(PLACES[: b - a])).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + PLACES[k + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
