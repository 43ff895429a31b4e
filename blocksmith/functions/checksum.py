"""CRC-32C (Castagnoli), many byte strings side by side in NumPy.

The register is linear: that of A B is that of A, moved on by as many zero bytes as B
has, XOR that of B from zero. So strings are cut into lanes of STRIDE bytes that are read
in step, and neighbouring lanes are joined, twice as long each time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Fixed value: the reflected Castagnoli polynomial.
POLYNOMIAL = 0x82F63B78
#: Bytes of a lane; a power of two.
STRIDE = 64
#: Bytes of a column that are handled at once.
MOST = 1 << 20


def _table() -> np.ndarray:
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, rows >> 1 ^ np.uint32(POLYNOMIAL), rows >> 1)
    return rows


TABLE = _table()
_BITS = np.uint32(1) << np.arange(32, dtype=np.uint32)


def _apply(images: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map that takes bit i to images[i], for each value of ``x``."""
    tables = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for bit in range(8):
            tables[place, 1 << bit : 2 << bit] = tables[place, : 1 << bit] ^ images[8 * place + bit]
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


def _lane_shift() -> np.ndarray:
    """Images of the map that moves a register on by STRIDE zero bytes."""
    images = _BITS >> np.uint32(8) ^ TABLE[_BITS & 255]
    for _ in range(STRIDE.bit_length() - 1):
        images = _apply(images, images)
    return images


LANE_SHIFT = _lane_shift()


def crc32c_many(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The CRC-32C of each data[offsets[i]:offsets[i + 1]]."""
    sizes = np.diff(offsets)
    lanes = (sizes + 4 + STRIDE - 1) // STRIDE
    ends = np.cumsum(lanes)
    # Zeros in front change nothing; four bytes of ones stand for the initial value, XORed into what follows.
    wide = np.zeros(int(lanes.sum()) * STRIDE, np.uint8)
    to = np.repeat(ends * STRIDE - sizes - offsets[:-1], sizes) + np.arange(int(offsets[0]), int(offsets[-1]))
    wide[to] = data[offsets[0] : offsets[-1]]
    short = np.flatnonzero(sizes < 4)
    full = np.flatnonzero(sizes >= 4)
    at = (ends * STRIDE - sizes)[full][:, None] + np.arange(4)
    wide[at] ^= 0xFF
    register = np.zeros(len(wide) // STRIDE, np.uint32)
    for column in wide.reshape(-1, STRIDE).T:
        register = register >> 8 ^ TABLE[(register ^ column) & 255]
    images, counts = LANE_SHIFT, lanes
    while len(counts) and counts.max() > 1:
        joined = (counts + 1) // 2
        stops, row = np.cumsum(counts), np.repeat(np.arange(len(joined)), joined)
        k = np.cumsum(joined)[row] - 1 - np.arange(len(row))  # from the row's last lane
        right = stops[row] - 1 - 2 * k
        left = right - 1
        has = left >= (stops - counts)[row]
        register = register[right] ^ np.where(has, _apply(images, register[np.maximum(left, 0)]), np.uint32(0))
        images, counts = _apply(images, images), joined
    out = register[np.cumsum(counts) - 1] ^ np.uint32(0xFFFFFFFF) if len(counts) else np.zeros(0, np.uint32)
    for i in short.tolist():
        state = 0xFFFFFFFF
        for byte in data[offsets[i] : offsets[i + 1]].tolist():
            state = state >> 8 ^ int(TABLE[(state ^ byte) & 255])
        out[i] = state ^ 0xFFFFFFFF
    return out


def crc32c(data: bytes) -> int:
    return int(crc32c_many(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0])


@F.pandas_udf(LongType())
def crc32c_column(values: pd.Series) -> pd.Series:
    """CRC-32C of a string (UTF-8) or binary column; null stays null."""
    parts = [b"" if x is None else x.encode() if isinstance(x, str) else bytes(x) for x in values]
    offsets = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int64)
    out, at = np.zeros(len(parts), np.int64), 0
    while at < len(parts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + MOST, "right")) - 1)
        out[at:stop] = crc32c_many(np.frombuffer(b"".join(parts[at:stop]), np.uint8), offsets[at : stop + 1] - offsets[at])
        at = stop
    return pd.Series(out, dtype="Int64").mask(values.isna().to_numpy())
