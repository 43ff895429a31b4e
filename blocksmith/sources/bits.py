"""Bit algorithms of the byte layer, in NumPy."""

from __future__ import annotations

import numpy as np

from .errors import InvalidMetadata, NumberOverflow

RAW, FOR, DELTA, DOD = range(4)
U1, U63 = np.uint64(1), np.uint64(63)


def bit_length(x) -> int:
    return int(x).bit_length()


def packed_length(n: int, width: int) -> int:
    return (n * width + 7) // 8


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned 64-bit values in ``width`` bits each, lowest bit first.

    Eight values fill ``width`` bytes, so each of the eight has the same place in all such groups.
    """
    values = np.ascontiguousarray(values, "<u8")
    n = len(values)
    if width % 8 == 0:
        return values.view(np.uint8).reshape(-1, 8)[:, : width // 8].tobytes()
    groups = (n + 7) // 8
    out = np.zeros((groups, width), np.uint8)
    for k in range(8):
        byte, shift = k * width >> 3, k * width & 7
        words = values[k::8] << np.uint64(shift)
        used = min(8, (width + shift + 7) // 8)
        out[: len(words), byte : byte + used] |= words.view(np.uint8).reshape(-1, 8)[:, :used]
        if width + shift > 64:
            out[: len(words), byte + 8] |= (values[k::8] >> np.uint64(64 - shift)).astype(np.uint8)
    return out.tobytes()[: packed_length(n, width)]


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    """``n`` values of ``width`` bits: the eight bytes at each value's first byte, moved down, and what a ninth byte adds."""
    if width > 64 or len(data) != packed_length(n, width):
        raise InvalidMetadata("packed values have the wrong length")
    if not width or not n:
        return np.zeros(n, np.uint64)
    if width == 64:
        return np.frombuffer(data, "<u8").astype(np.uint64)
    groups = (n + 7) // 8
    padded = bytes(data) + bytes(groups * width - len(data) + 16)
    out, mask = np.empty(groups * 8, np.uint64), np.uint64((1 << width) - 1)
    words = np.empty(groups, np.uint64)
    for k in range(8):
        byte, shift = k * width >> 3, k * width & 7
        np.right_shift(np.ndarray(groups, "<u8", padded, byte, (width,)), np.uint64(shift), out=words)
        if width + shift > 64:
            words |= np.ndarray(groups, np.uint8, padded, byte + 8, (width,)).astype(np.uint64) << np.uint64(64 - shift)
        np.bitwise_and(words, mask, out=out[k::8])
    return out[:n]


def zigzag(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) << 1 ^ x >> 63).view(np.uint64)


def unzigzag(z: np.ndarray) -> np.ndarray:
    return ((z >> U1) ^ (np.uint64(0) - (z & U1))).view(np.int64)


def _differences(x: np.ndarray) -> np.ndarray | None:
    """None if one leaves 64 bits."""
    with np.errstate(over="ignore"):
        d = x[1:] - x[:-1]
    return None if (((x[1:] ^ x[:-1]) & (x[1:] ^ d)) < 0).any() else d


def _sums(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        s = np.cumsum(x, dtype=np.int64)
    if max(abs(int(x.min())), abs(int(x.max()))) * len(x) < 2**63:
        return s
    if (((s[:-1] ^ s[1:]) & (x[1:] ^ s[1:])) < 0).any():
        raise NumberOverflow("a sum of differences leaves 64 bits")
    return s


def integer_encode(x: np.ndarray) -> tuple[int, tuple[int, ...], int, bytes]:
    """(tag, header values, width, payload) of the smallest payload; ties go to the lower tag."""
    n, low = len(x), int(x.min())
    offsets = x.view(np.uint64) - np.int64(low).view(np.uint64)
    sizes = {RAW: 8 * n, FOR: packed_length(n, w0 := bit_length(offsets.max()))}
    w1 = w2 = 0
    d = _differences(x)
    dd = None if d is None else _differences(d)
    if d is not None:
        w1 = bit_length(zigzag(d).max()) if len(d) else 0
        sizes[DELTA] = packed_length(max(n - 1, 0), w1)
    if dd is not None:
        w2 = bit_length(zigzag(dd).max()) if len(dd) else 0
        sizes[DOD] = packed_length(max(n - 2, 0), w2)
    tag = min(sizes, key=lambda k: (sizes[k], k))
    if tag == RAW:
        return tag, (), 64, x.astype("<i8").tobytes()
    if tag == FOR:
        return tag, (low,), w0, pack(offsets, w0)
    if tag == DELTA:
        return tag, (int(x[0]),), w1, pack(zigzag(d), w1)
    return tag, (int(x[0]), int(d[0]) if len(d) else 0), w2, pack(zigzag(dd), w2)


def integer_decode(tag: int, head: tuple[int, ...], width: int, data: bytes, n: int) -> np.ndarray:
    if tag == RAW:
        if len(data) != 8 * n:
            raise InvalidMetadata("raw integers have the wrong length")
        return np.frombuffer(data, "<i8")
    if tag == FOR:
        out = unpack(data, n, width)
        out += np.int64(head[0]).view(np.uint64)
        out = out.view(np.int64)
        if head[0] + (1 << width) > 2**63 and (out < head[0]).any():
            raise NumberOverflow("an offset leaves 64 bits")
        return out
    if tag == DELTA:
        return _sums(np.concatenate([np.array(head[:1], np.int64), unzigzag(unpack(data, max(n - 1, 0), width))]))[:n]
    if not width and not len(data) and -(2**63) <= head[0] + head[1] * (n - 1) < 2**63:
        return np.arange(n, dtype=np.int64) * np.int64(head[1]) + np.int64(head[0])
    changes = unzigzag(unpack(data, max(n - 2, 0), width))
    steps = _sums(np.concatenate([np.array(head[1:], np.int64), changes]))
    return _sums(np.concatenate([np.array(head[:1], np.int64), steps]))[:n]


def xor_encode(words: np.ndarray, byte_width: int) -> tuple[int, bytes] | None:
    """(width, payload) of successive XORs if they are smaller than the words, else None."""
    x = words[1:] ^ words[:-1]
    width = bit_length(x.max()) if len(x) else 0
    return (width, pack(x, width)) if packed_length(len(x), width) + byte_width + 1 < len(words) * byte_width else None


def xor_decode(first: int, width: int, data: bytes, n: int) -> np.ndarray:
    rest = unpack(data, max(n - 1, 0), width)
    return np.bitwise_xor.accumulate(np.concatenate([np.array([first], np.uint64), rest]))[:n]


def rle_encode(bits: np.ndarray) -> bytes:
    """First bit as a byte, then the run lengths as u32."""
    if not len(bits):
        return b""
    edges = np.flatnonzero(np.diff(bits)) + 1
    runs = np.diff(np.concatenate([[0], edges, [len(bits)]]))
    return bytes([int(bits[0])]) + runs.astype("<u4").tobytes()


def rle_decode(data: bytes, n: int) -> np.ndarray:
    if not data or data[0] > 1 or (len(data) - 1) % 4:
        raise InvalidMetadata("invalid runs")
    runs = np.frombuffer(data, "<u4", offset=1).astype(np.int64)
    if runs.sum() != n:
        raise InvalidMetadata("runs don't fill the column")
    return np.repeat((np.arange(len(runs)) + data[0]) % 2, runs).astype(np.uint8)


#: Fixed values of a BCA block: flag of a pattern, pattern size, fewest and most repeats, literal bits.
PATTERN_FLAG, PATTERN, LEAST, MOST, LITERAL = 0x80, 3, 3, 16, 7


def bca_encode(bits: np.ndarray, most: int | None = None) -> bytes | None:
    """Greedy blocks of a byte: a repeated three-bit pattern where it repeats three times or more, else literals; None once there are over ``most``."""
    n = len(bits)
    same = np.zeros(n, np.int64)  # how far each bit equals the one three before it, on and on
    equal = bits[: max(n - PATTERN, 0)] == bits[PATTERN:]
    breaks = np.append(np.flatnonzero(~equal), len(equal))
    at = np.arange(len(equal))
    same[: len(equal)] = breaks[np.searchsorted(breaks, at)] - at
    repeats = np.minimum(MOST, 1 + same // PATTERN)
    repeats[max(n - PATTERN + 1, 0) :] = 0
    pattern = repeats >= LEAST
    ahead = np.concatenate([bits.astype(np.uint8), np.zeros(LITERAL, np.uint8)])
    literal = sum(ahead[k : n + k] << np.uint8(k) for k in range(LITERAL))
    flagged = sum(ahead[k : n + k] << np.uint8(4 + k) for k in range(PATTERN)) | PATTERN_FLAG | (repeats - 1).astype(np.uint8)
    after, i, path = (np.arange(n) + np.where(pattern, repeats * PATTERN, LITERAL)).tolist(), 0, []
    while i < n:
        path.append(i)
        i = after[i]
        if most is not None and len(path) > most:
            return None
    return np.where(pattern, flagged, literal)[path].astype(np.uint8).tobytes() if n else b""


def bca_decode(data: bytes, n: int) -> np.ndarray:
    out: list[int] = []
    for byte in data:
        if len(out) >= n:
            raise InvalidMetadata("a block too many")
        if byte & PATTERN_FLAG:
            out += [byte >> 4 + k & 1 for k in range(PATTERN)] * ((byte & 15) + 1)
        else:
            out += [byte >> k & 1 for k in range(min(LITERAL, n - len(out)))]
    if len(out) != n:
        raise InvalidMetadata("blocks don't fill the column")
    return np.array(out, np.uint8)
