"""Whole texts to token ids with the tokenizers library, remembering pieces.

A byte-level BPE splits a text before it merges, and merges never cross a split. So a
text may be cut where a split always ends, whatever stands further left or right
(``piece_starts``), and pieces met before need no second encoding. Tokenizers set up in
another way get whole texts.

Pieces are found and looked up in NumPy, a chunk of text at a time, in a hash table
that compares whole pieces; memory is bounded by the chunk and the table, however long
a text is.
"""

from __future__ import annotations

import json
import os
import re
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa

from .textarrays import U64, flat, mix

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Pieces and splits that a Python worker remembers; later ones are encoded each time.
MOST_PIECES, MOST_SPLITS = 1 << 19, 150_000
#: Bytes of text that are looked up at once; bytes of the longest piece in the table.
CHUNK, SHORT = 1 << 20, 15
#: log2 of the table's slots, and how many a piece may try.
SLOTS, PROBES = 20, 8
#: What ASCII bytes are to the splitting pattern; OTHER is what isn't certain here.
BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[0x30:0x3A] = DIGIT
KIND[[*range(0x09, 0x0E), 0x20]] = BLANK
_ODD = re.compile("[\x1c-\x1f\x85]")
_encoders: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class _Packers(dict):
    """Number of ids to what packs them."""

    def __missing__(self, n: int):
        self[n] = out = struct.Struct(f"<{n}I").pack
        return out


class _Splits(dict):
    """Ids of a split, given as stand-in characters."""

    def __init__(self, model):
        self.tokenize = model.tokenize

    def __missing__(self, split: str) -> bytes:
        ids = [x.id for x in self.tokenize(split)]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < MOST_SPLITS:
            self[split] = out
        return out


def piece_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a split surely starts: before white space that follows none; all such places of one text.

    The second array adds where the kind of ASCII character changes and, after a single
    white-space character other than the space, where something else follows. An
    apostrophe may start a contraction and never ends a piece.
    """
    kind = KIND[data]
    blank = np.zeros(len(data), bool)
    blank[1:] = (kind[1:] == BLANK) & (kind[:-1] != BLANK) & ((data[:-1] < 0x1C) | (data[:-1] > 0x1F))
    at = np.flatnonzero(blank[1:] & (data[:-1] >= 0x80)) + 1
    if len(at):  # white space beyond ASCII
        x, y, z = data[at - 1], np.where(at >= 2, data[at - 2], 0), np.where(at >= 3, data[at - 3], 0)
        wide = (y == 0xC2) & ((x == 0x85) | (x == 0xA0)) | (z == 0xE1) & (y == 0x9A) & (x == 0x80) | (z == 0xE3) & (y == 0x80) & (x == 0x80)
        wide |= (z == 0xE2) & ((y == 0x80) & ((x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF)) | (y == 0x81) & (x == 0x9F))
        blank[at[wide]] = False
    known = (kind >= LETTER) & (kind <= SIGN)
    finer = blank.copy()
    finer[1:] |= known[1:] & known[:-1] & (kind[1:] != kind[:-1]) & (data[:-1] != 0x27)
    finer[1:] |= known[1:] & blank[:-1] & (data[:-1] != 0x20)
    return blank, finer


def _keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of at most SHORT bytes as two integers, the second with the size in its top byte. ``data`` has 16 bytes more."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    low = np.where(sizes >= 8, U64(2**64 - 1), (U64(1) << (sizes.clip(max=7) * 8).astype(np.uint64)) - U64(1))
    high = (U64(1) << ((sizes - 8).clip(0, 7) * 8).astype(np.uint64)) - U64(1)
    return eight[starts] & low, eight[starts + 8] & high | sizes.astype(np.uint64) << U64(56)


class _Table:
    """Known pieces: two-integer keys to places in ``pool``."""

    def __init__(self):
        self.one, self.two = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.uint64)  # sizes are never 0, so 0 is free
        self.entry = np.zeros(1 << SLOTS, np.int32)
        self.offset, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)
        self.n = self.used = 0

    def _slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return (mix(one ^ two * U64(0x9E3779B97F4A7C15)) >> U64(64 - SLOTS)).astype(np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where it isn't known."""
        out, slot, left = np.full(len(one), -1, np.int64), self._slots(one, two), np.arange(len(one))
        for _ in range(PROBES):
            has = self.two[slot]
            hit = (has == two[left]) & (self.one[slot] == one[left])
            out[left[hit]] = self.entry[slot[hit]]
            on = ~hit & (has != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << SLOTS) - 1)
            if not len(left):
                break
        return out

    def append(self, ids: list[bytes]) -> np.ndarray:
        """New entries, without keys."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        total = int(sizes.sum())
        while self.n + len(ids) > len(self.offset):
            self.offset, self.count = np.append(self.offset, np.zeros_like(self.offset)), np.append(self.count, np.zeros_like(self.count))
        while self.used + total > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.pool[self.used : self.used + total] = np.frombuffer(b"".join(ids), "<u4")
        new = np.arange(self.n, self.n + len(ids))
        self.offset[new], self.count[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.n, self.used = self.n + len(ids), self.used + total
        return new

    def put(self, one: np.ndarray, two: np.ndarray, entry: np.ndarray) -> None:
        """Remember new, distinct keys; those that find no slot are not remembered."""
        slot, left = self._slots(one, two), np.arange(len(one))
        for _ in range(PROBES):
            free = np.flatnonzero(self.two[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            chosen = free[first]
            at, who = slot[chosen], left[chosen]
            self.one[at], self.two[at], self.entry[at] = one[who], two[who], entry[who]
            left, slot = np.delete(left, chosen), (np.delete(slot, chosen) + 1) & ((1 << SLOTS) - 1)
            if not len(left):
                break

    def cut(self, n: int) -> None:
        """Forget the entries from ``n`` on; none of them has a key."""
        if n < self.n:
            self.n, self.used = n, int(self.offset[n])

    def gather(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries one after the other, and how many each has."""
        sizes = self.count[entry]
        ends = np.cumsum(sizes)
        at = np.repeat(self.offset[entry] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.pool[at], sizes


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        plan = json.loads(Path(path).read_text(encoding="utf-8"))
        split, model, added = plan.get("pre_tokenizer") or {}, plan["model"], plan.get("added_tokens", [])
        self.added = [x["content"] for x in added]
        self.by_piece = (
            plan.get("normalizer") is None
            and not plan.get("truncation")
            and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space")
            and split.get("use_regex", True)
            and model["type"] == "BPE"
            and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or re.search(r"\s", x["content"]) for x in added)
        )
        if self.by_piece:
            merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
            self.splits = _Splits(BPE(model["vocab"], merges, cache_capacity=0))
            self.tokenize = self.splits.tokenize
            self.pack = _Packers()
            self.table = _Table()
            self.find = regex.compile(PATTERN).findall
            self.stand_in = byte_characters()
            self.space = self.stand_in[32]

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, raw: bytes) -> bytes:
        body = raw[1:] if raw[:1] == b" " else raw
        if body.isalpha() or body.isdigit():
            found = self.tokenize(body.decode() if body is raw else self.space + body.decode())
            return self.pack[len(found)](*[x.id for x in found])
        text = raw.decode("utf-8", "replace")
        if _ODD.search(text) or any(x in text for x in self.added):
            return self._direct([text])[0]
        table = self.stand_in
        return b"".join([self.splits[x.encode().decode("latin-1").translate(table)] for x in self.find(text)])

    def _entries(self, data: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
        """Table entries of the pieces of ``data`` from each start to the next, the last to ``end``."""
        sizes = np.diff(starts, append=end)
        zero = int(starts[0])
        raw = data[zero:end].tobytes()
        padded = np.frombuffer(raw + bytes(16), np.uint8)
        starts = starts - zero
        out = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(sizes <= SHORT)
        one, two = _keys(padded, starts[short], sizes[short])
        out[short] = found = self.table.find(one, two)
        lost = np.flatnonzero(found < 0)
        if len(lost):
            order = lost[np.lexsort((one[lost], two[lost]))]
            new = np.append(True, (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]]))
            first = order[new]
            at = starts[short[first]]
            entry = self.table.append([self._piece(raw[a:b]) for a, b in zip(at.tolist(), (at + sizes[short[first]]).tolist())])
            room = max(0, MOST_PIECES - int(entry[0]))
            self.table.put(one[first[:room]], two[first[:room]], entry[:room])
            out[short[order]] = entry[np.cumsum(new) - 1]
        rest = np.flatnonzero(out < 0)
        if len(rest):  # pieces beyond SHORT
            known: dict[bytes, int] = {}
            named = [known.setdefault(raw[a:b], len(known)) for a, b in zip(starts[rest].tolist(), (starts[rest] + sizes[rest]).tolist())]
            out[rest] = self.table.append([self._piece(x) for x in known])[named]
        return out

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts data[offsets[i]:offsets[i + 1]] one after the other, and the n + 1 bounds of each text's."""
        if not self.by_piece:
            raw = data.tobytes()
            ids = [np.frombuffer(x, "<u4") for x in self._direct([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])]
            return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.append(0, np.cumsum([len(x) for x in ids], dtype=np.int64))
        bounds, parts, total = np.zeros(len(offsets), np.int64), [np.zeros(0, np.uint32)], 0
        a, n = 0, int(offsets[-1])
        while a < n:
            size = CHUNK
            while True:
                b = min(a + size, n)
                blank, finer = piece_starts(data[a:b])
                inside = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
                blank[inside] = finer[inside] = True
                blank[0] = finer[0] = True
                if b == n:
                    break
                last = len(blank) - 1 - int(blank[::-1].argmax())
                if last:
                    b, finer = a + last, finer[:last]
                    break
                size *= 2
            for token in self.added:
                at, raw, x = -1, data[a:b].tobytes(), token.encode()
                while (at := raw.find(x, at + 1)) >= 0:
                    finer[at + 1 : at + len(x)] = blank[at + 1 : at + len(x)]
            starts = np.flatnonzero(finer) + a
            kept = self.table.n
            ids, sizes = self.table.gather(self._entries(data, starts, b))
            self.table.cut(max(kept, min(self.table.n, MOST_PIECES)) if kept < MOST_PIECES else kept)
            lo, hi = np.searchsorted(offsets, [a, b])
            bounds[lo:hi] = total + np.append(0, np.cumsum(sizes))[np.searchsorted(starts, offsets[lo:hi])]
            parts.append(ids)
            total += len(ids)
            a = b
        bounds[offsets == n] = total
        return np.concatenate(parts), bounds

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode_flat of a text column; null is empty."""
        return self.encode_flat(*flat(column))

    def encode_ended(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """encode_column with the id ``end`` after each text."""
        ids, bounds = self.encode_column(column)
        return np.insert(ids, bounds[1:], end).astype("<u4", copy=False), bounds + np.arange(len(bounds))

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, bounds = self.encode_column(pa.array(texts, pa.large_string()))
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def encoder(path: str) -> Encoder:
    """This process's encoder for ``path``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
