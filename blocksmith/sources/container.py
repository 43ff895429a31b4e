"""The container: header, chunks, footer, trailer."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import pyarrow as pa

from ..functions.checksum import crc32c
from .chunks import Cursor, decode_chunk, encode_chunk
from .errors import BlockOutOfRange, ChecksumMismatch, InvalidMagic, InvalidMetadata, NumberOverflow, SchemaChanged, StorageError, UnexpectedEnd

#: Fixed values of the format.
HEADER = b"LTAR\x01\x00\x00\x00"
MAGIC = b"LTAR"
TRAILER = struct.Struct("<QI4s")
CHUNK = struct.Struct("<BQQ")
MOST_U32 = 2**32 - 1


@dataclass
class Chunk:
    codec: int
    offset: int
    length: int


@dataclass
class Block:
    rows: int
    chunks: list[Chunk]


@dataclass
class Metadata:
    schema: pa.Schema
    blocks: list[Block] = field(default_factory=list)


def encode_schema(schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    pa.ipc.new_stream(sink, schema).close()
    return sink.getvalue().to_pybytes()


def decode_schema(data: bytes) -> pa.Schema:
    try:
        return pa.ipc.open_stream(data).schema
    except pa.ArrowInvalid as e:
        raise InvalidMetadata(f"schema: {e}") from e


def encode_footer(meta: Metadata) -> bytes:
    schema = encode_schema(meta.schema)
    if max(len(schema), len(meta.blocks), *[b.rows for b in meta.blocks], 0) > MOST_U32:
        raise NumberOverflow("a count leaves 32 bits")
    out = [struct.pack("<I", len(schema)), schema, struct.pack("<II", len(meta.schema), len(meta.blocks))]
    for block in meta.blocks:
        out.append(struct.pack("<I", block.rows))
        out += [CHUNK.pack(c.codec, c.offset, c.length) for c in block.chunks]
    return b"".join(out)


def decode_footer(data: bytes) -> Metadata:
    cursor = Cursor(data)
    schema = decode_schema(bytes(cursor.take(cursor.number("I"))))
    fields, blocks = cursor.number("I"), cursor.number("I")
    if fields != len(schema):
        raise InvalidMetadata("field count differs from the schema")
    meta = Metadata(schema)
    for _ in range(blocks):
        rows = cursor.number("I")
        meta.blocks.append(Block(rows, [Chunk(*CHUNK.unpack(cursor.take(CHUNK.size))) for _ in range(fields)]))
    if cursor.rest():
        raise InvalidMetadata("trailing footer bytes")
    return meta


def encode_trailer(footer: bytes) -> bytes:
    return TRAILER.pack(len(footer), crc32c(footer), MAGIC)


def decode_trailer(data: bytes) -> tuple[int, int]:
    length, crc, magic = TRAILER.unpack(data)
    if magic != MAGIC:
        raise InvalidMagic("trailer")
    return length, crc


class BlockWriter:
    """Writes blocks to a binary stream; only what ``finish`` ended is a file. ``each`` maps over columns, in order, and may do so in threads."""

    def __init__(self, stream, schema: pa.Schema, each=map):
        self.stream, self.meta, self.at, self.each = stream, Metadata(schema), len(HEADER), each
        stream.write(HEADER)

    def write_batch(self, batch: pa.RecordBatch) -> None:
        if not batch.schema.equals(self.meta.schema, check_metadata=True):
            raise SchemaChanged("record batch schema changed")
        if not len(batch):
            return
        block = Block(len(batch), [])
        for codec, data in self.each(encode_chunk, batch.schema, batch.columns):
            self.stream.write(data)
            block.chunks.append(Chunk(codec, self.at, len(data)))
            self.at += len(data)
        self.meta.blocks.append(block)

    def finish(self):
        footer = encode_footer(self.meta)
        self.stream.write(footer)
        self.stream.write(encode_trailer(footer))
        return self.stream


def _read_at(stream, at: int, n: int) -> bytes:
    stream.seek(at)
    data = stream.read(n)
    if len(data) != n:
        raise UnexpectedEnd("file ends early")
    return data


def read_block(stream, schema: pa.Schema, block: Block, columns: list[str] | None = None, each=map) -> pa.RecordBatch:
    """A block whose places are known; ``columns`` names those to read, ``each`` maps over them."""
    wanted = [(item, chunk) for item, chunk in zip(schema, block.chunks) if columns is None or item.name in columns]
    data = [_read_at(stream, chunk.offset, chunk.length) for _, chunk in wanted]
    arrays = each(lambda one, part: decode_chunk(one[0], one[1].codec, part, block.rows), wanted, data)
    return pa.record_batch(list(arrays), schema=pa.schema([item for item, _ in wanted]))


class BlockReader:
    """Reads the footer at once and chunks when asked. ``stream`` is seekable."""

    def __init__(self, stream, each=map):
        self.stream, self.each = stream, each
        size = stream.seek(0, 2)
        size = stream.tell() if size is None else size
        if size < len(HEADER) + TRAILER.size:
            raise UnexpectedEnd("file is too short")
        if self._read(0, len(HEADER)) != HEADER:
            raise InvalidMagic("header")
        length, crc = decode_trailer(self._read(size - TRAILER.size, TRAILER.size))
        if length > size - len(HEADER) - TRAILER.size:
            raise InvalidMetadata("footer is longer than the file")
        self.end = size - TRAILER.size - length
        footer = self._read(self.end, length)
        if crc32c(footer) != crc:
            raise ChecksumMismatch("footer")
        self.meta = decode_footer(footer)

    def _read(self, at: int, n: int) -> bytes:
        return _read_at(self.stream, at, n)

    @property
    def schema(self) -> pa.Schema:
        return self.meta.schema

    @property
    def num_batches(self) -> int:
        return len(self.meta.blocks)

    def read_batch(self, index: int, columns: list[str] | None = None) -> pa.RecordBatch:
        """One block; ``columns`` names those to read."""
        if not 0 <= index < self.num_batches:
            raise BlockOutOfRange(f"block {index} of {self.num_batches}")
        block = self.meta.blocks[index]
        if any(c.offset < len(HEADER) or c.offset + c.length > self.end for c in block.chunks):
            raise InvalidMetadata("chunk lies outside the data")
        return read_block(self.stream, self.schema, block, columns, self.each)

    def read_all(self) -> pa.Table:
        return pa.Table.from_batches([self.read_batch(i) for i in range(self.num_batches)], self.schema)


def validate(stream, chunks: bool = False) -> str | None:
    """None for a sound file, else what is wrong; ``chunks`` decodes every block too."""
    try:
        reader = BlockReader(stream)
        for i in range(reader.num_batches if chunks else 0):
            reader.read_batch(i)
    except StorageError as e:
        return f"{type(e).__name__}: {e}"
    return None
