"""The byte layer: bit algorithms, chunks, container, and what is wrong with broken files."""

import io
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blocksmith.functions.checksum import crc32c
from blocksmith.plans import measure, workloads
from blocksmith.sources import bits
from blocksmith.sources.chunks import decode_chunk, encode_chunk
from blocksmith.sources.container import BlockReader, BlockWriter, Metadata, encode_footer, encode_trailer, validate
from blocksmith.sources.errors import BlockOutOfRange, ChecksumMismatch, InvalidMagic, InvalidMetadata, NumberOverflow, SchemaChanged, UnexpectedEnd

I64 = 2**63


def stored(*arrays, names=None):
    names = names or [f"c{i}" for i in range(len(arrays))]
    batch = pa.record_batch(list(arrays), names)
    stream = io.BytesIO()
    writer = BlockWriter(stream, batch.schema)
    writer.write_batch(batch)
    return batch, writer.finish().getvalue()


def chunk(array):
    field = pa.field("x", array.type)
    codec, data = encode_chunk(field, array)
    back = decode_chunk(field, codec, data, len(array))
    assert back.type == array.type and str(back) == str(array)
    return codec, data


def test_crc32c_check_value():
    assert crc32c(b"123456789") == 0xE3069283


@pytest.mark.parametrize("width", range(65))
def test_packing_every_width(width):
    most = 2**width - 1
    values = np.array([0, most // 3, most], np.uint64)
    assert (bits.unpack(bits.pack(values, width), 3, width) == values).all()


@pytest.mark.parametrize(
    ("values", "tag", "payload"),
    [([7] * 100, 1, 0), ([k * 1000 for k in range(100)], 3, 0), ([-I64, 0, I64 - 1], 0, 24), ([10, -10, 10, -10, 10], 2, 3), ([5], 1, 0), ([1, 9], 3, 0), ([10, None, 30], 3, 1)],
)
def test_integer_choice(values, tag, payload):
    _, data = chunk(pa.array(values, pa.int64()))
    assert data[0] == tag
    valid = 2 if None in values else 1
    assert len(data) == (1, 10, 10, 18)[tag] + valid + payload


@pytest.mark.parametrize("kind", [pa.int8(), pa.int16(), pa.int32(), pa.int64(), pa.uint8(), pa.uint16(), pa.uint32(), pa.uint64()])
def test_integer_extremes(kind):
    signed = pa.types.is_signed_integer(kind)
    low, high = (-(2 ** (kind.bit_width - 1)), 2 ** (kind.bit_width - 1) - 1) if signed else (0, 2**kind.bit_width - 1)
    chunk(pa.array([low, 0, None, high], kind))


def test_floats_keep_their_bits():
    for kind in (pa.float32(), pa.float64()):
        assert chunk(pa.array([1.5, -0.0, None, float("inf")], kind))[1][0] == 0
        assert chunk(pa.array([1 + k * 1e-9 for k in range(300)], kind))[1][0] == 1
    odd = pa.Array.from_buffers(pa.float64(), 2, [None, pa.py_buffer(struct.pack("<QQ", 0x7FF8000000000001, 0xFFF0000000000002))])
    field = pa.field("x", odd.type)
    assert decode_chunk(field, *encode_chunk(field, odd), 2).buffers()[1].to_pybytes() == odd.buffers()[1].to_pybytes()
    chunk(pa.array(np.array([1, 2, -0.0], np.float16)))


@pytest.mark.parametrize(("rows", "mode"), [(5, 0), (10, 0), (11, 0), (17, 2), (151, 2), (189, 2), (190, 1), (191, 1), (192, 2), (193, 1)])
def test_constant_booleans(rows, mode):
    assert chunk(pa.array([True] * rows))[1][0] == mode


def test_bca_pattern_is_small():
    _, data = chunk(pa.array([[True, False, True][i % 3] for i in range(237)]))
    assert data[0] == 2 and len(data) == 2 + 5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.booleans()), min_size=1, max_size=200))
def test_booleans(values):
    chunk(pa.array(values, pa.bool_()))
    plain = np.array([bool(x) for x in values], np.uint8)
    assert (bits.bca_decode(bits.bca_encode(plain), len(plain)) == plain).all()
    assert (bits.rle_decode(bits.rle_encode(plain), len(plain)) == plain).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-I64, I64 - 1), st.integers(-9, 9)), min_size=1, max_size=60))
def test_integers(values):
    chunk(pa.array(values, pa.int64()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=5)), min_size=1, max_size=60))
def test_strings(values):
    chunk(pa.array(values, pa.string()))
    chunk(pa.array(values, pa.large_string()))


@pytest.mark.parametrize("entries", [256, 257, 65_537])
def test_dictionary_index_widths(entries):
    words = [f"entry number {i}" for i in range(entries)]
    _, data = chunk(pa.array(words * 4))
    at = 2 + 4 + sum(8 + len(w) for w in words)
    assert data[0] == 1 and data[at] == {256: 1, 257: 2, 65_537: 4}[entries]


def test_string_fixtures():
    assert len(chunk(pa.array(["alpha", None, "alpha", "beta"]))[1]) == 1 + 2 + 34
    assert len(chunk(pa.array(["a long value", "another", "a long value", "unique"], pa.large_string()))[1]) == 1 + 1 + 58


def test_ipc_for_all_other_types():
    for array in (pa.array([1, 2, 3], pa.date32()), pa.array([[1], None]), pa.array([{"a": 1}]), pa.array([None, 5], pa.timestamp("us")), pa.array([1], pa.decimal128(9, 2))):
        assert chunk(array)[0] == 255


def test_blocks_and_random_access():
    schema = pa.schema([pa.field("id", pa.int64(), False), ("reading", pa.int64())])
    stream = io.BytesIO()
    writer = BlockWriter(stream, schema)
    parts = [pa.record_batch([pa.array([1, 2, 3]), pa.array([10, None, 30])], schema=schema), pa.record_batch([pa.array([4, 5]), pa.array([None, None], pa.int64())], schema=schema)]
    writer.write_batch(parts[0])
    writer.write_batch(parts[0].slice(0, 0))
    writer.write_batch(parts[1])
    with pytest.raises(SchemaChanged):
        writer.write_batch(pa.record_batch([pa.array([1])], ["id"]))
    reader = BlockReader(writer.finish())
    assert reader.schema == schema and reader.num_batches == 2
    assert reader.read_batch(1).equals(parts[1]) and reader.read_batch(0).equals(parts[0])
    assert reader.read_batch(0, ["reading"]).schema.names == ["reading"]
    with pytest.raises(BlockOutOfRange):
        reader.read_batch(2)


def test_no_blocks_still_have_a_schema():
    stream = BlockWriter(io.BytesIO(), pa.schema([("a", pa.string())])).finish()
    assert BlockReader(stream).schema.names == ["a"] and BlockReader(stream).num_batches == 0


def broken(data, at, by):
    return data[:at] + by + data[at + len(by) :]


def test_broken_files():
    _, data = stored(pa.array([1, 5, 2]))
    size = struct.unpack("<Q", data[-16:-8])[0]
    cases = [
        (data[:10], UnexpectedEnd), (broken(data, 4, b"\2"), InvalidMagic), (broken(data, len(data) - 4, b"X"), InvalidMagic), (broken(data, len(data) - 8, b"\0\0\0\0"), ChecksumMismatch),
        (broken(data, len(data) - 16, struct.pack("<Q", 10**6)), InvalidMetadata), (broken(data, len(data) - 20, b"\xff"), ChecksumMismatch),
    ]
    for bad, error in cases:
        with pytest.raises(error):
            BlockReader(io.BytesIO(bad))
        assert error.__name__ in validate(io.BytesIO(bad))
    footer = data[-16 - size : -16] + b"\0"
    with pytest.raises(InvalidMetadata):
        BlockReader(io.BytesIO(data[: -16 - size] + footer + encode_trailer(footer)))
    meta = BlockReader(io.BytesIO(data)).meta
    meta.blocks[0].chunks[0].codec = 9
    footer = encode_footer(Metadata(meta.schema, meta.blocks))
    bad = data[: -16 - size] + footer + encode_trailer(footer)
    assert "unknown codec" in validate(io.BytesIO(bad), chunks=True) and validate(io.BytesIO(bad)) is None
    assert validate(io.BytesIO(data), chunks=True) is None


def test_broken_chunks():
    field = pa.field("x", pa.int64())
    _, data = encode_chunk(field, pa.array([1, 5, 2, 9]))
    for bad in (data[:-1], data + b"\0", b"\7" + data[1:], b""):
        with pytest.raises((InvalidMetadata, UnexpectedEnd)):
            decode_chunk(field, 1, bad, 4)
    wide = struct.pack("<BqB", 1, 0, 65) + b"\0" + bytes(33)
    with pytest.raises(InvalidMetadata):
        decode_chunk(field, 1, wide, 4)
    over = struct.pack("<BqB", 2, I64 - 1, 2) + b"\0" + bits.pack(np.array([2], np.uint64), 2)
    with pytest.raises(NumberOverflow):
        decode_chunk(field, 1, over, 2)
    with pytest.raises(InvalidMetadata):
        decode_chunk(field, 4, data, 4)
    with pytest.raises(InvalidMetadata):
        bits.rle_decode(b"", 1)
    with pytest.raises(InvalidMetadata):
        bits.bca_decode(b"\0\0", 3)


def test_comparison_table_and_measure():
    table = workloads.sequence_table(2000)
    assert table.num_rows == 2000 and table.column("event_time")[1].as_py() == 1735689601000
    rows = measure.compare(table, block_rows=500, samples=2)
    assert [r["format"] for r in rows] == ["blocks", "parquet"] and all(r["bytes"] > 0 for r in rows)
