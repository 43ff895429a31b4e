"""The profile layer agrees with the byte layer and with derived sizes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from blocksmith.operators import booleans, floats, integers
from blocksmith.plans import profile, workloads
from blocksmith.sources.chunks import encode_chunk


def frame(spark, values, kind):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], f"block_id long, pos long, v {kind}")


def test_integer_profiles_match_chunks(spark):
    i64 = 2**63
    r = np.random.default_rng(5)
    cases = [[7] * 100, list(range(0, 5000, 50)), [-i64, 0, i64 - 1], [10, -10, 10, -10, 10], [5], [1, 9], [-i64, i64 - 1], r.integers(-(2**62), 2**62, 50).tolist(), np.cumsum(r.integers(0, 9, 80)).tolist()]
    for values in cases:
        df = frame(spark, values, "long")
        got = integers.integer_profile(df, "v").first()
        assert got["chunk_bytes"] + 1 == len(encode_chunk(pa.field("v", pa.int64()), pa.array(values, pa.int64()))[1]), values
        assert [x["v"] for x in integers.for_decode(integers.for_encode(df, "v")).orderBy("pos").collect()] == values
        for width, encode, decode in (("delta_width", integers.delta_encode, integers.delta_decode), ("dod_width", integers.dod_encode, integers.dod_decode)):
            assert [x["v"] for x in decode(encode(df, "v")).orderBy("pos").collect()] == (values if got[width] is not None else [None] * len(values))


def test_wide_offsets_are_unsigned(spark):
    rows = integers.for_encode(frame(spark, [-(2**63), 0, 2**63 - 1], "long"), "v").orderBy("pos").collect()
    assert [x["offset"] for x in rows] == [0, -(2**63), -1] and rows[0]["width"] == 64


def test_float_and_boolean_profiles_match_chunks(spark):
    for values in ([1 + k * 1e-9 for k in range(200)], [0.0, -0.0, 3.5]):
        got = floats.float_profile(frame(spark, values, "double"), floats.double_bits("v")).first()
        assert got["chunk_bytes"] + 1 == len(encode_chunk(pa.field("v", pa.float64()), pa.array(values))[1])
    for values in ([True] * 100, [True] * 400, [k % 3 == 0 for k in range(60)], [k * k % 7 < 3 for k in range(60)]):
        got = booleans.boolean_profile(frame(spark, values, "boolean"), "v").first()
        assert got["chunk_bytes"] + 1 == len(encode_chunk(pa.field("v", pa.bool_()), pa.array(values))[1])


def test_workload_sizes(spark):
    want = {"telemetry": 587_574, "random-i64": 4_800_012, "mixed-arrow": 1_087_593}
    for name, make in workloads.WORKLOADS.items():
        assert profile.table_profile(make(spark, 100_000, 100_000)).agg(F.sum("chunk_bytes")).first()[0] == want[name]


def test_table_profile_matches_chunks_of_every_type(spark):
    """Nulls, empty strings, unsigned and short floats, over blocks of different sizes."""
    import decimal

    r = np.random.default_rng(3)
    n = 230
    odd = lambda xs, k: [None if i % k == 1 else x for i, x in enumerate(xs)]
    columns = {
        "i": (pa.int32(), "int", odd(r.integers(-9, 9, n).tolist(), 4)), "u": (pa.uint64(), "decimal(20,0)", odd([2**64 - 1 - 3 * k for k in range(n)], 7)), "t": (pa.int64(), "long", [5 * k for k in range(n)]),
        "h": (pa.float16(), "float", odd([float(np.float16(x)) for x in r.normal(0, 1, n)], 5)), "f": (pa.float32(), "float", odd([float(np.float32(1 + k * 1e-6)) for k in range(n)], 6)), "d": (pa.float64(), "double", [1 + k * 1e-9 for k in range(n)]),
        "b": (pa.bool_(), "boolean", odd([k % 3 == 0 for k in range(n)], 50)), "s": (pa.string(), "string", odd(["", "yes", "no"] * 76 + ["", "x"], 9)), "l": (pa.large_string(), "string", [f"v{k}" for k in range(n)]), "z": (pa.string(), "string", [None] * n),
    }
    rows = [(k // 100, k, *[decimal.Decimal(v[2][k]) if c == "u" and v[2][k] is not None else v[2][k] for c, v in columns.items()]) for k in range(n)]
    df = spark.createDataFrame(rows, "block_id long, pos long, " + ", ".join(f"{c} {v[1]}" for c, v in columns.items()))
    got = {(x["column_name"], x["block_id"]): x for x in profile.table_profile(df, stored={"u": "uint64", "h": "float16", "l": "large_string"}).collect()}
    for c, (kind, _, values) in columns.items():
        for b in range(3):
            part = values[100 * b : 100 * b + 100]
            array = pa.array([None if x is None else np.float16(x) for x in part], kind) if c == "h" else pa.array(part, kind)
            assert (got[c, b]["chunk_bytes"], got[c, b]["n"]) == (len(encode_chunk(pa.field(c, kind), array)[1]), len(part)), (c, b)
    assert len(got) == 30


def test_differences_at_the_ends_of_64_bits(spark):
    from blocksmith.functions.bits import difference

    ends = [-(2**63), -(2**63) + 1, -(2**62) - 1, -(2**62), -1, 0, 1, 2**62 - 1, 2**62, 2**62 + 1, 2**63 - 2, 2**63 - 1, None]
    rows = spark.createDataFrame([(a, b) for a in ends for b in ends], "a long, b long").select("a", "b", difference("a", "b").alias("d"), difference("b", "a").alias("e")).collect()
    fits = lambda x: x if -(2**63) <= x < 2**63 else None
    assert all((r["d"], r["e"]) == ((None, None) if None in (r["a"], r["b"]) else (fits(r["a"] - r["b"]), fits(r["b"] - r["a"]))) for r in rows)
