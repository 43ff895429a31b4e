"""Codec choice for the columns of a table, and the size of the table in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bits import difference, packed_length, required_bits, zigzag
from ..operators.blocks import fill_nulls, in_block
from ..operators.floats import double_bits, float_bits, half_bits
from ..operators.integers import payload_sizes, smallest
from ..operators.strings import index_width
from ..sources.bits import bca_encode as bca_bytes

INTEGER, FLOAT, BOOLEAN, STRING, IPC = 1, 2, 3, 4, 255


def codec_of(kind: T.DataType) -> int:
    """The codec id that a column's type leads to; accepting types don't overlap, so there is nothing to compare."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return FLOAT
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    return STRING if isinstance(kind, T.StringType) else IPC


def codec_choice(df: DataFrame) -> DataFrame:
    """column_name, codec of each column."""
    rows = [(f.name, codec_of(f.dataType)) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, codec int")


def _wrapped(value: Column) -> Column:
    """An unsigned 64-bit value, held as a decimal, as the bigint of the same bits."""
    return F.when(value >= F.expr("9223372036854775808BD"), value - F.expr("18446744073709551616BD")).otherwise(value).cast("long")


def _plan(df: DataFrame, columns: list[str] | None, stored: dict[str, str]) -> tuple[dict, dict, list[str], dict[str, int]]:
    """Integers (name: bigint column), floats (name: bits, bytes), booleans, strings (name: offset bytes)."""
    integers, floats, booleans, strings = {}, {}, [], {}
    for field in df.schema.fields:
        name, kind, codec, value = field.name, stored.get(field.name), codec_of(field.dataType), F.col(f"`{field.name}`")
        if name in ("block_id", "pos") or columns is not None and name not in columns:
            continue
        if kind == "uint64":
            integers[name] = _wrapped(value)
        elif codec == INTEGER:
            integers[name] = value.cast("long")
        elif codec == FLOAT:
            bits, width = (half_bits, 2) if kind == "float16" else (float_bits, 4) if isinstance(field.dataType, T.FloatType) else (double_bits, 8)
            floats[name] = value, bits, width
        elif codec == BOOLEAN:
            booleans.append(name)
        elif codec == STRING:
            strings[name] = 8 if kind == "large_string" else 4
    return integers, floats, booleans, strings


def _validity(n: Column, valid: Column) -> Column:
    return F.when((valid == n) | (valid == 0), F.lit(1)).otherwise(1 + F.floor((n + 7) / 8)).cast("long")


def _row(name: str, n: Column, encoding: Column, chunk: Column, valid: Column) -> Column:
    return F.struct(F.lit(name).alias("column_name"), n.alias("n"), encoding.alias("encoding"), (chunk.cast("long") + _validity(n, valid)).alias("chunk_bytes"))


def _ordered_profile(df: DataFrame, integers: dict, floats: dict, booleans: list[str]) -> DataFrame:
    """Columns whose encodings depend on neighbours: one shuffle and sort by block, one aggregate for all of them."""
    rows = df.select("block_id", "pos", *[x.alias(f"i{k}") for k, x in enumerate(integers.values())], *[x[0].alias(f"f{k}") for k, x in enumerate(floats.values())], *[F.col(f"`{x}`").alias(f"b{k}") for k, x in enumerate(booleans)])
    ints, flos, boos = ([f"{c}{k}" for k in range(len(x))] for c, x in (("i", integers), ("f", floats), ("b", booleans)))
    may_be_null = {f.name for f in rows.schema.fields if f.nullable}
    rows = rows.withColumns({f"{c}v": fill_nulls(F.col(c), 0 if c in ints else 0.0) if c in may_be_null else F.col(c) for c in (*ints, *flos)} | {f"{c}v": F.coalesce(F.col(c), F.lit(False)) for c in boos})
    rows = rows.withColumns({f"{c}w": bits(f"{c}v") for c, (_, bits, _) in zip(flos, floats.values())})
    rows = rows.withColumns(
        {f"{c}d": difference(f"{c}v", F.lag(f"{c}v").over(in_block())) for c in ints} | {f"{c}x": F.col(f"{c}w").bitwiseXOR(F.lag(f"{c}w").over(in_block())) for c in flos}
        | {f"{c}t": F.coalesce(F.col(f"{c}v") != F.lag(f"{c}v").over(in_block()), F.lit(False)).cast("int") for c in boos}
    )
    rows = rows.withColumns({f"{c}dd": difference(f"{c}d", F.lag(f"{c}d").over(in_block())) for c in ints})
    aggregates = [F.count("*").alias("n"), *[F.count(c).alias(f"{c}_valid") for c in (*ints, *flos, *boos)]]
    for c in ints:
        widths = [F.max(required_bits(zigzag(F.col(f"{c}{x}")))).alias(f"{c}_{x}") for x in ("d", "dd")]
        aggregates += [F.min(f"{c}v").alias(f"{c}_low"), F.max(f"{c}v").alias(f"{c}_high"), F.count(f"{c}d").alias(f"{c}_nd"), F.count(f"{c}dd").alias(f"{c}_ndd"), *widths]
    aggregates += [F.max(required_bits(F.col(f"{c}x"))).alias(f"{c}_x") for c in flos] + [F.sum(f"{c}t").alias(f"{c}_turns") for c in boos]
    out = rows.groupBy("block_id").agg(*aggregates)
    if booleans:
        kinds = ", ".join(f"{c}_bca long" for c in boos)
        patterns = df.select("block_id", "pos", *[F.coalesce(F.col(f"`{x}`"), F.lit(False)).alias(c) for c, x in zip(boos, booleans)]).groupBy("block_id").applyInArrow(_pattern_sizes(boos), f"block_id long, {kinds}")
        out = out.join(patterns, "block_id")

    n, found = F.col("n"), []
    zero = lambda x: F.coalesce(x, F.lit(0))
    for c, name in zip(ints, integers):
        delta = F.when(F.col(f"{c}_nd") == n - 1, zero(F.col(f"{c}_d")))
        dod = F.when((F.col(f"{c}_nd") == n - 1) & (F.col(f"{c}_ndd") == F.greatest(n - 2, F.lit(0))), zero(F.col(f"{c}_dd")))
        best = smallest(payload_sizes(n, F.coalesce(required_bits(difference(f"{c}_high", f"{c}_low")), F.lit(64)), delta, dod))
        found.append(_row(name, n, best["name"], best["bytes"] + best["head"], F.col(f"{c}_valid")))
    for c, (name, (_, _, width)) in zip(flos, floats.items()):
        packed = packed_length(n - 1, zero(F.col(f"{c}_x"))) + width + 1
        found.append(_row(name, n, F.when(packed < n * width, "xor").otherwise("raw"), 1 + F.least(packed, n * width), F.col(f"{c}_valid")))
    for c, name in zip(boos, booleans):
        sizes = (F.floor((n + 7) / 8).cast("long"), 5 + 4 * F.col(f"{c}_turns"), F.col(f"{c}_bca"))
        best = F.least(*[F.struct(x.alias("bytes"), F.lit(i).alias("rank"), F.lit(k).alias("name")) for i, (k, x) in enumerate(zip(("bitmap", "rle", "bca"), sizes))])
        found.append(_row(name, n, best["name"], 1 + best["bytes"], F.col(f"{c}_valid")))
    return out.select("block_id", F.inline(F.array(*found)))


def _pattern_sizes(names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        bits = {c: table.column(c).to_numpy(zero_copy_only=False).astype(np.uint8) for c in names}
        return pa.table({"block_id": table.column("block_id")[:1], **{f"{c}_bca": [len(bca_bytes(x))] for c, x in bits.items()}})

    return run


def _string_profiles(df: DataFrame, strings: dict[str, int]) -> DataFrame:
    """All string columns over one shuffle by block, column and value."""
    values = F.array(*[F.struct(F.lit(k).alias("c"), F.col(f"`{name}`").alias("s")) for k, name in enumerate(strings)])
    rows = df.select("block_id", F.inline(values)).groupBy("block_id", "c", "s").agg(F.count("*").alias("rows"))
    size = F.coalesce(F.octet_length("s"), F.lit(0)).cast("long")
    # Null counts as the empty string, which may be there as well.
    twice = (F.bool_or(F.col("s").isNull()) & F.bool_or(F.col("s") == "")).cast("int")
    out = rows.groupBy("block_id", "c").agg(
        F.sum("rows").alias("n"), F.sum(F.when(F.col("s").isNotNull(), F.col("rows")).otherwise(0)).alias("valid"), (F.count("*") - F.coalesce(twice, F.lit(0))).alias("entries"),
        F.sum(size * F.col("rows")).alias("text"), F.sum(size).alias("words"),
    )
    name, width = (F.element_at(F.array(*[F.lit(x) for x in values]), F.col("c") + 1) for values in (list(strings), list(strings.values())))
    out = out.withColumn("raw", width * (F.col("n") + 1) + F.col("text")).withColumn("dict", 5 + 8 * F.col("entries") + F.col("words") + F.col("n") * index_width(F.col("entries")))
    chosen = F.when(F.col("dict") < F.col("raw"), "dictionary").otherwise("raw")
    return out.select(name.alias("column_name"), "block_id", "n", chosen.alias("encoding"), (1 + F.least("raw", "dict") + _validity(F.col("n"), F.col("valid"))).cast("long").alias("chunk_bytes"))


def table_profile(df: DataFrame, columns: list[str] | None = None, stored: dict[str, str] | None = None) -> DataFrame:
    """column_name, block_id, n, encoding, chunk_bytes with validity, for columns that aren't stored as IPC.

    ``df`` has block_id and pos. All integer, float and boolean columns are profiled over
    one shuffle by block (a second one counts bit patterns of booleans), all strings over
    one by block and value. ``stored`` names columns whose stored type Spark lacks:
    ``uint64`` (held as decimal), ``float16`` (held as float), ``large_string``.
    """
    integers, floats, booleans, strings = _plan(df, columns, stored or {})
    parts = [_ordered_profile(df, integers, floats, booleans)] if integers or floats or booleans else []
    parts += [_string_profiles(df, strings)] if strings else []
    if not parts:
        return df.sparkSession.createDataFrame([], "column_name string, block_id long, n long, encoding string, chunk_bytes long")
    out = [x.select("column_name", "block_id", "n", "encoding", "chunk_bytes") for x in parts]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])
