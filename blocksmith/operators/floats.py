"""XOR encoding of doubles by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..functions.bits import packed_length, required_bits
from .blocks import in_block, running


@F.pandas_udf(LongType())
def double_bits(values: pd.Series) -> pd.Series:
    """The 64 bits of each double as bigint; the column must have no nulls."""
    return pd.Series(values.to_numpy(np.float64).view(np.int64))


@F.pandas_udf(LongType())
def float_bits(values: pd.Series) -> pd.Series:
    """The 32 bits of each float as bigint; the column must have no nulls."""
    return pd.Series(values.to_numpy(np.float32).view(np.uint32).astype(np.int64))


@F.pandas_udf(LongType())
def half_bits(values: pd.Series) -> pd.Series:
    """The 16 bits of each half-precision float, held as float; the column must have no nulls."""
    return pd.Series(values.to_numpy(np.float32).astype(np.float16).view(np.uint16).astype(np.int64))


@F.pandas_udf(DoubleType())
def bits_double(values: pd.Series) -> pd.Series:
    return pd.Series(values.to_numpy(np.int64).view(np.float64))


def xor_encode(df: DataFrame, bits: Column) -> DataFrame:
    """block_id, pos, first, x (bits XOR those of the row before; null in the first row)."""
    out = df.select("block_id", "pos", bits.alias("b"))
    return out.select("block_id", "pos", F.first("b").over(running()).alias("first"), F.col("b").bitwiseXOR(F.lag("b").over(in_block())).alias("x"))


def xor_decode(df: DataFrame) -> DataFrame:
    return df.select("block_id", "pos", F.expr("bit_xor(coalesce(x, first)) over (partition by block_id order by pos rows unbounded preceding)").alias("b"))


def float_profile(df: DataFrame, bits: Column, byte_width: int = 8) -> DataFrame:
    """By block: n, width of the widest XOR, raw and XOR payload bytes, encoding, chunk_bytes without validity."""
    out = xor_encode(df, bits).groupBy("block_id").agg(F.count("*").alias("n"), F.coalesce(F.max(required_bits(F.col("x"))), F.lit(0)).alias("width"))
    out = out.withColumn("raw_bytes", F.col("n") * byte_width).withColumn("xor_bytes", packed_length(F.col("n") - 1, F.col("width")))
    chosen = F.col("xor_bytes") + byte_width + 1 < F.col("raw_bytes")
    return out.select("*", F.when(chosen, "xor").otherwise("raw").alias("encoding"), (1 + F.when(chosen, F.col("xor_bytes") + byte_width + 1).otherwise(F.col("raw_bytes"))).alias("chunk_bytes"))
