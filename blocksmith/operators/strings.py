"""String encodings by block: raw offsets and bytes, or a dictionary in order of first occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def index_width(entries: Column) -> Column:
    return F.when(entries <= 256, 1).when(entries <= 65536, 2).otherwise(4)


def _filled(df: DataFrame, value: str) -> DataFrame:
    return df.select("block_id", "pos", F.coalesce(F.col(value), F.lit("")).alias("s"))


def dictionary(df: DataFrame, value: str) -> DataFrame:
    """block_id, code (by first occurrence, from 0), s, rows. Null counts as the empty string."""
    first = _filled(df, value).groupBy("block_id", "s").agg(F.min("pos").alias("first"), F.count("*").alias("rows"))
    order = Window.partitionBy("block_id").orderBy("first")
    return first.select("block_id", (F.row_number().over(order) - 1).alias("code"), "s", "rows")


def dict_encode(df: DataFrame, value: str) -> DataFrame:
    """block_id, pos, code."""
    return _filled(df, value).join(dictionary(df, value).drop("rows"), ["block_id", "s"]).select("block_id", "pos", "code")


def dict_decode(codes: DataFrame, entries: DataFrame) -> DataFrame:
    """block_id, pos, s."""
    return codes.join(entries.select("block_id", "code", "s"), ["block_id", "code"]).select("block_id", "pos", "s")


def string_profile(df: DataFrame, value: str, offset_width: int = 4) -> DataFrame:
    """By block: n, entries, raw and dictionary payload bytes, encoding, chunk_bytes without validity; the dictionary must be smaller."""
    entries = _filled(df, value).groupBy("block_id", "s").agg(F.count("*").alias("c"))
    size = F.octet_length("s").cast("long")
    out = entries.groupBy("block_id").agg(F.sum("c").alias("n"), F.count("*").alias("entries"), F.sum(size * F.col("c")).alias("text_bytes"), F.sum(8 + size).alias("entry_bytes"))
    out = out.withColumn("raw_bytes", offset_width * (F.col("n") + 1) + F.col("text_bytes")).withColumn("dict_bytes", 5 + F.col("entry_bytes") + F.col("n") * index_width(F.col("entries")))
    chosen = F.col("dict_bytes") < F.col("raw_bytes")
    return out.select("block_id", "n", "entries", "raw_bytes", "dict_bytes", F.when(chosen, "dictionary").otherwise("raw").alias("encoding"), (1 + F.least("raw_bytes", "dict_bytes")).alias("chunk_bytes"))
