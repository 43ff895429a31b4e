"""Blocks: horizontal slices of a table in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_block() -> WindowSpec:
    """The rows of a block in order."""
    return Window.partitionBy("block_id").orderBy("pos")


def running() -> WindowSpec:
    """From a block's first row to the current one."""
    return in_block().rowsBetween(Window.unboundedPreceding, 0)


def whole_block() -> WindowSpec:
    return Window.partitionBy("block_id")


def with_blocks(df: DataFrame, key: Column | str, block_rows: int) -> DataFrame:
    """Adds pos (the key) and block_id; the key must be dense and unique, so no global sort is needed."""
    key = F.col(key) if isinstance(key, str) else key
    return df.withColumn("pos", key.cast("long")).withColumn("block_id", F.floor(F.col("pos") / block_rows).cast("long"))


def fill_nulls(value: Column, zero) -> Column:
    """The last value that isn't null in the block, ``zero`` before the first."""
    return F.coalesce(F.last_value(value, F.lit(True)).over(running()), F.lit(zero))


def validity_profile(df: DataFrame, value: str) -> DataFrame:
    """By block: rows, valid rows, mode (0 no nulls, 1 all null, 2 bitmap) and bytes of the validity section."""
    out = df.groupBy("block_id").agg(F.count("*").alias("n"), F.count(value).alias("n_valid"))
    mode = F.when(F.col("n_valid") == F.col("n"), 0).when(F.col("n_valid") == 0, 1).otherwise(2)
    return out.withColumn("mode", mode).withColumn("bytes", F.when(F.col("mode") < 2, F.lit(1).cast("long")).otherwise(1 + F.floor((F.col("n") + 7) / 8).cast("long")))


def concat_blocks(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both, numbered so that every block of ``second`` follows those of ``first``."""
    last = first.agg(F.max("block_id")).first()[0]
    return first.unionByName(second.withColumn("block_id", F.col("block_id") + F.lit(0 if last is None else last + 1)))
