"""Boolean encodings by block: bitmap, runs, and bit patterns (BCA)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.bits import bca_decode as _bca_decode
from ..sources.bits import bca_encode as _bca_encode
from .blocks import in_block, running


def bitmap_profile(df: DataFrame, value: str) -> DataFrame:
    """By block: n, n_true (null: false), bytes of the bitmap."""
    return df.groupBy("block_id").agg(F.count("*").alias("n"), F.count(F.when(F.col(value), 1)).alias("n_true"), F.floor((F.count("*") + 7) / 8).cast("long").alias("bytes"))


def rle_runs(df: DataFrame, value: str) -> DataFrame:
    """block_id, run (from 0), value, start, length of each run; null is false."""
    out = df.select("block_id", "pos", F.coalesce(F.col(value), F.lit(False)).alias("b"))
    out = out.withColumn("turn", F.coalesce(F.col("b") != F.lag("b").over(in_block()), F.lit(False)).cast("int"))
    out = out.withColumn("run", F.sum("turn").over(running()))
    return out.groupBy("block_id", "run").agg(F.first("b").alias("value"), F.min("pos").alias("start"), F.count("*").alias("length"))


def rle_expand(runs: DataFrame) -> DataFrame:
    """block_id, pos, value of every row of the runs."""
    return runs.select("block_id", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos"), "value")


def _per_block(df: DataFrame, value: str):
    return df.select("block_id", "pos", F.coalesce(F.col(value), F.lit(False)).alias("b")).groupBy("block_id")


def bca_encode(df: DataFrame, value: str) -> DataFrame:
    """block_id, n, blocks (the bytes of the greedy encoding). A block's rows meet in one task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        bits = table.column("b").to_numpy(zero_copy_only=False).astype(np.uint8)
        return pa.table({"block_id": table.column("block_id")[:1], "n": [len(bits)], "blocks": pa.array([_bca_encode(bits)], pa.binary())})

    return _per_block(df, value).applyInArrow(run, "block_id long, n long, blocks binary")


def bca_decode(encoded: DataFrame) -> DataFrame:
    """block_id, row (from 0), value."""

    def run(batches):
        for batch in batches:
            for block, n, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                bits = _bca_decode(bytes(data), n)
                yield pa.record_batch([pa.array(np.full(n, block)), pa.array(np.arange(n)), pa.array(bits.astype(bool))], ["block_id", "row", "value"])

    return encoded.select("block_id", "n", "blocks").mapInArrow(run, "block_id long, row long, value boolean")


def boolean_profile(df: DataFrame, value: str) -> DataFrame:
    """By block: payload bytes of bitmap, runs and BCA, and the first of the smallest."""
    runs = rle_runs(df, value).groupBy("block_id").agg((1 + 4 * F.count("*")).alias("rle_bytes"))
    bca = bca_encode(df, value).select("block_id", F.octet_length("blocks").cast("long").alias("bca_bytes"))
    out = bitmap_profile(df, value).select("block_id", "n", F.col("bytes").alias("bitmap_bytes")).join(runs, "block_id").join(bca, "block_id")
    best = F.least(*[F.struct(F.col(f"{k}_bytes").alias("bytes"), F.lit(i).alias("rank"), F.lit(k).alias("name")) for i, k in enumerate(("bitmap", "rle", "bca"))])
    return out.withColumn("best", best).select("block_id", "n", "bitmap_bytes", "rle_bytes", "bca_bytes", F.col("best.name").alias("encoding"), (1 + F.col("best.bytes")).alias("chunk_bytes"))
