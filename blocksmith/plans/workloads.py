"""Generated tables for measuring encodings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Fixed values of the 64-bit mix and of the workloads.
MIX_ONE, MIX_TWO = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
START_MS, STEP_MS = 1_735_689_600_000, 1_000
CUSTOMERS, PRODUCTS, QUANTITIES = 20_000, 800, 5
COUNTRIES = ["IL", "US", "DE", "JP", "BR"]
LCG_MULTIPLIER, LCG_INCREMENT, LCG_SEED = 6_364_136_223_846_793_005, 1, 42


def mix64(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(MIX_ONE)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(MIX_TWO)
    return v ^ (v >> np.uint64(31))


@F.pandas_udf(LongType())
def hash64(values: pd.Series) -> pd.Series:
    """The mix of each bigint read as unsigned, as bigint."""
    return pd.Series(mix64(values.to_numpy(np.int64).view(np.uint64)).view(np.int64))


def _modulo(x: Column, m: int) -> Column:
    """Of an unsigned value in a bigint: halves first, so that nothing turns negative."""
    return ((F.shiftrightunsigned(x, 1) % m) * 2 + x.bitwiseAND(F.lit(1))) % m


def telemetry(spark: SparkSession, rows: int, block_rows: int) -> DataFrame:
    r = F.col("pos")
    out = _rows(spark, rows, block_rows).withColumn("customer", _modulo(hash64(r), CUSTOMERS)).withColumn("product", _modulo(hash64(r + 1), PRODUCTS))
    return out.select(
        "block_id", "pos", (F.lit(START_MS) + r * STEP_MS).alias("time"), "customer", "product", (F.col("customer") % 32).alias("country"),
        (1 + _modulo(hash64(r + 2), QUANTITIES)).alias("quantity"), (199 + 17 * F.col("product")).alias("price"),
    )


def random_i64(spark: SparkSession, rows: int, block_rows: int) -> DataFrame:
    return _rows(spark, rows, block_rows).select("block_id", "pos", *[hash64(F.col("pos").bitwiseXOR(F.lit(i))).alias(name) for i, name in enumerate("abcdef", 1)])


def mixed(spark: SparkSession, rows: int, block_rows: int) -> DataFrame:
    r = F.col("pos")
    return _rows(spark, rows, block_rows).select(
        "block_id", "pos", (F.lit(START_MS) + r * STEP_MS).alias("time"), (r % CUSTOMERS).alias("customer"), (_modulo(hash64(r), 100_000) / 100).alias("amount"),
        F.get(F.array(*[F.lit(x) for x in COUNTRIES]), (r % len(COUNTRIES)).cast("int")).alias("country"), (r % 11 != 0).alias("success"),
    )


def _rows(spark: SparkSession, rows: int, block_rows: int) -> DataFrame:
    return spark.range(rows).select(F.col("id").alias("pos"), F.floor(F.col("id") / block_rows).cast("long").alias("block_id"))


#: The three workloads by name.
WORKLOADS = {"telemetry": telemetry, "random-i64": random_i64, "mixed-arrow": mixed}


def sequence_table(rows: int = 100_000):
    """The size comparison's Arrow table: four draws a row from one linear congruential sequence."""
    import pyarrow as pa

    state, draws = LCG_SEED, []
    for _ in range(4 * rows):
        state = (state * LCG_MULTIPLIER + LCG_INCREMENT) % 2**64
        draws.append(state)
    a, b, c, d = (np.array(draws[i::4], np.uint64) for i in range(4))
    customer, product = (a % np.uint64(CUSTOMERS)).astype(np.int64), (b % np.uint64(PRODUCTS)).astype(np.int64)
    columns = {
        "event_time": START_MS + np.arange(rows) * STEP_MS, "customer_id": customer, "product_id": product, "country": customer % 32,
        "quantity": 1 + (c % np.uint64(QUANTITIES)).astype(np.int64), "price_cents": 199 + product * 17 + (d % np.uint64(20)).astype(np.int64),
    }
    return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})
