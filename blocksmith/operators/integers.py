"""Integer encodings by block: frame of reference, delta, delta of delta, raw, and the choice among them.

Inputs have block_id, pos and a bigint column without nulls (see ``fill_nulls``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import difference, packed_length, required_bits, unzigzag, zigzag
from .blocks import in_block, running, whole_block

#: Encodings in the order that settles ties, with the tag and the header bytes of each.
ENCODINGS = [("raw", 0, 1), ("for", 1, 10), ("delta", 2, 10), ("dod", 3, 18)]


def for_encode(df: DataFrame, value: str) -> DataFrame:
    """block_id, pos, minimum, offset (unsigned as wrapped bigint), width."""
    low, high = F.min(value).over(whole_block()), F.max(value).over(whole_block())
    out = df.select("block_id", "pos", F.col(value).alias("v"), low.alias("minimum"), high.alias("high"))
    width = F.coalesce(required_bits(difference("high", "minimum")), F.lit(64))
    offset = F.coalesce(difference("v", "minimum"), (F.col("v").cast("decimal(20,0)") - F.col("minimum") - F.expr("18446744073709551616BD")).cast("long"))
    return out.select("block_id", "pos", "minimum", offset.alias("offset"), width.alias("width"))


def for_decode(df: DataFrame) -> DataFrame:
    """An offset of 2**63 and more is negative as a bigint and is added in decimals."""
    wide = (F.col("minimum").cast("decimal(20,0)") + F.col("offset") + F.expr("18446744073709551616BD")).cast("long")
    return df.select("block_id", "pos", F.when(F.col("offset") < 0, wide).otherwise(F.col("minimum") + F.col("offset")).alias("v"))


def delta_encode(df: DataFrame, value: str) -> DataFrame:
    """block_id, pos, first, z (zigzag of the difference, null in the first row), fits (no difference leaves 64 bits)."""
    out = df.select("block_id", "pos", F.first(value).over(running()).alias("first"), F.lag("pos").over(in_block()).isNotNull().alias("later"), difference(F.col(value), F.lag(value).over(in_block())).alias("d"))
    fits = F.count(F.when(F.col("later") & F.col("d").isNull(), 1)).over(whole_block()) == 0
    return out.select("block_id", "pos", "first", zigzag(F.col("d")).alias("z"), fits.alias("fits"))


def delta_decode(df: DataFrame) -> DataFrame:
    """The first value stands inside the sum, so that partial sums are the values themselves. Null in a block whose encoding was withdrawn."""
    step = F.when(F.col("fits"), F.coalesce(unzigzag(F.col("z")), "first"))
    return df.select("block_id", "pos", F.sum(step).over(running()).alias("v"))


def dod_encode(df: DataFrame, value: str) -> DataFrame:
    """block_id, pos, first, first_delta, z (zigzag of the change of the difference, null in the first two rows), fits."""
    row = F.row_number().over(in_block())
    out = df.select("block_id", "pos", F.first(value).over(running()).alias("first"), row.alias("row"), difference(F.col(value), F.lag(value).over(in_block())).alias("d"))
    out = out.withColumn("dd", difference(F.col("d"), F.lag("d").over(in_block()))).withColumn("first_delta", F.coalesce(F.max(F.when(F.col("row") == 2, F.col("d"))).over(whole_block()), F.lit(0).cast("long")))
    fits = F.count(F.when((F.col("row") > 1) & F.col("d").isNull() | (F.col("row") > 2) & F.col("dd").isNull(), 1)).over(whole_block()) == 0
    return out.select("block_id", "pos", "first", "first_delta", zigzag(F.col("dd")).alias("z"), fits.alias("fits"))


def dod_decode(df: DataFrame) -> DataFrame:
    """Null in a block whose encoding was withdrawn."""
    row = F.row_number().over(in_block())
    out = df.withColumn("step", F.when(~F.col("fits"), F.lit(None)).when(row == 1, F.lit(0).cast("long")).when(row == 2, F.col("first_delta")).otherwise(unzigzag(F.col("z")))).withColumn("row", row)
    out = out.withColumn("d", F.sum("step").over(running()))
    return out.select("block_id", "pos", F.sum(F.when(~F.col("fits"), F.lit(None)).when(F.col("row") == 1, F.col("first")).otherwise(F.col("d"))).over(running()).alias("v"))


def integer_profile(df: DataFrame, value: str) -> DataFrame:
    """By block: n, widths and payload bytes of each encoding (null: withdrawn), encoding, payload_bytes, chunk_bytes without validity."""
    d = difference(F.col(value), F.lag(value).over(in_block()))
    rows = df.select("block_id", "pos", F.col(value).alias("v"), d.alias("d"))
    rows = rows.withColumn("dd", difference(F.col("d"), F.lag("d").over(in_block())))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = rows.groupBy("block_id").agg(
        F.count("*").alias("n"), F.min("v").alias("minimum"), F.max("v").alias("maximum"), F.count("d").alias("nd"), F.count("dd").alias("ndd"),
        zero(F.max(required_bits(zigzag(F.col("d"))))).alias("wd"), zero(F.max(required_bits(zigzag(F.col("dd"))))).alias("wdd"),
    )
    less1, less2 = F.greatest(F.col("n") - 1, F.lit(0)), F.greatest(F.col("n") - 2, F.lit(0))
    out = out.withColumn("for_width", F.coalesce(required_bits(difference("maximum", "minimum")), F.lit(64)))
    out = out.withColumn("delta_width", F.when(F.col("nd") == less1, F.col("wd"))).withColumn("dod_width", F.when((F.col("nd") == less1) & (F.col("ndd") == less2), F.col("wdd")))
    sizes = payload_sizes(*(F.col(x) for x in ("n", "for_width", "delta_width", "dod_width")))
    out = out.withColumns({f"{k}_bytes": x for k, x in sizes.items()})
    out = out.withColumn("best", smallest({k: F.col(f"{k}_bytes") for k in sizes}))
    return out.select(
        "block_id", "n", "for_width", "delta_width", "dod_width", *[f"{k}_bytes" for k in sizes], F.col("best.name").alias("encoding"), F.col("best.bytes").alias("payload_bytes"),
        (F.col("best.bytes") + F.col("best.head")).alias("chunk_bytes"),
    )


def payload_sizes(n: Column, for_width: Column, delta_width: Column, dod_width: Column) -> dict[str, Column]:
    """Payload bytes of each encoding of n values; null where the width is."""
    less1, less2 = F.greatest(n - 1, F.lit(0)), F.greatest(n - 2, F.lit(0))
    return {"raw": n * 8, "for": packed_length(n, for_width), "delta": packed_length(less1, delta_width), "dod": packed_length(less2, dod_width)}


def smallest(sizes: dict[str, Column]) -> Column:
    """A struct (bytes, tag, name, head) of the smallest payload; ties go to the lower tag."""
    options = [F.when(sizes[name].isNotNull(), F.struct(sizes[name].alias("bytes"), F.lit(tag).alias("tag"), F.lit(name).alias("name"), F.lit(head).alias("head"))) for name, tag, head in ENCODINGS]
    return F.least(*options)
