"""Contiguous shards of nearly equal bytes, in DataFrame operations only.

Rows are sorted by range into partitions; the totals of the partitions give each
one the bytes and rows before it, and a running sum inside the partition does the
rest. A row belongs to the shard whose equal share of all bytes holds its middle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace


def balanced_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 bytes of the text (null: none) plus 1; the law is ``bytes``.
    Rows are in ascending order of ids (nulls first; ties by checksum and size; rows
    equal in all three are alike and stand together). Slots count the rows of a shard
    from 0. Shards that no row reaches are empty; an empty table gives no rows.
    Further columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "shards")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    rows = rows.groupBy("id", "crc", "size").agg(F.count("*").alias("copies"))
    order = [F.col("id").asc_nulls_first(), F.col("crc"), F.col("size")]
    ranged = work.table("ranged", rows.repartitionByRange(partitions, *order).select("*", F.spark_partition_id().alias("part")))

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))
    parts = work.table("parts", parts.select("part", "bytes", "rows", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0")))
    total = parts.agg(F.sum("bytes")).first()[0] or 1

    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(parts.select("part", "bytes0", "rows0")), "part")  # a row for each partition
    placed = placed.withColumn("b", F.col("bytes0") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    placed = placed.withColumn("r", F.col("rows0") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    each = placed.select("id", "size", "crc", "b", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("k"))
    middle = (2 * (F.col("b") + F.col("k") * F.col("size")) + F.col("size")).cast("decimal(38,0)")
    shard = F.least(F.call_function("div", (middle * shards).cast("decimal(38,0)"), F.lit(2 * total).cast("decimal(38,0)")).cast("int"), F.lit(shards - 1))
    each = work.table("each", each.select("id", "size", "crc", (F.col("r") + F.col("k")).alias("row"), shard.alias("shard")))
    first = each.groupBy("shard").agg(F.min("row").alias("first"))  # one row a shard
    return each.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
