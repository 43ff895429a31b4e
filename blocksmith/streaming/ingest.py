"""Streams into block directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.datasource import register


def append_blocks(stream: DataFrame, path: str, checkpoint: str, block_rows: int = 100_000) -> StreamingQuery:
    """Append each micro-batch to the block directory, once: the manifest keeps the last batch of each checkpoint, and a replay of it adds nothing."""
    register(stream.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.format("blocks").mode("append").option("block_rows", block_rows).option("batch_query", checkpoint).option("batch_id", batch_id).save(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
