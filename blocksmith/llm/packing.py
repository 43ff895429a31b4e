"""Best-fit decreasing packing of documents into token sequences.

A document is first cut into full windows; what is left of it, and every shorter
document, is a remainder. Remainders are numbered over the whole table and dealt
into groups of a fixed count, whatever their keys. Within a group they are placed
from the longest to the shortest into the tightest open window, found with a segment
tree over remaining capacities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace
from .textarrays import release, slices
from .tokens import default_path, encoder

#: Remainders that are packed together.
GROUP = 20_000


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree of how many each range holds."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def add(self, window: int, capacity: int) -> None:
        if capacity:
            self.held[capacity].append(window)
            self._change(capacity, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take the window with the least capacity of at least ``length``: (window, capacity)."""
        at = length + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._change(capacity, -1)
        return self.held[capacity].pop(), capacity


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each length, placed from the longest to the shortest (ties: in order)."""
    windows, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_, made = OpenWindows(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        window, room = open_.tightest(n) or (made, capacity)
        made += window == made
        windows[i], offsets[i] = window, capacity - room
        open_.add(window, room - n)
    return windows, offsets


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long"


def _cut(path: str, end: int, capacity: int, keep: bool):
    """Pieces; full ones and remainders are each numbered within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task = encoder(path), TaskContext.get().partitionId()
        fulls = rests = 0
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, bounds = known.encode_ended(batch.column(1).slice(a, b - a), end)
                total = np.diff(bounds)
                count = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(total[row] - start, capacity)
                full = length == capacity
                nth = np.where(full, fulls + np.cumsum(full) - 1, rests + np.cumsum(~full) - 1)
                fulls, rests = fulls + int(full.sum()), rests + int((~full).sum())
                raw, at = memoryview(ids.view(np.uint8)), (bounds[:-1][row] + start) * 4
                parts = [raw[x:y] for x, y in zip(at.tolist(), (at + 4 * length).tolist())]
                columns = [
                    batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                    pa.array(total[row]), pa.array(np.full(len(row), task, np.int32)), pa.array(nth), *([pa.array(parts, pa.binary())] if keep else []),
                ]
                yield pa.record_batch(columns, [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep)
        release()

    return run


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("number", "ascending")])
        windows, offsets = best_fit(np.asarray(table.column("length").combine_chunks()), capacity)
        return table.append_column("window", pa.array(windows)).append_column("offset", pa.array(offsets))

    return run


def pack_documents(
    docs: DataFrame, path: str | None = None, capacity: int = 2048, end: int = 1, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text and ``end``; null and empty texts are the
    end id alone. Pieces of a sequence lie without gaps from offset 0; sequence ids
    run from 0 without gaps. With ``keep_ids`` the pieces carry their ids (binary,
    little-endian unsigned 32-bit integers). Repeated rows and null ids are packed
    like any other row. An empty table gives no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    path = path or default_path()
    work = Workspace(spark, "packing")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = work.table("pieces", source.mapInArrow(_cut(path, end, capacity, keep_ids), PIECES + ", ids binary" * keep_ids))

    full = F.col("length") == capacity
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = pieces.groupBy("task").agg(F.count(F.when(full, 1)).alias("fulls"), F.count(F.when(~full, 1)).alias("rests"))
    tasks = work.table("tasks", tasks.select("task", F.coalesce(F.sum("fulls").over(before), F.lit(0)).alias("full0"), F.coalesce(F.sum("rests").over(before), F.lit(0)).alias("rest0"), "fulls"))
    placed = pieces.join(F.broadcast(tasks.drop("fulls")), "task")  # a row for each task that read the table

    rests = placed.where(~full).withColumn("number", F.col("rest0") + F.col("nth")).withColumn("group", F.floor(F.col("number") / GROUP)).drop("task", "nth", "full0", "rest0")
    rests = work.table("rests", rests.groupBy("group").applyInArrow(_pack(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids + ", number long, group long, window long, offset long"))
    groups = rests.groupBy("group").agg((F.max("window") + 1).alias("made"))
    groups = groups.select("group", F.coalesce(F.sum("made").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    fulls = tasks.agg(F.sum("fulls")).first()[0] or 0
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids]
    one = placed.where(full).select("*", (F.col("full0") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).select(columns)
    two = rests.join(groups, "group").withColumn("sequence_id", F.lit(fulls) + F.col("base") + F.col("window")).select(columns)
    return one.unionByName(two).withColumnRenamed("doc_id", id_col)


def sequences(pieces: DataFrame, capacity: int = 2048, pad: int = 0) -> DataFrame:
    """(sequence_id, ids array, used) of pieces that carry their ids, padded to ``capacity``.

    Needs all pieces of a sequence, each once; a row that repeats one makes the sequence
    too long, which is an error. An empty table gives no rows.
    """

    def unpack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("offset", "ascending")])
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), "<u4").astype(np.int32)
        row = np.concatenate([ids, np.full(capacity - len(ids), pad, np.int32)])
        return pa.table({"sequence_id": [table.column("sequence_id")[0].as_py()], "ids": [row], "used": [len(ids)]})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(unpack, "sequence_id long, ids array<int>, used long")
