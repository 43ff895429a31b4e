"""The format as a Spark data source: a partition for each run of blocks.

``spark.dataSource.register(BlockSource)``, then format ``blocks``. Reading: options
``columns`` (names, comma-separated), ``blocks`` (numbers over all files in order),
``partition_bytes`` (of successive blocks of a file that one task reads; default 32 MiB) and
``block_column`` (adds the block number; with ``push_filters`` and
``spark.sql.python.filterPushdown.enabled``, filters on it choose the partitions). Writing:
``block_rows``; with ``batch_query`` and ``batch_id``, a batch that the table already has is
not added again. A directory holds files of their own and ``_manifest.json``, which
gives their order; without a manifest all its files count, by name. A new manifest is
written beside the old one and moved over it, and files go only once it no longer names them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .container import Block, BlockReader, BlockWriter, decode_schema, encode_schema, read_block
from .errors import BlockOutOfRange, InvalidMetadata, SchemaChanged

MANIFEST, SUFFIX = "_manifest.json", ".blk"
#: Types that Spark lacks, and what holds their values.
WIDER = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32(), pa.large_string(): pa.string(), pa.large_binary(): pa.binary()}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def read_manifest(store: fs.FileSystem, root: str) -> dict | None:
    """files (names in order) and batches (the last batch of each streaming query); None where there is no manifest."""
    if store.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        return {"batches": {}} | json.loads(f.read())


def list_files(path: str) -> list[str]:
    """Files of a path in order; by the manifest if there is one."""
    store, root = _store(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [root]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    manifest = read_manifest(store, root)
    if manifest is not None:
        return [f"{root}/{name}" for name in manifest["files"]]
    return sorted(x.path for x in store.get_file_info(fs.FileSelector(root)) if x.path.endswith(SUFFIX))


def _widen(array: pa.Array) -> pa.Array:
    to = WIDER.get(array.type)
    if to is None:
        return array
    if pa.types.is_decimal(to):
        return pa.array([None if x is None else x for x in array.to_pylist()], to)
    return pc.cast(array, to)


def spark_schema(schema: pa.Schema) -> StructType:
    out = []
    for item in schema:
        try:
            out.append(StructField(item.name, from_arrow_type(WIDER.get(item.type, item.type)), item.nullable))
        except Exception as e:
            raise InvalidMetadata(f"column {item.name}: Spark has no type for {item.type}") from e
    return StructType(out)


@dataclass
class BlockPartition(InputPartition):
    """Successive blocks of a file, with all that a task needs to read them."""

    file: str
    schema: bytes = b""
    blocks: list[tuple[int, Block]] = field(default_factory=list)


def _schema_of(path: str) -> pa.Schema | None:
    """The Arrow schema of a path's first file; None where there is none."""
    store, root = _store(path)
    files = [] if store.get_file_info(root).type == fs.FileType.NotFound else list_files(path)
    if not files:
        return None
    with store.open_input_file(files[0]) as f:
        return BlockReader(f).schema


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> StructType:
        schema = _schema_of(self.options["path"])
        if schema is None:
            raise InvalidMetadata("no file gives a schema")
        out = spark_schema(pa.schema([x for x in schema if self._chosen() is None or x.name in self._chosen()]))
        return out.add("_block", "long") if self._numbered() else out

    def _chosen(self) -> list[str] | None:
        names = self.options.get("columns")
        return names and [x.strip() for x in names.split(",")]

    def _numbered(self) -> bool:
        return self.options.get("block_column", "false").lower() == "true"

    def reader(self, schema: StructType) -> DataSourceReader:
        scan = FilteredBlockScan if self.options.get("push_filters", "false").lower() == "true" else BlockScan
        return scan(self.options["path"], self._chosen(), self._numbered(), self.options.get("blocks"), int(self.options.get("partition_bytes", 32 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        batch = (self.options["batch_query"], int(self.options["batch_id"])) if "batch_query" in self.options else None
        return BlockSink(self.options["path"], schema, int(self.options.get("block_rows", 100_000)), overwrite, batch)


class BlockScan(DataSourceReader):
    def __init__(self, path: str, columns: list[str] | None, numbered: bool, blocks: str | None, partition_bytes: int):
        self.path, self.columns, self.numbered, self.partition_bytes = path, columns, numbered, partition_bytes
        self.blocks = None if blocks is None else {int(x) for x in blocks.split(",")}
        self.asked = self.blocks

    def _footer(self, file: str) -> tuple[bytes, list[Block]]:
        store, _ = _store(self.path)
        with store.open_input_file(file) as f:
            reader = BlockReader(f)
        return encode_schema(reader.schema), reader.meta.blocks

    def partitions(self) -> list[BlockPartition]:
        """Footers are read side by side; a partition has its blocks' places, so tasks read no footer."""
        files = list_files(self.path)
        with ThreadPoolExecutor(16) as pool:
            footers = list(pool.map(self._footer, files))
        out, number = [], 0
        for file, (schema, blocks) in zip(files, footers):
            held = 0
            for i, block in enumerate(blocks):
                size = sum(c.length for c in block.chunks)
                if self.blocks is None or number + i in self.blocks:
                    if not out or out[-1].file != file or out[-1].blocks[-1][0] != number + i - 1 or held + size > self.partition_bytes:
                        out.append(BlockPartition(file, schema))
                        held = 0
                    out[-1].blocks.append((number + i, block))
                    held += size
            number += len(blocks)
        if self.asked and not self.asked <= set(range(number)):
            raise BlockOutOfRange(f"blocks {sorted(self.asked - set(range(number)))} of {number}")
        return out or [BlockPartition("")]

    def read(self, partition: BlockPartition) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = _store(self.path)
        schema = decode_schema(partition.schema)
        with store.open_input_file(partition.file) as f:
            for number, block in partition.blocks:
                batch = read_block(f, schema, block, self.columns)
                arrays, names = [_widen(x) for x in batch.columns], list(batch.schema.names)
                if self.numbered:
                    arrays.append(pa.array([number] * block.rows, pa.int64()))
                    names.append("_block")
                yield pa.record_batch(arrays, names)


class FilteredBlockScan(BlockScan):
    """Takes filters; Spark refuses such readers unless pushing is enabled."""

    def pushFilters(self, filters):
        for f in filters:
            if self.numbered and isinstance(f, (EqualTo, In)) and f.attribute == ("_block",):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.blocks = found if self.blocks is None else self.blocks & found
            yield f  # Spark applies it again


@dataclass
class Written(WriterCommitMessage):
    name: str
    order: int


class BlockSink(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, block_rows: int, overwrite: bool, batch: tuple[str, int] | None = None):
        self.path, self.schema, self.block_rows, self.overwrite, self.batch = path, schema, block_rows, overwrite, batch
        if block_rows < 1:
            raise ValueError("block_rows must be positive")
        if not len(schema):
            raise InvalidMetadata("a table without columns can't be stored")
        there = None if overwrite else _schema_of(path)
        if there is not None:
            kinds = [(f.name, f.dataType) for f in spark_schema(there)]
            if kinds != [(f.name, f.dataType) for f in schema]:
                raise SchemaChanged(f"the table has {kinds}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}{SUFFIX}"
        out = writer = None
        held, rows = [], 0
        for batch in iterator:
            if not len(batch):
                continue
            if writer is None:
                out = store.open_output_stream(f"{root}/{name}")
                writer = BlockWriter(out, batch.schema)
            held.append(batch)
            rows += len(batch)
            while rows >= self.block_rows:
                table = pa.Table.from_batches(held).combine_chunks()
                writer.write_batch(_one(table.slice(0, self.block_rows)))
                held = table.slice(self.block_rows).to_batches()
                rows -= self.block_rows
        if writer is not None:
            if rows:
                writer.write_batch(_one(pa.Table.from_batches(held)))
            writer.finish()
            out.close()
        return Written(name if writer is not None else "", task.partitionId())

    def _empty(self, store: fs.FileSystem, root: str) -> str:
        """A file of no blocks, which keeps the schema."""
        name = f"part-000000-{uuid.uuid4().hex}{SUFFIX}"
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}") as out:
            BlockWriter(out, to_arrow_schema(self.schema)).finish()
        return name

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        new = [m.name for m in sorted((m for m in messages if m), key=lambda m: m.order) if m.name]
        for _ in range(5):
            manifest = read_manifest(store, root) or {"batches": {}}
            if self.batch and manifest["batches"].get(self.batch[0], -1) >= self.batch[1]:
                return self._delete(store, root, new)
            there = [] if store.get_file_info(root).type == fs.FileType.NotFound else [x.rsplit("/", 1)[-1] for x in list_files(self.path)]
            if "files" not in manifest:
                there = [x for x in there if x not in new]
            old = [] if self.overwrite else there
            files = old + new or [self._empty(store, root)]
            batches = ({} if self.overwrite else manifest["batches"]) | (dict([self.batch]) if self.batch else {})
            token = uuid.uuid4().hex
            with store.open_output_stream(f"{root}/{MANIFEST}.{token}") as f:
                f.write(json.dumps({"files": files, "batches": batches, "token": token}).encode())
            store.move(f"{root}/{MANIFEST}.{token}", f"{root}/{MANIFEST}")
            now = read_manifest(store, root)
            if set(new) <= set(now["files"]):  # else another commit read the old manifest too and came last
                break
        else:
            raise InvalidMetadata("other commits kept replacing the manifest")
        if self.overwrite:
            self._delete(store, root, [x for x in there if x not in now["files"]])

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        self._delete(store, root, [m.name for m in messages if m and m.name])

    @staticmethod
    def _delete(store: fs.FileSystem, root: str, names: list[str]) -> None:
        for name in names:
            if store.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                store.delete_file(f"{root}/{name}")


def _one(table: pa.Table) -> pa.RecordBatch:
    return table.combine_chunks().to_batches()[0]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockSource)


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """block, rows, column_name, codec, offset, length of every chunk, read from the footers in tasks."""
    files = list_files(path)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(files)], "nth int, file string").repartition(max(1, min(len(files), 512)))

    def run(batches):
        store, _ = _store(path)
        for batch in batches:
            for nth, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(file) as f:
                    reader = BlockReader(f)
                found = [(nth, i, b.rows, name, c.codec, c.offset, c.length) for i, b in enumerate(reader.meta.blocks) for name, c in zip(reader.schema.names, b.chunks)]
                names = ["file", "block", "rows", "column_name", "codec", "offset", "length"]
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in found], INDEX)

    return rows.mapInArrow(run, "file int, block int, rows long, column_name string, codec int, offset long, length long")


INDEX = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("rows", pa.int64()), ("column_name", pa.string()), ("codec", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
