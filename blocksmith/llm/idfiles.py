"""Token ids in files: each document compressed alone with one shared dictionary.

File: ``BSID`` · u32 version · sha256 of the dictionary (32) · frames · index ·
trailer. A frame is the Zstandard frame of a document's ids as little-endian
unsigned integers of 2 or 4 bytes. The index has four arrays: document ids (i64),
frame offsets (u64, one more than documents), token counts (u64), id widths (u8).
Trailer: u64 offset of the index · u64 documents · ``BSID``.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace
from .textarrays import release, slices
from .tokens import default_path, encoder

MAGIC, VERSION = b"BSID", 1
NULL_ID = -(2**63)
#: Of a sampled document longer than PARTS * PART bytes of ids, so many parts of so many bytes train the dictionary.
PARTS, PART = 4, 1 << 14


def _serialized(ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[memoryview, int]]:
    """Each document's ids in 2 bytes each if all fit, else in 4, and that width."""
    wide, fits = memoryview(ids.view(np.uint8)), not len(ids) or int(ids.max()) < 65536
    narrow = memoryview((ids if fits else ids & np.uint32(0xFFFF)).astype("<u2").view(np.uint8))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield (narrow[2 * a : 2 * b], 2) if fits or not (ids[a:b] > 65535).any() else (wide[4 * a : 4 * b], 4)


def train_dictionary(samples: list[bytes], size: int = 1 << 16) -> bytes:
    """A Zstandard dictionary of serialized id arrays; empty if they are too few."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec_dict(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


class IdFileWriter:
    def __init__(self, stream, dictionary: bytes):
        self.stream = stream
        self.at = stream.write(head := MAGIC + struct.pack("<I", VERSION) + hashlib.sha256(dictionary).digest()) or len(head)
        self.ids, self.offsets, self.counts, self.widths = [], [self.at], [], []

    def add(self, doc_id: int | None, count: int, width: int, frame: bytes) -> None:
        self.stream.write(frame)
        self.at += len(frame)
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.offsets.append(self.at)
        self.counts.append(count)
        self.widths.append(width)

    def finish(self) -> None:
        for x, kind in ((self.ids, "<i8"), (self.offsets, "<u8"), (self.counts, "<u8"), (self.widths, "u1")):
            self.stream.write(np.array(x, kind).tobytes())
        self.stream.write(struct.pack("<QQ4s", self.at, len(self.ids), MAGIC))


class IdFileReader:
    """Random access to documents; ``stream`` is a seekable file with size()."""

    def __init__(self, stream, dictionary: bytes):
        self.stream = stream
        size = stream.size()
        if size < 60:
            raise ValueError("id file is too short")
        stream.seek(0)
        head = stream.read(40)
        if head[:4] != MAGIC or struct.unpack("<I", head[4:8])[0] != VERSION:
            raise ValueError("not an id file of this version")
        if head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError("id file was written with another dictionary")
        stream.seek(size - 20)
        at, n, magic = struct.unpack("<QQ4s", stream.read(20))
        if magic != MAGIC or at + n * 25 + 8 + 20 != size:
            raise ValueError("id file has a damaged index")
        stream.seek(at)
        index = stream.read(n * 25 + 8)
        self.ids = np.frombuffer(index, "<i8", n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 8 * n)
        self.counts = np.frombuffer(index, "<u8", n, 16 * n + 8)
        self.widths = np.frombuffer(index, "u1", n, 24 * n + 8)
        self.codec = zstandard.ZstdDecompressor(dict_data=_codec_dict(dictionary))

    def __len__(self) -> int:
        return len(self.ids)

    def tokens(self, i: int) -> np.ndarray:
        """The ids of document ``i`` of the file."""
        start, stop = int(self.offsets[i]), int(self.offsets[i + 1])
        self.stream.seek(start)
        out = np.frombuffer(self.codec.decompress(self.stream.read(stop - start)), f"<u{self.widths[i]}")
        if len(out) != self.counts[i]:
            raise ValueError("document has another length than its index entry")
        return out


def _encode(path: str, end: int, dictionary: bytes, level: int):
    """Rows (id, tie, text) to (id, tie, n_tokens, width, frame)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        codec = zstandard.ZstdCompressor(level=level, dict_data=_codec_dict(dictionary))
        for batch in batches:
            for a, b in slices(batch.column(2)):
                ids, bounds = known.encode_ended(batch.column(2).slice(a, b - a), end)
                frames, widths = zip(*((codec.compress(x), w) for x, w in _serialized(ids, bounds)))
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(widths, pa.int32()), pa.array(frames, pa.binary())],
                    ["id", "tie", "n_tokens", "width", "frame"],
                )
        release()

    return run


def _samples(path: str, end: int):
    """Texts to samples for the dictionary: PARTS evenly spaced parts of each document's serialized ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                out = []
                for x, _ in _serialized(*known.encode_ended(batch.column(0).slice(a, b - a), end)):
                    if len(x) <= PARTS * PART:
                        out.append(x.tobytes())
                    else:
                        out += [x[at : at + PART].tobytes() for at in np.linspace(0, len(x) - PART, PARTS).astype(np.int64) // 4 * 4]
                yield pa.record_batch([pa.array(out, pa.binary())], ["part"])

    return run


ENCODED = "id long, tie long, n_tokens long, width int, frame binary"


def _write(folder: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.bsid"
        writer = stream = None
        tokens = docs = 0
        for batch in batches:
            if writer is None and len(batch):
                stream = store.open_output_stream(name)
                writer = IdFileWriter(stream, dictionary)
            for doc_id, n, width, frame in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                writer.add(doc_id, n, width, frame)
                tokens, docs = tokens + n, docs + 1
        if writer is not None:
            writer.finish()
            stream.close()
            yield pa.record_batch([pa.array([x]) for x in (task.partitionId(), name, docs, tokens)], ["part", "path", "docs", "tokens"])

    return run


def _read(folder: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(path) as stream:
                    reader = IdFileReader(stream, dictionary)
                    starts = base + np.concatenate([[0], np.cumsum(reader.counts.astype(np.int64))])
                    for a in range(0, len(reader), 1000):
                        some = range(a, min(a + 1000, len(reader)))
                        crcs = [zlib.crc32(reader.tokens(i).astype("<u4").tobytes()) for i in some]
                        ids = reader.ids[a : some.stop]
                        yield pa.record_batch(
                            [pa.array(ids, mask=ids == NULL_ID), pa.array(starts[a : some.stop]), pa.array(reader.counts[a : some.stop].astype(np.int64)), pa.array(crcs, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return run


class IdFiles:
    """A written set of files: ``manifest`` has (part, path, docs, tokens, start), one row a file in id order."""

    def __init__(self, folder: str, dictionary: bytes, manifest: DataFrame):
        self.folder, self.dictionary, self.manifest = folder, dictionary, manifest

    def digests(self) -> DataFrame:
        """Read every file: doc_id, start (ids before the document), n_tokens, ids_crc32."""
        files = max(1, self.manifest.count())
        dealt = self.manifest.select("path", "start").repartition(files)
        return dealt.mapInArrow(_read(self.folder, self.dictionary), "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_id_files(
    docs: DataFrame, path: str | None = None, end: int = 0, sample: int = 1000, docs_per_file: int = 20_000, level: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> IdFiles:
    """Encode every whole text, append ``end``, and write the ids in ascending order of ids.

    The shared dictionary is trained on at most ``sample`` documents of any length, those
    with the smallest hash of their ids, at most 64 KiB of each; its bytes lie beside the
    files and its sha256 in each. Null and empty texts are the end id alone. Null ids
    come first; rows that share an id are ordered by a hash of their text. An empty
    table writes no file. Ids must be integers above -2**63. Further columns are ignored.
    """
    spark = docs.sparkSession
    path = path or default_path()
    work = Workspace(spark, "idfiles")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).cast("string").alias("text"))
    keys = source.select(F.col("id").alias("_id"), F.col("tie").alias("_tie")).orderBy(F.xxhash64("_id"), "_tie").limit(sample)  # ids and hashes only
    chosen = source.join(F.broadcast(keys), F.col("id").eqNullSafe(F.col("_id")) & F.col("tie").eqNullSafe(F.col("_tie")), "left_semi")
    chosen = chosen.dropDuplicates(["id", "tie"]).select("text")
    rows = work.table("sample", chosen).mapInArrow(_samples(path, end), "part binary").collect()
    dictionary = train_dictionary([bytes(r["part"]) for r in rows])
    encoded = work.table("encoded", source.mapInArrow(_encode(path, end, dictionary, level), ENCODED), "none")

    files = max(1, -(-encoded.count() // docs_per_file))
    folder = work.path("files")
    ordered = encoded.repartitionByRange(files, F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")
    manifest = work.table("manifest", ordered.mapInArrow(_write(folder, dictionary), "part long, path string, docs long, tokens long"))
    work.drop("encoded")
    if manifest.limit(1).count():
        store, root = fs.FileSystem.from_uri(folder)
        with store.open_output_stream(f"{root}/dictionary.zstd") as out:
            out.write(dictionary)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return IdFiles(folder, dictionary, manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))))
