"""Repeated byte strings across and within texts, by prefix doubling of position ranks.

Positions are ranked by growing prefixes: rows (rank, name of the bytes at the offset
that the rank reaches) are sorted over all tasks by range, equal pairs get the next rank,
and a position whose pair is unique is dropped; the rest is ranked anew at 64, 128 and
200 bytes, until it is unique or past the length. ``_ranked`` is the one round, for every
kind of unit below. Ranks are dense numbers over the whole table: each task numbers its
pairs, and the first and last pair of every task, gathered on the driver, join what a
border has split. So a pair that a third of all rows share is dealt over many tasks.

Three kinds of unit keep most positions out of the sort:

1. Every string of ``length`` bytes holds one anchor: the position in its first bytes
   whose 64-byte prefix has the smallest hash (ties: the leftmost). Equal strings have
   the same anchor at the same offset. Anchors are ranked by their first 64 bytes; the
   strings of a unique one occur once. The next round compares the whole context that the
   strings of an anchor cover, and settles all strings of equal contexts.
2. The ragged ends of repeats are cut into runs of eight start positions, at the same
   distances from the anchor everywhere. Runs are ranked by the bytes that their strings
   share, at 64 and 128 bytes and as a whole; the last round compares all their bytes.
3. What is left is ranked start by start, at 64, 128 and all bytes.

The name of a part is a 64-bit hash of its bytes, always compared beside the rank of all
bytes before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace
from .textarrays import BYTE, U64, flat, mix, powers, release, slices

#: Bytes that the first rank compares; the second compares twice as many.
PREFIX = 64
#: Start positions of one document that are handled at once.
SEGMENT = 1 << 20
#: Start positions in a run.
RUN = 8
#: Rows that a task of a sort should have; rows that a task holds to see a rank as a whole.
TASK_ROWS, HELD = 1_000_000, 50_000
#: Low bits of a packed minimum that hold the position.
_PLACE = 24


def _sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data)), out=sums[1:])
    return sums


def _hash(sums: np.ndarray, starts, ends) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums), "down")[starts])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` successive values."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, sums: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of start positions with the same anchor: (first start, last start, anchor)."""
    n = len(data)
    prefixes = _hash(sums, np.arange(n - PREFIX + 1), np.arange(PREFIX, n + 1))
    packed = (prefixes >> U64(_PLACE) << U64(_PLACE)) | np.arange(len(prefixes), dtype=np.uint64)
    at = (_sliding_min(packed, length - PREFIX + 1) & U64((1 << _PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return first, np.append(first[1:], len(at)) - 1, at[first]


def _pieces(column: pa.Array, length: int, segment: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, rows, offsets in the row's text) of parts of whole texts, each with ``length`` - 1 bytes of what follows."""
    data, offsets = flat(column)
    segment = segment or SEGMENT
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        for s in range(a, b - length + 1, segment):
            yield data[s : min(b, s + segment + length - 1)], i, s - a


def unit_schema(names: int) -> str:
    """Of units with so many names left to compare: the rank so far, the names, where the unit's starts are."""
    return ", ".join(["rank long", *[f"name{i} long" for i in range(names)], "id long, lo long, n int, d int"])


def _units(names: list[np.ndarray], id_: pa.Array, lo: np.ndarray, n: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    """Units whose starts are ``lo`` to ``lo`` + ``n``, ``d`` before their anchor at first, with the names of their parts in turn."""
    parts = [np.zeros(len(lo), np.int64), *[x.view(np.int64) for x in names]]
    columns = [*map(pa.array, parts), id_, pa.array(lo.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(d.astype(np.int32))]
    return pa.record_batch(columns, [x.split()[0] for x in unit_schema(len(names)).split(", ")])


def _anchor_rows(length: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                out = []
                for data, row, start in _pieces(batch.column(1).slice(a, b - a), length, segment):
                    sums = _sums(data)
                    lo, hi, at = anchors(data, sums, length)
                    prefix = _hash(sums, at, at + PREFIX)
                    shape = (at - lo).astype(np.uint64) * U64(1 << 20) + (hi - lo).astype(np.uint64)
                    context = mix(_hash(sums, lo, hi + length) + shape)
                    out.append((prefix, context, np.full(len(lo), row), lo + start, hi - lo, at - lo))
                    if sum(len(x[0]) for x in out) > 100_000:
                        yield _anchored(out, batch, a, b)
                        out = []
                if out:
                    yield _anchored(out, batch, a, b)
        release()

    return run


def _anchored(out: list, batch: pa.RecordBatch, a: int, b: int) -> pa.RecordBatch:
    prefix, context, row, lo, n, d = (np.concatenate(x) for x in zip(*out))
    return _units([prefix, context], batch.column(0).slice(a, b - a).take(pa.array(row)), lo, n, d)


def _chunks(batches: Iterator[pa.RecordBatch], by_rank: bool) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Batches, and whether the last rank of each may go on; with ``by_rank`` only a rank of very many rows and the last one of all do."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        if not by_rank:
            yield batch, True
            continue
        held.append(batch)
        size += len(batch)
        if size >= HELD and (np.asarray(batch.column(0))[-1] != held[0].column(0)[0].as_py() or size >= 4 * HELD):
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            rank = np.asarray(whole.column(0))
            cut = int(np.searchsorted(rank, rank[-1])) or size
            yield whole.slice(0, cut), cut == size
            held, size = [whole.slice(cut)] if cut < size else [], size - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], True


#: What a round adds to units.
MARKS = "part int, nth long, many boolean, on boolean, tells array<long>"
_TELLS = pa.list_(pa.int64())


def _marked(settle: bool, least: int):
    """Units sorted by (rank, name0): each with its pair's number in the task, whether the pair has ``many`` rows, and whether it is ``on``.

    Unique pairs are left out, but the first and the last of the task. With ``settle``
    they stay ``on`` for the next kind of unit, and so does one row of each repeated
    pair, unless all rows of its rank are alike; units with ``n`` under ``least`` have no
    name of their own and count as unique. The last row ``tells`` the first pair, the
    last pair, the count of pairs and whether the first and the last may lie in a
    neighbouring task too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        count, key, pending, first, open_ = 0, None, None, None, True
        ends = [False, False]

        def out(chunk: pa.RecordBatch, nth: np.ndarray, many: np.ndarray, on: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
            marks = [pa.array(np.full(len(chunk), part, np.int32)), pa.array(nth), pa.array(many), pa.array(on), pa.nulls(len(chunk), _TELLS)]
            return pa.record_batch([*chunk.columns, *marks], [*chunk.schema.names, *(x.split()[0] for x in MARKS.split(", "))]).filter(pa.array(keep))

        for chunk, goes_on in _chunks(batches, settle):
            if pending is not None:
                chunk, key, count = pa.Table.from_batches([pending, chunk]).combine_chunks().to_batches()[0], None, count - 1
            rank, name = np.asarray(chunk.column(0)), np.asarray(chunk.column(1))
            alone = np.asarray(chunk.column("n")) < least
            if first is None:
                first, ends[0] = (int(rank[0]), int(name[0])), not alone[0]
            new_rank = np.append(True, rank[1:] != rank[:-1])
            new = new_rank | np.append(True, name[1:] != name[:-1]) | alone | np.append(False, alone[:-1])
            new[0] = alone[0] or key != (int(rank[0]), int(name[0]))
            local = np.cumsum(new) - new[0]
            sizes = np.bincount(local)
            sizes[0] += 0 if new[0] else 2
            nth = local + count - (0 if new[0] else 1)
            count = int(nth[-1]) + 1
            many, on = sizes[local] > 1, np.zeros(len(chunk), bool)
            if settle:
                group = np.cumsum(new_rank) - 1
                kinds = np.bincount(group, new)
                kinds[0] += 2 * open_
                kinds[-1] += 2 * goes_on
                on = new & (kinds[group] > 1)
            last = (int(rank[-1]), int(name[-1]))
            open_, ends[1], key = goes_on, not alone[-1], None if alone[-1] else last
            pending = chunk.slice(len(chunk) - 1) if goes_on and not many[-1] and not alone[-1] else None
            keep = many | on | (nth == 0)
            keep[-1] &= pending is None
            if keep.any():
                yield out(chunk, nth, many, on, keep)
        if pending is not None:
            yield out(pending, np.array([count - 1]), np.array([False]), np.array([settle]), np.array([True]))
        if first is not None:
            names, kinds = chunk.schema.names, chunk.schema.types
            tells = pa.array([[*first, *last, count, *map(int, ends)]], _TELLS)
            marks = [pa.array([part], pa.int32()), pa.array([-1], pa.int64()), pa.array([False]), pa.array([False]), tells]
            yield pa.record_batch([*[pa.array([0], k) for k in kinds], *marks], [*names, *(x.split()[0] for x in MARKS.split(", "))])

    return run


def _borders(rows: list[tuple[int, list[int]]]) -> pa.Table:
    """From what each task tells: the number of pairs before its own, and whether its first and last pair lie in a neighbour too."""
    parts, base, split, pairs, total, before = [], [], [], [], 0, None
    for part, (*ends, count, may_head, may_tail) in sorted(rows):
        joined = bool(before and may_head and before == ends[:2])
        parts.append(part)
        split.append(joined)
        base.append(total - joined)
        pairs.append(count)
        total += count - joined
        before = ends[2:] if may_tail else None
    columns = [pa.array(parts, pa.int32()), pa.array(base, pa.int64()), pa.array(split, pa.bool_()), pa.array([*split[1:], False][: len(parts)], pa.bool_()), pa.array(pairs, pa.int64())]
    return pa.table(columns, ["part", "base", "head", "tail", "pairs"])


class _Rounds:
    """Rounds of ranking over tables in the shared folder; a round's table goes when the next one is written."""

    def __init__(self, work: Workspace, partitions: int):
        self.work, self.least, self.n = work, partitions, 0

    def ranked(self, units: DataFrame, settle: bool = False, least: int = 0) -> DataFrame:
        """One round: ``units`` with the new rank and one name less, ``many`` and ``on``; unique units are gone unless ``on``."""
        columns = [c for c in units.columns if c not in ("many", "on")]
        tasks = max(self.least, -(-units.count() // TASK_ROWS))
        dealt = units.select(columns).repartitionByRange(tasks, "rank", "name0", "id", "lo").sortWithinPartitions("rank", "name0")
        schema = unit_schema(len(columns) - 5) + ", " + MARKS
        found = self.work.table(f"round{self.n + 1}", dealt.mapInArrow(_marked(settle, least), schema))
        self.drop_last()
        self.n += 1
        told = found.where("nth < 0").select("part", "tells").collect()  # a row for each task of the sort
        borders = self.work.spark.createDataFrame(_borders([(r["part"], list(r["tells"])) for r in told]))
        rows = found.where("nth >= 0").join(F.broadcast(borders), "part")
        again = F.col("many") | (F.col("nth") == 0) & F.col("head") | (F.col("nth") == F.col("pairs") - 1) & F.col("tail")
        rows = rows.withColumn("many", again & (F.col("n") >= least)).where("many or on")
        names = [F.col(f"name{i + 1}").alias(f"name{i}") for i in range(len(columns) - 6)]
        return rows.select((F.col("base") + F.col("nth")).alias("rank"), *names, "id", "lo", "n", "d", "many", "on")

    def narrowed(self, units: DataFrame, rounds: int) -> DataFrame:
        """``rounds`` rounds, each over what the one before left."""
        for _ in range(rounds):
            units = self.ranked(units)
        return units

    def drop_last(self) -> None:
        self.work.drop(f"round{self.n}")


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The strings data[start:start + size] as a binary array."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - ends + sizes, sizes)
    at += np.arange(len(at))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[at])])


def _contexts(length: int):
    """Rows (id, text, runs) to one row for each run with the bytes that its strings cover, a MiB of them at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in slices(whole.column(1)):
                batch = whole.slice(a, b - a)
                data, offsets = flat(batch.column(1))
                runs, counts = batch.column(2).flatten(), np.asarray(batch.column(2).value_lengths()).astype(np.int64)
                row = np.repeat(np.arange(len(batch)), counts)
                lo, n, d = (np.asarray(runs.field(j)).astype(np.int64) for j in range(3))
                sizes, doc = n + length, np.asarray(batch.column(0))
                ends = np.cumsum(sizes)
                at = 0
                while at < len(row):
                    stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + (1 << 20), "right")))
                    part = slice(at, stop)
                    yield pa.record_batch(
                        [pa.array(doc[row[part]]), pa.array((lo + d)[part]), pa.array(lo[part]), pa.array(n[part].astype(np.int32)), _gather(data, (offsets[row] + lo)[part], sizes[part])],
                        ["id", "anchor", "lo", "n", "bytes"],
                    )
                    at = stop

    return run


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers repeated by their counts, and 0, 1, ... within each row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _run_rows(length: int):
    """Rows (id, anchor, lo, n, bytes) to runs at fixed distances from the anchor, named by the parts of their shared bytes and by all bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.slice(at, 4096)
                anchor, lo, n = (np.asarray(batch.column(i)).astype(np.int64) for i in range(1, 4))
                data, offsets = flat(batch.column(4))
                sums = _sums(data)
                far, near = anchor - lo, anchor - lo - n
                row, step = _spread(far // RUN - near // RUN + 1)
                s = near[row] // RUN + step
                most, least = np.minimum(RUN * s + RUN - 1, far[row]), np.maximum(RUN * s, near[row])
                zero = offsets[row] + far[row]  # of the anchor in data
                core, end = zero - RUN * s, zero - RUN * s - RUN + 1 + length
                full = most - least == RUN - 1
                all_ = np.zeros(len(row), np.uint64)
                all_[full] = _hash(sums, (zero - most)[full], (zero - least + length)[full])
                cuts = [core, core + PREFIX, core + 2 * PREFIX, end]
                names = [*(_hash(sums, x, y) for x, y in zip(cuts, cuts[1:])), all_]
                names[0] = mix(names[0] + s.astype(np.uint64))
                yield _units(names, batch.column(0).take(pa.array(row)), anchor[row] - most, most - least, most)

    return run


def _string_rows(length: int):
    """Rows (id, lo, n, d, first, bytes) to units of one start each; ``first`` is where bytes start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 4096):
                batch = whole.slice(a, 4096)
                lo, n, d, first = (np.asarray(batch.column(i)).astype(np.int64) for i in range(1, 5))
                data, offsets = flat(batch.column(5))
                sums = _sums(data)
                row, step = _spread(n + 1)
                start = offsets[row] + (lo - first)[row] + step
                cuts = [start, start + PREFIX, start + 2 * PREFIX, start + length]
                names = [_hash(sums, x, y) for x, y in zip(cuts, cuts[1:])]
                yield _units(names, batch.column(0).take(pa.array(row)), lo[row] + step, np.zeros(len(row), np.int64), d[row] - step)

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, text, spans, carry) to the cut text and its figures, a MiB of text at once."""
    for whole in batches:
        for a, b in slices(whole.column(1)):
            batch, rows = whole.slice(a, b - a), []
            for i in range(len(batch)):
                text, spans = batch.column(1)[i].as_buffer(), batch.column(2)[i].values
                data = memoryview(text) if text is not None else b""
                kept, removed, runs = [], 0, []
                if spans is not None and len(spans):
                    lo, hi = (np.asarray(spans.field(j)) for j in (0, 1))
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    new = np.append(True, lo[1:] > hi[:-1])
                    runs = list(zip(lo[new].tolist(), hi[np.append(new[1:], True)].tolist()))
                at = 0
                for x, y in runs:
                    kept.append(data[at:x])
                    removed += y - x
                    at = y
                kept.append(data[at:])
                left = b"".join(kept)
                rows.append((len(data), removed, len(runs), hashlib.sha256(left).hexdigest(), left, [x for x, _ in runs], [y for _, y in runs]))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "starts", "ends", "carry"]
            yield pa.record_batch([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds)), batch.column(3)], names)


APPLIED = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, starts array<long>, ends array<long>"


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, kept, starts, ends.

    Removed is each byte that lies in a string of ``length`` bytes which also starts
    anywhere else in the table, in the same text or another; every place of the string
    counts and strings are judged on the input. ``kept`` are the bytes left,
    [starts, ends) the removed runs. Null texts are empty. Ids identify texts: rows
    that repeat an id must repeat its text, and are then copies like any others. Rows
    with a null id are known by a hash of their text; other ids must then not be
    negative. Columns named in ``carry`` come along in a struct of that name; others
    are ignored. An empty table gives no rows.
    """
    if length < 2 * PREFIX + RUN or length > 1 << 16:
        raise ValueError(f"length must be from {2 * PREFIX + RUN} to 65536")
    spark = docs.sparkSession
    work = Workspace(spark, "suffixes")
    rounds = _Rounds(work, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    doc, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    source = docs.select(doc.alias("doc"), text.cast("binary").alias("text"), F.coalesce(doc, F.xxhash64(text).bitwiseOR(F.lit(-(2**63)))).alias("id"), F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("carry"))
    spans = lambda units: units.select("id", "lo", (F.col("lo") + F.col("n") + length).alias("hi"))

    found = work.table("anchors", source.select("id", "text").mapInArrow(_anchor_rows(length, SEGMENT), unit_schema(2)))
    groups = rounds.ranked(found)
    work.drop("anchors")
    known = rounds.ranked(groups, settle=True)
    whole = work.table("whole1", spans(known.where("many")))
    ragged = known.where("on").groupBy("id").agg(F.collect_set(F.struct("lo", "n", "d")).alias("runs"))
    contexts = source.join(ragged, "id").select("id", "text", "runs").mapInArrow(_contexts(length), "id long, anchor long, lo long, n int, bytes binary")
    contexts = work.table("contexts", contexts)

    runs = work.table("runs", contexts.mapInArrow(_run_rows(length), unit_schema(4)))
    cores = rounds.narrowed(runs, 3)
    work.drop("runs")
    known = rounds.ranked(cores, settle=True, least=RUN - 1)
    whole = whole.unionByName(work.table("whole2", spans(known.where("many"))))

    # Starts on both sides of a segment's end can have one anchor, but each a context of its own.
    segment = F.floor(F.col("lo") / SEGMENT).alias("segment")
    left = known.where("on").select("id", "lo", "n", "d", (F.col("lo") + F.col("d")).alias("anchor"), segment)
    left = left.join(contexts.select("id", "anchor", segment, F.col("lo").alias("first"), "bytes"), ["id", "anchor", "segment"])
    strings = work.table("strings", left.select("id", "lo", "n", "d", "first", "bytes").mapInArrow(_string_rows(length), unit_schema(3)))
    work.drop("contexts")
    whole = whole.unionByName(spans(rounds.narrowed(strings, 3)))
    work.drop("strings")

    whole = whole.groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    carried = source.schema["carry"].dataType.simpleString()
    done = source.join(whole, "id", "left").select("doc", "text", "spans", "carry").mapInArrow(_apply, f"{APPLIED}, carry {carried}")
    done = done.withColumnRenamed("doc", id_col)
    return done if carry else done.drop("carry")
