"""Near duplicates by HyperMinHash registers, banding and exact confirmation.

Texts with equal shingle sets are first folded into one representative. Each
representative's shingle hashes fall into buckets by their top bits; a bucket keeps
the leading-zero count of its smallest hash and the mantissa bits that follow, in
8 bits. Empty buckets borrow from others, so that short texts can be banded too.
Representatives that share a band are compared with one of them (the hub of the
band); links are estimated from the registers with a correction for chance
collisions, and those that could reach the threshold are confirmed on the full
sets. Where a band still holds several components after that, members of different
components are compared in blocks, twice: first along a spanning tree of the best
estimates, then to mark members that could link to another component at all. Pairs of
marked members come from the shingles: two sets that reach the threshold share one of
their rarest, so members that have only common shingles in common, such as texts from one
template, give no pairs. So no candidate link is lost, and neither copies of one text nor
texts just under the threshold give all their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Workspace
from .textarrays import U64, mix, release, shingle_sets, slices

#: log2 of the buckets; bits of a register's mantissa (its leading-zero count has 5).
P, MANTISSA = 9, 3
M = 1 << P
EMPTY = 255
#: Registers that are banded.
BANDED = 256
#: How often two different minima agree: their leading-zero counts by 0.36, their mantissas by chance.
CHANCE = 0.36 * 2.0**-MANTISSA
#: Hashes of a set up to which 16 bits of each are kept.
SHORT = 512
#: Buckets that an empty one looks at one by one; a set with fewer full ones ranks them instead.
TRIES = 16
#: Members of a block of a band; pairs of members that are looked at at once.
BLOCK, PAIRS = 512, 1 << 16


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows with which a link at the threshold is missed at most once in a million."""
    t = percent / 100
    rows = max((r for r in range(1, 17) if (1 - t**r) ** (BANDED // r) <= 1e-6), default=1)
    return BANDED // rows, rows


def _fill_order() -> np.ndarray:
    """For each bucket a fixed order in which it looks at the others when empty."""
    return np.stack([np.random.Generator(np.random.PCG64(7919 + i)).permutation(M) for i in range(M)]).astype(np.int16)


@cache
def _fill_ranks() -> np.ndarray:
    """Where each bucket stands in the orders of the others."""
    return np.argsort(_fill_order(), 1).astype(np.int16)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """uint8 registers (len(sets), M); EMPTY where a bucket is empty."""
    out = np.full((len(sets), M), EMPTY, np.uint8)
    bounds = np.arange(M, dtype=np.uint64) << U64(64 - P)
    for i, one in enumerate(sets):
        if len(one):
            at = np.searchsorted(one, bounds)
            last = np.append(at[1:], len(one))
            full = last > at
            rest = one[at[full]] << U64(P)
            zeros = 63 - np.frexp((rest >> U64(11)).astype(np.float64))[1] - 10
            zeros = np.clip(zeros, 0, 30)
            mantissa = (rest << (zeros + 1).astype(np.uint64)) >> U64(64 - MANTISSA)
            out[i, full] = ((zeros << MANTISSA) | mantissa.astype(np.int64)).astype(np.uint8)
    return out


def filled(regs: np.ndarray, order: np.ndarray, count: int = M) -> np.ndarray:
    """The first ``count`` registers, in which each empty bucket has the value of the first full one in its order."""
    full = regs != EMPTY
    out = regs[:, :count].copy()
    row, bucket = np.nonzero(~full[:, :count] & full.any(1)[:, None])
    for k in range(TRIES):
        if not len(row):
            return out
        seek = order[bucket, k]
        hit = full[row, seek]
        out[row[hit], bucket[hit]] = regs[row[hit], seek[hit]]
        row, bucket = row[~hit], bucket[~hit]
    ranks = _fill_ranks() if len(row) else None
    edges = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else []
    for a, b in zip(edges, [*edges[1:], len(row)]):
        some = np.flatnonzero(full[row[a]])
        out[row[a], bucket[a:b]] = regs[row[a], some[ranks[bucket[a:b]][:, some].argmin(1)]]
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates, corrected for chance collisions, and the count of buckets behind each.

    Two different minima agree by chance if both leading-zero count and mantissa
    agree.
    """
    used = ((a != EMPTY) | (b != EMPTY)).sum(-1)
    same = ((a == b) & (a != EMPTY)).sum(-1)
    chance = used * CHANCE
    return np.clip((same - chance) / np.maximum(used - chance, 1), 0, 1), used


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that can reach the threshold: sizes allow it and the estimate is within five deviations."""
    t = percent / 100
    score, used = estimate(a, b)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (score >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(used, 1)) - 1 / M)


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    one = np.array([mix(x).sum(dtype=np.uint64) for x in sets], np.uint64) if sets else np.zeros(0, np.uint64)
    two = np.array([mix(x ^ U64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) for x in sets], np.uint64) if sets else np.zeros(0, np.uint64)
    return one.view(np.int64), two.view(np.int64)


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _low(one: np.ndarray) -> bytes:
    """The sorted low 16 bits of a short set's hashes; nothing for others."""
    return np.sort((one & U64(0xFFFF)).astype(np.uint16)).tobytes() if len(one) <= SHORT else b""


def _common(a: bytes, b: bytes) -> int:
    """Intersection of two sorted multisets of 16-bit integers."""
    values, counts = np.unique(np.frombuffer(a, np.uint16), return_counts=True)
    others, more = np.unique(np.frombuffer(b, np.uint16), return_counts=True)
    at = np.searchsorted(others, values).clip(max=len(others) - 1)
    return int(np.minimum(counts, more[at])[others[at] == values].sum())


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers repeated by their counts, and 0, 1, ... within each row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _band_keys(regs: np.ndarray, order: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """uint64 keys (len(regs), bands)."""
    regs = filled(regs, order, bands * rows).astype(np.uint64).reshape(len(regs), bands, rows)
    keys = np.full((len(regs), bands), 1, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        keys = mix(keys * U64(0xD6E8FEB86659FD93) + regs[:, :, j] + U64(1))
    return keys


def _sketcher(k: int, bands: int, rows: int):
    order = _fill_order()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(a, b - a), k)
                d1, d2 = _digests(sets)
                regs = registers(sets)
                keys = _band_keys(regs, order, bands, rows)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a), pa.array(d1), pa.array(d2), pa.array([len(x) for x in sets], pa.int64()), _binary([x.tobytes() for x in regs]),
                        _binary([_low(x) for x in sets]), _binary([x.tobytes() for x in keys]),
                    ],
                    ["id", "d1", "d2", "n", "regs", "low", "keys"],
                )
        release()

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), M)


def _bander(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 2048):
                batch = whole.slice(a, 2048)
                keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
                again = pa.array(np.repeat(np.arange(len(batch)), bands))
                yield pa.record_batch([pa.array(keys), batch.column(0).take(again), batch.column(1).take(again)], ["key", "rep", "n"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, rep): key, first rep of the key in this partition, rep, n, the first's n.

    Keys with one row are left out, but for the partition's first and last key, whose
    other rows may be in the neighbouring partitions.
    """
    held = None  # the rows of the key at the end of what was read: (key, rep, n) or its hub and whether it has more
    first = True

    def out(key, hub, hub_n, rep, n):
        return pa.record_batch([pa.array(x, pa.int64()) for x in (key, hub, rep, n, hub_n)], ["key", "hub", "rep", "n", "hub_n"])

    for batch in batches:
        if not len(batch):
            continue
        key, rep, n = (np.asarray(batch.column(i)) for i in range(3))
        hub0, open_ = None, False
        if held is not None:
            pending, k0, h0, hn0 = held
            if pending:
                key, rep, n = np.append(k0, key), np.append(h0, rep), np.append(hn0, n)
            elif key[0] == k0:
                hub0, open_ = (h0, hn0), True
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        hub, hub_n = rep[starts], n[starts]
        if open_:
            hub[0], hub_n[0] = hub0
        sizes = np.diff(np.append(starts, len(key)))
        keep = sizes > 1
        keep[0] |= open_ or first
        pending = not keep[-1]
        held = (pending, key[-1], hub[-1], hub_n[-1])
        first = False
        mask = keep[group]
        if mask.any():
            yield out(key[mask], hub[group][mask], hub_n[group][mask], rep[mask], n[mask])
    if held is not None and held[0]:
        yield out([held[1]], [held[2]], [held[3]], [held[2]], [held[3]])


def _estimator(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                a, b, na, nb = (batch.column(i) for i in range(4))
                good = may_link(_matrix(batch.column(4)), _matrix(batch.column(5)), np.asarray(na), np.asarray(nb), percent)
                yield pa.record_batch([a.filter(pa.array(good)), b.filter(pa.array(good))], ["a", "b"])

    return run


def _set_maker(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(a, b - a), k)
                yield pa.record_batch([batch.column(0).slice(a, b - a), _binary([x.tobytes() for x in sets])], ["id", "hashes"])

    return run


def _confirmer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                x, y = (np.frombuffer(batch.column(j)[i].as_buffer(), np.uint64) for j in (2, 3))
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.record_batch([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], ["a", "b"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str], least: int = 2048) -> Iterator[pa.RecordBatch]:
    """Sorted batches again, cut where ``columns`` change; a group has a bounded number of rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= least:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            last = np.ones(size, bool)
            for c in columns:
                x = np.asarray(whole.column(c))
                last &= x == x[-1]
            cut = int(last.argmax())
            if cut:
                yield whole.slice(0, cut)
            held, size = [whole.slice(cut)], size - cut
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _forest(a: np.ndarray, b: np.ndarray, score: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Pairs of a spanning forest of the labels, the best scores first."""
    up: dict[int, int] = {}
    chosen = []
    for k in np.argsort(-score, kind="stable").tolist():
        x, y = int(label[a[k]]), int(label[b[k]])
        while (above := up.get(x, x)) != x:
            up[x] = x = up.get(above, above)
        while (above := up.get(y, y)) != y:
            up[y] = y = up.get(above, above)
        if x != y:
            up[x] = y
            chosen.append(k)
    return np.array(chosen, np.int64)


def _crosser(percent: int, mode: str):
    """Groups (key, i, j), sorted, to pairs (a, b) of different components that may link: of sides 0 and 1, or of side 2 with itself.

    ``tree``: only a spanning forest of a group's best estimates. ``members``: each member
    that has such a pair, as (member, member). ``pairs``: all of them that share a band and
    whose smaller set has the group's shingle in ``front``.
    """

    def found(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        rep, label, n, side, key, i, j = (np.asarray(batch.column(c)) for c in ("rep", "label", "n", "side", "key", "i", "j"))
        regs, low = _matrix(batch.column("regs")), batch.column("low").to_pylist()
        if mode == "pairs":
            keys, front = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64).reshape(len(rep), -1), batch.column("front").to_numpy(zero_copy_only=False)
        new = np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        group = np.cumsum(new) - 1
        stop = np.append(np.flatnonzero(new)[1:], len(rep))[group]
        middle = np.flatnonzero(new)[group] + np.bincount(group, side == 0).astype(np.int64)[group]
        start = np.where(side == 2, np.arange(len(rep)) + 1, middle)
        count = np.where(side == 1, 0, stop - start)
        ends, at, marked = np.cumsum(count), 0, np.zeros(len(rep), bool)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while at < len(rep):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            a, step = _spread(count[at:to])
            a += at
            b = start[a] + step
            good = (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
            if mode == "members":
                good &= ~(marked[a] & marked[b])
            if mode == "pairs":
                good &= front[a] & (n[a] <= n[b]) | front[b] & (n[b] <= n[a])
            a, b = a[good], b[good]
            for x in range(0, len(a), 4096):
                c, d = a[x : x + 4096], b[x : x + 4096]
                good = may_link(regs[c], regs[d], n[c], n[d], percent)
                c, d = c[good], d[good]
                if mode == "pairs":
                    good = (keys[c] == keys[d]).any(1)
                    c, d = c[good], d[good]
                if mode != "tree":
                    good = [not low[u] or not low[v] or (100 + percent) * _common(low[u], low[v]) >= percent * (n[u] + n[v]) for u, v in zip(c.tolist(), d.tolist())]
                    c, d = c[np.array(good, bool)], d[np.array(good, bool)]
                marked[c] = marked[d] = True
                out.append((c, d))
            at = to
        if mode == "members":
            return np.flatnonzero(marked), np.flatnonzero(marked)
        a, b = (np.concatenate(x) for x in zip(*out))
        if mode == "tree" and len(a):
            score, order = estimate(regs[a], regs[b])[0] if len(a) <= 4096 else np.concatenate([estimate(regs[a[x : x + 4096]], regs[b[x : x + 4096]])[0] for x in range(0, len(a), 4096)]), np.argsort(group[a], kind="stable")
            a, b, score = a[order], b[order], score[order]
            edges = np.flatnonzero(np.append(True, group[a[1:]] != group[a[:-1]]))
            chosen = np.concatenate([x + _forest(a[x:y], b[x:y], score[x:y], label) for x, y in zip(edges, [*edges[1:], len(a)])])
            a, b = a[chosen], b[chosen]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, ["key", "i", "j"]):
            rep = np.asarray(batch.column("rep"))
            a, b = found(batch)
            yield pa.record_batch([pa.array(np.minimum(rep[a], rep[b])), pa.array(np.maximum(rep[a], rep[b]))], ["a", "b"])

    return run


def _token_rows(k: int):
    """Rows (rep, text, n, label) to a row for each shingle of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(a, b - a), k)
                row = np.repeat(np.arange(a, b), [len(x) for x in sets])
                hashes = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                for at in range(0, len(row), 1 << 17):
                    own = pa.array(row[at : at + (1 << 17)])
                    yield pa.record_batch([batch.column(0).take(own), pa.array(hashes[at : at + (1 << 17)]), batch.column(2).take(own), batch.column(3).take(own)], ["rep", "h", "n", "label"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Texts are linked if the intersection of their sets of ``k``-word shingles is at
    least ``percent`` hundredths of the union; component_id is the smallest id that
    links lead to. Words are runs without space and control characters 9 to 13; only
    A-Z are lowered. A text with fewer than ``k`` words is one shingle. Null texts and
    texts without words are linked with nothing. A null id is linked with nothing:
    its component_id is null and it is kept. Ids must be integers; rows that repeat
    an id must repeat its text, and share their result. Further columns are ignored.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "minhash")
    bands, rows = bands_for(percent)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = work.table("sketch", source.mapInArrow(_sketcher(k, bands, rows), "id long, d1 long, d2 long, n long, regs binary, low binary, keys binary"))
    same = [F.first(c).alias(c) for c in ("n", "regs", "low", "keys")]
    reps = work.table("reps", sketch.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"), *same))

    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    banded = reps.select("rep", "n", "keys").mapInArrow(_bander(bands), "key long, rep long, n long")
    stars = work.table(
        "stars", banded.repartitionByRange(partitions, "key", "rep").sortWithinPartitions("key", "rep").mapInArrow(_stars, "key long, hub long, rep long, n long, hub_n long")
    )
    hubs = stars.where("hub = rep").groupBy("key").agg(F.min("hub").alias("hub"), F.count("*").alias("c")).where("c > 1").select("key", F.col("hub").alias("top"))
    tops = stars.where("hub = rep").join(hubs, "key").where("hub <> top").select(F.col("top").alias("a"), F.col("hub").alias("b"))
    pairs = stars.where(f"hub <> rep and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).unionByName(tops).distinct()
    pairs = work.table("pairs", pairs)
    links = _confirmed(pairs, source, reps, work, k, percent, "1", check=True)

    members = work.table("members", stars.select("key", "rep", "n").distinct())
    work.drop("stars")
    labels = components(links, work, "c1")
    crossed = work.table("tree", _crossed(_labelled(members, labels), reps, work, percent, "tree").join(pairs, ["a", "b"], "left_anti"))
    links = links.unionByName(_confirmed(crossed, source, reps, work, k, percent, "2", check=False))
    labels = components(links, work, "c2")
    marked = work.table("marked", _crossed(_labelled(members, labels), reps, work, percent, "members").select(F.col("a").alias("rep")))
    posts = _rare(_labelled(marked.join(reps.select("rep", "n"), "rep"), labels), source, work, k, percent)
    crossed = work.table("rare", _crossed(posts, reps, work, percent, "pairs").join(pairs.unionByName(crossed), ["a", "b"], "left_anti"))
    links = links.unionByName(_confirmed(crossed, source, reps, work, k, percent, "3", check=False))

    final = components(links, work, "last")
    reach = work.table("reach", reps.select("d1", "d2", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("label", "rep").alias("root")))
    out = sketch.select("id", "n", "d1", "d2").join(reach, ["d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("root")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with the label of their component, their own where nothing is linked."""
    return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def _rare(marked: DataFrame, source: DataFrame, work: Workspace, k: int, percent: int) -> DataFrame:
    """(key, rep, n, label, front): for each marked member those of its rarest shingles that another component has too.

    Shingles are ordered by how many members have them, those of one member first. If two
    sets reach the threshold t, the first shingle that they share is one of the first
    n - ceil(t * n) + 1 of either, and in the smaller set it is in ``front``, one of the
    first n - ceil(2 * t / (1 + t) * n) + 1. Shingles in front of none are left out.
    """
    texts = source.join(marked.withColumnRenamed("rep", "id"), "id").dropDuplicates(["id"]).select("id", "text", "n", "label")
    tokens = work.table("tokens", texts.mapInArrow(_token_rows(k), "rep long, h long, n long, label long"))
    shared = tokens.groupBy("h").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("c > 1").select("h", "c", (F.col("lo") < F.col("hi")).alias("wide"))
    own = Window.partitionBy("rep")
    ranked = tokens.join(shared, "h").withColumn("at", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "h")))
    near = F.expr(f"at <= n - (n * {percent} + 99) div 100 + 1")
    front = F.expr(f"at <= n - (2 * n * {percent} + {99 + percent}) div {100 + percent} + 1")
    posts = work.table("ranked", ranked.where(F.col("wide") & near).select(F.col("h").alias("key"), "rep", "n", "label", front.alias("front")))
    work.drop("tokens")
    good = posts.groupBy("key").agg(F.bool_or("front").alias("any"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("any and lo < hi")
    return work.table("posts", posts.join(good.select("key"), "key", "left_semi"))


def _crossed(members: DataFrame, reps: DataFrame, work: Workspace, percent: int, mode: str) -> DataFrame:
    """What ``_crosser`` finds in groups of ``members`` (key, rep, n, label, and front for pairs) that hold several components.

    A group's members of its largest component are compared with its other members, and
    those with each other, in blocks of BLOCK; blocks of the largest component never meet.
    """
    placed = members if "front" in members.columns else members.withColumn("front", F.lit(True))
    placed = work.table(f"placed-{mode}", placed.select("key", "rep", "n", "label", "front"))
    sizes = placed.groupBy("key", "label").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy("key").agg(F.count("*").alias("labels"), F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("top")).where("labels > 1")
    sizes = work.table(f"apart-{mode}", sizes.select("key", F.col("top.label").alias("top"), F.ceil(F.col("top.c") / BLOCK).cast("int").alias("tops"), F.ceil((F.col("size") - F.col("top.c")) / BLOCK).cast("int").alias("others")))
    inside = placed.join(sizes, "key").withColumn("is_top", F.col("label") == F.col("top"))
    inside = inside.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("others"))).cast("int"))
    to_others = F.sequence(F.lit(0), F.col("others") - 1)
    met = F.when(F.col("is_top"), F.transform(to_others, lambda x: F.struct(x.alias("i"), (F.lit(-1) - F.col("own")).alias("j"), F.lit(1).alias("side"))))
    met = met.otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("tops") - 1), lambda x: F.struct(F.col("own").alias("i"), (F.lit(-1) - x).alias("j"), F.lit(0).alias("side"))),
            F.transform(to_others, lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j"), F.when(x == F.col("own"), 2).when(F.col("own") < x, 0).otherwise(1).alias("side"))),
        )
    )
    inside = inside.select("key", "rep", "n", "label", "front", F.inline(met))
    dealt = inside.join(reps.select("rep", "regs", "low", "keys"), "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return work.table(f"cross-{mode}", dealt.mapInArrow(_crosser(percent, mode), "a long, b long").distinct())


def _confirmed(pairs: DataFrame, source: DataFrame, reps: DataFrame, work: Workspace, k: int, percent: int, name: str, check: bool) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their full sets."""
    if check:
        sides = reps.select("rep", "n", "regs")
        a, b = (sides.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}")) for x in "ab")
        pairs = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimator(percent), "a long, b long")
        pairs = work.table(f"likely{name}", pairs)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    chosen = source.join(nodes, "id", "left_semi")
    sets = work.table(f"sets{name}", chosen.mapInArrow(_set_maker(k), "id long, hashes binary").dropDuplicates(["id"]), "none")
    a, b = (sets.select(F.col("id").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    found = pairs.join(a, "a").join(b, "b").select("a", "b", "ha", "hb").mapInArrow(_confirmer(percent), "a long, b long")
    found = work.table(f"links{name}", found)
    work.drop(f"sets{name}")
    return found
