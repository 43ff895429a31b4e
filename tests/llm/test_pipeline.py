"""The pipeline's stages and run(), against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from blocksmith.llm.tokens import Encoder, default_path
from blocksmith.llm.toxicity import fit_on_labels

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()), key=repr)


def near_dedup(rows):
    """The first of each group of five-word sets that reach 0.8."""
    texts = {i: (t or "").translate(LOWER) for i, t, *_ in rows if i is not None}
    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [r for r in rows if r[0] is None or find(r[0]) == r[0]]


def suffix_dedup(rows):
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(x[k : k + 200] for x in data for k in range(len(x) - 199))
    out = []
    for (i, _, lang, source, _), x in zip(rows, data):
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        text = bytes(c for c, g in zip(x, gone) if not g).decode(errors="ignore")
        out.append((i, text, lang, source, len(text)))
    return out


def decontamination(rows, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    bad = {}
    for _, t in items:
        w = split(t)
        n = min(8, len(w))
        bad.setdefault(n, set()).update(tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0))
    return [r for r in rows if not any(tuple(w[k : k + n]) in x for w in [split(r[1])] for n, x in bad.items() if n for k in range(len(w) - n + 1))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean texts, copies, near copies, passages, a benchmark item, toxic texts, odd rows and columns."""
    folder, r = tmp_path_factory.mktemp("tables"), random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))
    clean = [text(120) for _ in range(60)]
    passage, item = text(80), text(30)
    accents = " ".join("é" + text(1) for _ in range(60))
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[0]), (101, clean[1] + " more"), (102, text(60) + " " + passage), (103, passage + " " + text(60)), (104, text(40) + " " + item + " " + text(40)), (105, "")]
    rows += [(106, "á" + accents + " " + text(50)), (107, text(50) + " ü" + accents), (108, None), (109, clean[2][:400]), (110, "x " * 3000), (111, text(30000)), (112, text(60)), (112, None)]
    rows += [(None, text(60)), (None, None), (5, clean[5])]
    rows += [(200 + i, text(40) + f" scum{i % 7} " + text(40)) for i in range(60)]
    rows = [(i, t, ["en", "de", None][(i or 0) % 3], "s" if i != 7 else None, len(t or "")) for i, t in rows]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{name}.parquet"))
    write([(*x, 1, "t", 2) for x in rows], DOCUMENTS + ", hit long, tie string, _id long", "documents")
    write([(i, 1, int(i >= 200)) for i, *_ in rows if i is not None and (i < 100 or i >= 200)] + [(None, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int", "labels")
    items = [(1, item), (2, None), (3, "")]
    write(items, "item_id long, text string", "benchmark")
    return str(folder), rows, items


def test_stages_equal_plain_python(spark, tables, tmp_path):
    sf, rows, items = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit_on_labels(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {(r["doc_id"], r["tie"]) for r in model.score(docs.withColumn("doc_id", F.xxhash64("doc_id", "text", "lang"))).withColumn("tie", F.lit(0)).where("rejected").collect()}
    keys = {(r["doc_id"], r["text"]): (r["k"], 0) for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text", "lang").alias("k")).collect()}
    want = [r for r in rows if keys[r[:2]] not in bad]
    for name, stage in p.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            break
        want = {"toxicity": lambda: want, "near_dedup": lambda: near_dedup(want), "suffix_dedup": lambda: suffix_dedup(want), "decontamination": lambda: decontamination(want, items)}[name]()
        assert docs.columns == p.COLUMNS and rows_of(docs) == sorted(want, key=repr), name
        ids = {r[0] for r in want}
        if name == "toxicity":
            assert sum((i or 0) >= 200 for i in ids) <= 6 and sum((i or 0) < 100 for i in ids) >= 58
        if name == "near_dedup":
            assert not {100, 101} & ids and {102, 103, 104, 105} <= ids
    known = Encoder(default_path())
    ids = {(i, t): known.encode([t or ""])[0] + b"\1\0\0\0" for i, t, *_ in want}
    for got in (docs, p.run(spark, sf)):
        got = got.collect()
        used = Counter()
        for r in got:
            used[r["sequence_id"]] += r["length"]
        assert max(used.values()) <= 2048 and sorted(used) == list(range(len(used)))
        pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
        plain = Counter()
        for i, t, *_ in want:
            x = ids[i, t]
            plain.update((i, k // 4, len(y) // 4, zlib.crc32(y), len(x) // 4) for k in range(0, len(x), 8192) for y in [x[k : k + 8192]])
        assert pieces == plain


def test_stages_of_empty_tables(spark, tables, tmp_path):
    sf = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{sf}/{name}.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, sf).count() == 0
    assert p.run(spark, sf).count() == 0
