"""Each operator against brute force on texts with copies, nulls, empty and long texts, ties and clashing columns."""

import gc
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blocksmith.llm import decontam, idfiles, minhash, packing, preferences, quality, shards, shared, suffixes, toxicity, wordpieces
from blocksmith.llm.components import components
from blocksmith.llm.shared import Workspace
from blocksmith.llm.tokens import Encoder, default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, tie string, regs long, _id long"
WORDS = ["Alpha", "beta", "gamma,", "ÉTÉ", "été", "delta", "x1", "no", "und", "###", "the"]


def texts() -> list[tuple]:
    r = random.Random(7)
    base = [" ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(r.randint(60, 160))) for _ in range(12)]
    out = list(base)
    for x in base[:6]:
        w = x.split(" ")
        out += [x, " ".join(w[:3] + ["edited"] + w[4:]), x + " tail", "\n".join([x, x])]
    passage = " ".join(f"shared{i}" for i in range(70))
    out += [f"{x} {passage} {i}" for i, x in enumerate(base[6:])]
    out += ["", " \n\t ", "one", "one two", "one", "a  b   c \n d", "line\nline\nother\n\nline", "é" * 150, "z" * 900, " ".join(base * 6), "the the the the the the", None, "idiot " * 60]
    return [(i, t, "en" if i % 3 else None, "s", 0, "clash", 1, "t", 2, 3) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def extra(spark, rows):
    """Null ids, and rows that occur twice."""
    return spark.createDataFrame([(None, "a b c d e f g h i", "en", "s", 0, "", 0, "", 0, 0), (None, None, None, None, 0, "", 0, "", 0, 0), rows[0], rows[0]], SCHEMA)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, nothing, extra, k, percent):
    sets, parent = {}, {}
    for i, t, *_ in rows:
        w = spaced((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, k, percent).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    if k == 3:
        assert minhash.near_duplicates(nothing, k, percent).count() == 0
        found = minhash.near_duplicates(extra, k, percent).collect()
        assert len(found) == 4 and all(r["kept"] for r in found)


def test_registers_estimate_similarity():
    r = np.random.default_rng(1)
    for n in (40, 300, 5000):
        one = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        two = np.unique(np.concatenate([one[: int(0.9 * n)], r.integers(0, 2**64, n - int(0.9 * n), dtype=np.uint64)]))
        true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        score, used = minhash.estimate(*minhash.registers([one, two])[:, None])
        assert abs(score[0] - true) < 5 * np.sqrt(0.2 / used[0]) + 0.01


def test_crossing_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 2)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[: 100 + i] + [f"own{i}x{j}" for j in range(4)])) for i in range(12)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).agg(F.countDistinct("component_id")).first()[0]
    assert got == 1


@pytest.mark.parametrize("n", [60, 240])
def test_template_family_gives_no_pairs(spark, monkeypatch, n):
    """Texts from one template, similar just under the threshold: no candidates but those of the hubs and trees."""
    r = random.Random(n)
    base = [f"w{i}" for i in range(1100)]
    rows = [(i, " ".join(base[: 1000 + r.randint(0, 8)] + [f"own{i}x{j}" for j in range(95)])) for i in range(n)]
    seen = {}
    table = Workspace.table
    monkeypatch.setattr(Workspace, "table", lambda self, name, df, codec="zstd": seen.setdefault(name, table(self, name, df, codec)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert got.where("kept").count() == n
    assert seen["marked"].count() > n // 2 and seen["posts"].count() == 0 and seen["rare"].count() == 0 and seen["pairs"].count() + seen["tree"].count() <= 80 * n


def test_links_at_the_threshold_are_found(spark):
    """Pairs at a similarity of 0.85 to 0.88, of 16 to 600 words."""
    r, rows, want = random.Random(3), [], set()
    for i in range(400):
        size = r.choice([16, 30, 60, 120, 300, 600])
        words = [f"v{i}x{j}" for j in range(size)]
        for tail in range(size):
            other = words[: size - tail] + [f"u{i}x{j}" for j in range(tail)]
            one, two = ({tuple(x[j : j + 3]) for j in range(size - 2)} for x in (words, other))
            if 85 * len(one | two) > 100 * len(one & two):
                break
            best, score = other, len(one & two) / len(one | two)
        if score <= 0.88:
            want.add(2 * i)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(best))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).where("doc_id % 2 = 1 and component_id = doc_id - 1").collect()
    assert len(want) > 200 and want <= {x["component_id"] for x in got}


@pytest.mark.parametrize("hot", [50_000, 2])
def test_components(spark, monkeypatch, hot):
    """A chain, a hub and odd rows; with hot keys salted too."""
    from blocksmith.llm import components as module

    monkeypatch.setattr(module, "HOT", hot)
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (None, 3)] + [(500, 501 + i) for i in range(30)] + [(520, 499)]
    got = dict(components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "test"), "c").collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100} | {i: 499 for i in range(499, 531)}


def test_repeats(docs, rows, nothing, extra):
    size = 200
    data = {i: (t or "").encode() for i, t, *_ in rows}
    seen = Counter(x[p : p + size] for x in data.values() for p in range(len(x) - size + 1))
    for r in suffixes.remove_repeats(docs, size).collect():
        x = data[r["doc_id"]]
        gone = bytearray(len(x))
        for p in range(len(x) - size + 1):
            if seen[x[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        kept = bytes(c for c, g in zip(x, gone) if not g)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(x), sum(gone), len([y for y in bytes(gone).split(b"\0") if y]), hashlib.sha256(kept).hexdigest())
        assert bytes(r["kept"]) == kept and len(r["starts"]) == r["n_spans"]
    assert suffixes.remove_repeats(nothing).count() == 0
    found = suffixes.remove_repeats(extra, carry=("lang", "n")).collect()
    assert len(found) == 4 and sorted(r["n_removed"] for r in found)[2:] == [len(data[0])] * 2 and found[0]["carry"]["n"] in (0, 1)


def test_segments_of_long_texts(spark, monkeypatch):
    r = random.Random(2)
    long = "".join(r.choice("abcd") for _ in range(3000))
    table = spark.createDataFrame([(0, long + "X" + long[500:900]), (1, long[100:1700])], "doc_id long, text string")
    whole = sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in suffixes.remove_repeats(table).collect())
    monkeypatch.setattr(suffixes, "SEGMENT", 300)
    import pyarrow as pa

    a = [x for part in [suffixes._pieces(pa.array([long]), 200)] for x in part]
    assert [s for _, _, s in a] == list(range(0, 2801, 300)) and all(len(d) <= 499 for d, _, _ in a)
    assert whole[0][1] == 1600 + 400 and whole[1][1] == 1600


def test_segment_boundaries_remove_nothing_unique(spark, monkeypatch):
    r = random.Random(5)
    draw = lambda n: bytes(r.choices(range(97, 123), k=n)).decode()
    found = suffixes.remove_repeats(spark.createDataFrame([(0, draw(9 << 20))], "doc_id long, text string")).collect()
    assert found[0]["n_removed"] == 0
    texts = [draw(9000) for _ in range(4)]
    texts += [draw(150) + texts[0][1000:4000] + draw(77), texts[1][:2000] + draw(50) + texts[1][1700:2300], draw(333) + texts[2], draw(500) + texts[0][1290:1495] + draw(500)]
    monkeypatch.setattr(suffixes, "SEGMENT", 300)
    seen = Counter(x[p : p + 200] for x in texts for p in range(len(x) - 199))
    for row in suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        x = texts[row["doc_id"]]
        gone = {p + k for p in range(len(x) - 199) if seen[x[p : p + 200]] > 1 for k in range(200)}
        assert bytes(row["kept"]).decode() == "".join(c for p, c in enumerate(x) if p not in gone)


def _units_table(spark, rows):
    return spark.createDataFrame(rows, "rank long, name0 long, id long, lo long, n int, d int")


@pytest.mark.parametrize("held", [1, 50_000])
def test_a_round_ranks_pairs_over_all_tasks(spark, monkeypatch, held):
    """A hot pair over many tasks, pairs at borders, unique ones."""
    import pyarrow as pa

    r = random.Random(8)
    rows = [(1, 5, i, 0, 0, 0) for i in range(300)] + [(r.randint(0, 3), r.randint(0, 60), 1000 + i, 0, 0, 0) for i in range(200)]
    pairs = Counter(x[:2] for x in rows)
    order = {p: i for i, p in enumerate(sorted(pairs))}
    rounds = suffixes._Rounds(Workspace(spark, "test"), 7)
    got = rounds.ranked(_units_table(spark, rows)).collect()
    assert {x["id"]: x["rank"] for x in got} == {x[2]: order[x[:2]] for x in rows if pairs[x[:2]] > 1}
    monkeypatch.setattr(suffixes, "HELD", held)
    whole, on = set(), set()
    batches = pa.Table.from_pylist([dict(zip(("rank", "name0", "id", "lo", "n", "d"), x)) for x in sorted(rows)])
    batches = batches.set_column(4, "n", batches["n"].cast(pa.int32())).set_column(5, "d", batches["d"].cast(pa.int32()))
    monkeypatch.setattr(suffixes.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    for b in suffixes._marked(True, 0)(iter(batches.to_batches(max_chunksize=13))):
        for x in b.to_pylist():
            if x["nth"] >= 0:
                whole |= {x["id"]} if x["many"] else set()
                on |= {(x["rank"], x["name0"])} if x["on"] else set()
    assert whole == {x[2] for x in rows if pairs[x[:2]] > 1}
    assert on >= {p for p in pairs if sum(q[0] == p[0] for q in pairs) > 1}


def test_partial_runs_of_two_texts_are_no_copies(spark):
    rows = [(5, 8, 1, 0, 3, 4), (5, 8, 18, 0, 3, 4), (5, 9, 3, 0, 7, 7), (5, 9, 4, 0, 7, 7)]
    got = suffixes._Rounds(Workspace(spark, "test"), 1).ranked(_units_table(spark, rows), settle=True, least=suffixes.RUN - 1).collect()
    got = sorted((x["id"], x["many"], x["on"]) for x in got)
    assert [x[:2] for x in got] == [(1, False), (3, True), (4, True), (18, False)] and {x[0] for x in got if x[2]} >= {1, 18, 3}


def test_decontamination(spark, docs, rows, nothing, extra):
    items = [(1, rows[0][1][:200]), (2, rows[1][1]), (3, "One TWO"), (4, ""), (5, None), (None, "one"), (6, "été1"), (7, " ".join(f"shared{i}" for i in range(20))), (7, " ".join(f"shared{i}" for i in range(20)))]
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, id long")
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(8, len(w))
        for p in range(len(w) - n + 1 if w and i is not None else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    bad = set()
    for r in decontam.benchmark_hits(docs, bench).collect():
        w, hit, found = split(rows[r["doc_id"]][1]), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if got := windows.get(tuple(w[p : p + n])):
                    found |= got
                    hit |= set(range(p, p + n))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(found), sha, len(found) >= 2)
        bad |= {r["doc_id"]} if len(found) >= 2 else set()
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {x[0] for x in rows} - bad
    assert decontam.benchmark_hits(nothing, bench).count() == 0
    none = decontam.benchmark_hits(docs, bench.limit(0)).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(none) == (0, len(rows))
    again = decontam.benchmark_hits(extra, bench).collect()
    assert sorted(str(r["doc_id"]) for r in again) == ["0", "0", "None", "None"] and sum(r["contaminated"] for r in again) == 2 * (0 in bad)
    assert decontam.decontaminate(extra, bench).count() == 4 - 2 * (0 in bad) and decontam.decontaminate(extra, bench, least_items=99).count() == 4
    odd = docs.withColumn("hit", F.lit(1)).withColumn("hit_", F.lit(2)).withColumn("__hit_id", F.lit(3))
    assert decontam.decontaminate(odd, bench).count() == len(rows) - len(bad)
    monkey = decontam.MOST_BROADCAST
    decontam.MOST_BROADCAST = 0
    try:
        assert {r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()} == {x[0] for x in rows} - bad
        assert sorted(map(str, decontam.benchmark_hits(extra, bench).collect())) == sorted(map(str, again))
        long = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20_000)) + " " + " ".join(f"shared{i}" for i in range(8)))], "doc_id long, text string")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert decontam.benchmark_hits(long, bench).first()["n_hit"] == 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        decontam.MOST_BROADCAST = monkey


def test_quality_counts(docs, rows, nothing, extra):
    for r in quality.quality_verdicts(docs).collect():
        t = rows[r["doc_id"]][1] or ""
        w = spaced(t)
        grams = list(zip(w, w[1:], w[2:]))
        count, hit = Counter(grams), set()
        for i, g in enumerate(grams):
            if count[g] > 1:
                hit |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if spaced(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.quality_verdicts(nothing).count() == 0
    assert quality.quality_verdicts(extra).count() == 4


def test_quality_outliers(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" + "x" * r.randint(2, 7) + str(r.randint(0, 10**6)) for _ in range(r.randint(80, 300))), "en", "a") for i in range(150)]
    rows += [(1000 + i, " ".join("#$%& " + str(r.randint(0, 10**6)) for _ in range(100)), "en", "a") for i in range(15)]
    rows += [(2000 + i, " ".join("y" * 60 + str(r.randint(0, 10**6)) for _ in range(100)), "en", "a") for i in range(15)]
    kept = {x["doc_id"]: x["kept"] for x in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(v for k, v in kept.items() if k >= 1000) and sum(v for k, v in kept.items() if k < 1000) >= 148


def test_each_deviation_can_reject_alone(spark):
    r = random.Random(6)
    word = lambda: "w" + str(r.randint(10**5, 10**6))
    rows = [(i, " ".join(word() for _ in range(r.randint(150, 250)))) for i in range(150)]
    twice, lines = ([word() for _ in range(n)] for n in (45, 80))
    rows += [(1000, " ".join(twice + [word() for _ in range(110)] + twice)), (1001, "\n".join([x for x in lines for _ in range(2)] + [word() for _ in range(40)]))]
    got = {x["doc_id"]: x for x in quality.quality_verdicts(spark.createDataFrame([(*x, "en", "a") for x in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert (got[1000]["n_words"], got[1000]["n_repeat_words"], got[1001]["n_repeat_words"], got[1001]["n_dup_lines"]) == (200, 90, 0, 80)
    assert not any(got[i]["base_failed"] or got[i]["kept"] for i in (1000, 1001)) and sum(got[i]["kept"] for i in range(150)) >= 148


def test_small_sources_lean_on_their_language(spark):
    r = random.Random(9)
    text = lambda size: " ".join("".join(r.choice("abcdefgh") for _ in range(size + r.randint(0, 1))) for _ in range(r.randint(80, 200)))
    rows = [(i, text(4), "en", "a") for i in range(300)] + [(1000 + i, text(14), "de", "a") for i in range(80)]
    rows += [(2000 + i, text(14), "de", "b") for i in range(10)] + [(3000 + i, text(4), "de", "c") for i in range(5)]
    rows += [(4000 + i, text(4), None, None) for i in range(5)] + [(5000 + i, text(4), "en", None) for i in range(5)]
    rows += [(6000, "few", "fr", "d"), (7000, text(4), "de", "b")]
    got = quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows)
    kept = Counter(x["doc_id"] // 1000 for x in got if x["kept"])
    assert kept[0] >= 297 and kept[1] >= 79 and kept[2] == 10 and kept[3] == kept[4] == kept[5] == 5 and kept[6] == kept[7] == 0


def test_estimates_equal_plain_concentration_steps(spark):
    """The estimate of a group against NumPy: from the best of the same steps, means, covariances and distances."""
    r = np.random.default_rng(5)
    v = np.round(np.concatenate([r.normal(0, 1, (400, 5)) @ np.diag([1, 2, 0.5, 1, 3]) + r.normal(0, 1, (400, 1)), r.normal(9, 1, (60, 5))]) * quality.SCALE).astype(int)
    rows = [("g", *map(int, x)) for x in v] + [("h", *map(int, x)) for x in v[:7]]
    work = Workspace(spark, "test")
    got = {x["g"]: x for x in quality.outlier_estimates(spark.createDataFrame(rows, ["g", *quality.V]), work).collect()}
    assert got["g"]["n"] == 460 and got["h"]["n"] == 7
    x, floors = v / quality.SCALE, np.square(quality.FLOORS)
    mu = np.array([got["g"][f"mu{i}"] for i in range(5)])
    cov = np.array([[got["g"][f"c{max(i, j)}{min(i, j)}"] for j in range(5)] for i in range(5)])
    for _ in range(20):  # concentration steps of our own, from where the estimate ended: it stays there
        d = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
        near = x[np.argsort(d)[: int(np.ceil(0.75 * len(x)))]]
        mu2, cov2 = near.mean(0), np.cov(near.T, bias=True) * quality.CONSISTENCY + np.diag(floors)
    assert np.abs(mu2 - mu).max() < 0.05 and np.abs(cov2 - cov).max() < 0.1 * np.abs(cov).max()
    assert np.linalg.norm(x[:400].mean(0) - mu) < 0.4 and (d[400:] > quality.CUTOFF).all() and (d[:400] > quality.CUTOFF).sum() < 8
    wider = spark.createDataFrame([(0, "h", "g"), (1, "g", None)], "level int, g string, up string")
    some = {x["g"]: x for x in quality.shrunk(work.table("e", quality.outlier_estimates(spark.createDataFrame(rows, ["g", *quality.V]), work.__class__(spark, "t2"))), wider, work, 1).collect()}
    one = quality._whitened(spark.createDataFrame([("h", *[(7 * got["h"][c] + quality.PRIOR * got["g"][c]) / (7 + quality.PRIOR) for c in quality.COVARIANCES])], ["g", *quality.COVARIANCES])).first()
    assert all(abs(some["h"][w] - one[w]) < 1e-9 for w in ("w00", "w43", "det")) and some["h"]["mu0"] == got["h"]["mu0"]


def test_chi_square():
    assert abs(quality.chi2_cdf(quality.chi2_quantile(0.95, 5), 5) - 0.95) < 1e-9 and abs(quality.chi2_quantile(0.95, 5) - 11.0705) < 1e-3


def test_shards(docs, rows, nothing, extra):
    got = sorted(shards.balanced_shards(docs, 4).collect(), key=lambda r: r["doc_id"])
    sizes, before, total = Counter(), 0, sum(len((t or "").encode()) + 1 for _, t, *_ in rows)
    slots = Counter()
    for r in got:
        data = (rows[r["doc_id"]][1] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert r["shard"] == min(3, (2 * before + r["size"]) * 4 // (2 * total)) and r["slot"] == slots[r["shard"]]
        slots[r["shard"]] += 1
        sizes[r["shard"]] += r["size"]
        before += r["size"]
    assert shards.balanced_shards(nothing).count() == 0
    again = sorted((r["shard"], r["slot"]) for r in shards.balanced_shards(extra, 2).collect())
    assert len(again) == 4 and len(set(again)) == 4


def test_encoder_equals_the_library():
    known = Encoder(default_path())
    odd = ["a  b", "a   b", "a \n b", "\n x", "  a", "a ", " a  ", " ", "", "a\n \nb", "it's  's 've x<|endoftext|> y <|endoftext|>", "　 x", "a\t b", "\x00 \x7f \xad a\x85b", "😀 é𝒳 ab12c 3½", *[t or "" for _, t, *_ in texts()]]
    assert known.encode(odd) == known._direct(odd) and known.by_piece


def test_id_files(docs, rows, nothing, extra):
    known = Encoder(default_path())
    written = idfiles.write_id_files(docs, docs_per_file=20)
    assert written.manifest.count() >= 2
    at = 0
    for r in sorted(written.digests().collect(), key=lambda r: r["doc_id"]):
        ids = known.encode([rows[r["doc_id"]][1] or ""])[0] + b"\0\0\0\0"
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert idfiles.write_id_files(nothing).digests().count() == 0
    found = idfiles.write_id_files(extra).digests().collect()
    assert len(found) == 4 and sorted(r["start"] for r in found)[0] == 0


def test_id_file_damage(tmp_path):
    import pyarrow as pa
    import zstandard

    sink = pa.BufferOutputStream()
    writer = idfiles.IdFileWriter(sink, b"")
    for i in range(3):
        writer.add(i, 2, 4, zstandard.compress(bytes(8)))
    writer.finish()
    data = sink.getvalue().to_pybytes()
    reader = idfiles.IdFileReader(pa.BufferReader(data), b"")
    assert reader.tokens(2).tolist() == [0, 0] and len(reader) == 3
    for bad in (data[:30], b"X" + data[1:], data[:-1], data[:-12] + bytes(8) + data[-4:]):
        with pytest.raises(ValueError):
            idfiles.IdFileReader(pa.BufferReader(bad), b"")
    with pytest.raises(ValueError, match="another dictionary"):
        idfiles.IdFileReader(pa.BufferReader(data), b"other")


def test_best_fit_is_tightest():
    r = np.random.default_rng(3)
    for capacity in (7, 64):
        lengths = r.integers(1, capacity, 300)
        windows, offsets = packing.best_fit(lengths, capacity)
        room = []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [x for x in room if x >= lengths[i]]
            assert capacity - offsets[i] == (min(fits) if fits else capacity)
            if fits:
                room.remove(min(fits))
            room.append(capacity - offsets[i] - lengths[i])


def test_packing(docs, rows, nothing, extra):
    known = Encoder(default_path())
    got = packing.pack_documents(docs, capacity=64, keep_ids=True).cache()
    filled, pieces = Counter(), Counter()
    for r in sorted(got.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        ids = known.encode([rows[r["doc_id"]][1] or ""])[0] + b"\1\0\0\0"
        part = ids[4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert (r["doc_tokens"], r["ids_crc32"], r["offset"]) == (len(ids) // 4, zlib.crc32(part), filled[r["sequence_id"]]) and bytes(r["ids"]) == part
        filled[r["sequence_id"]] += r["length"]
        pieces[r["doc_id"]] += r["length"]
    assert sorted(filled) == list(range(len(filled))) and max(filled.values()) <= 64
    assert all(pieces[i] == len(known.encode([t or ""])[0]) // 4 + 1 for i, t, *_ in rows)
    whole = packing.sequences(got, 64).collect()
    assert len(whole) == len(filled) and all(len(r["ids"]) == 64 and r["used"] == filled[r["sequence_id"]] for r in whole)
    assert packing.pack_documents(nothing).count() == 0 and packing.pack_documents(extra).count() == 4


def test_toxicity(spark, docs, nothing, extra):
    r = random.Random(6)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        words = [f"word{r.randint(0, 300)}" for _ in range(r.randint(10, 60))]
        if bad:
            words[r.randint(0, len(words) - 1)] = "scum" + r.choice(["", ".", "ling", "my", str(r.randint(0, 99))])
        rows.append((i, " ".join(words), r.choice(["en", "de"]), int(bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit_on_labels(table.drop("toxic"), table.select("doc_id", "toxic"))
    got = model.score(table).join(table.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out()).collect()
    assert np.mean([(x["score"] >= 0.5) == x["toxic"] for x in got]) >= 0.95
    a = {x["doc_id"]: x["score"] for x in model.score(table).collect()}
    b = {x["doc_id"]: x["score"] for x in model.score(table.withColumn("lang", F.lit("zz"))).collect()}
    assert a == b
    scored = model.score(docs).collect()
    assert len(scored) == docs.count() and all(0 <= x["score"] <= 1 for x in scored)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not x["rejected"] for x in scored)
    assert model.score(nothing).count() == 0 and model.score(extra).count() == 4 and toxicity.drop_toxic(nothing, model).count() == 0
    flat = toxicity.fit_on_labels(table.drop("toxic"), table.select("doc_id", F.lit(0).alias("toxic")))
    assert len({x["score"] for x in flat.score(table).collect()}) == 1


def test_very_long_texts(spark):
    """Texts of over two MiB, which are read in segments, through the operators that work word by word."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 12))) for _ in range(400_000)]
    long, other = " ".join(words), " ".join(words[:-50])
    assert len(long) > 2 << 20
    table = spark.createDataFrame([(1, long, "en"), (2, other, "en"), (3, "a b c d", "en"), (4, long[:1000], None)], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in minhash.near_duplicates(table, 5, 80).collect()}
    assert [got[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 3, 4] and got[1]["n_shingles"] == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    counts = {x["doc_id"]: x for x in wordpieces.token_counts(table).collect()}
    assert counts[1]["n_words"] == 400_000 and counts[1]["n_tokens"] - counts[2]["n_tokens"] >= 50
    pieces = packing.pack_documents(table, keep_ids=True).where("doc_id = 1").orderBy("start").collect()
    known = Encoder(default_path())
    assert b"".join(bytes(x["ids"]) for x in pieces) == known._direct([long])[0] + b"\1\0\0\0"
    model = toxicity.ToxicityModel(toxicity.Classifier(np.random.default_rng(1).normal(0, 1, 2 * toxicity.BUCKETS)), 0.5, {})
    assert len({round(x["score"], 9) for x in model.score(table).where("doc_id < 3").collect()}) <= 2


def test_training_sample(spark, monkeypatch):
    """Long texts train too; rows stop once the bound on bytes is reached."""
    seen = []
    monkeypatch.setattr(toxicity.Classifier, "train", lambda self, texts, labels: seen.append([len(x) - toxicity.PAD for x in texts]))
    rows = [(i, "en", "word " * (30_000 if i % 10 == 3 else 5), i % 2) for i in range(100)] + [(7, "en", None, 1), (8, "en", "x", None)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string, toxic int")
    toxicity.train_toxicity(table)
    assert sorted(seen[0]) == [5] * (len(seen[0]) - seen[0].count(30_000)) + [30_000] * seen[0].count(30_000) and len(seen[0]) == 80 and seen[0].count(30_000) > 4
    monkeypatch.setattr(toxicity, "MOST_BYTES", 200_000)
    toxicity.train_toxicity(table)
    assert 2 <= len(seen[1]) < 60 and toxicity.train_toxicity(table, most_rows=10) and len(seen[2]) <= 8


def test_workspaces_go_and_settings_stay(spark):
    from blocksmith.llm import shared

    before = tuple(x for x in Workspace.made if x.spark is spark)
    settings = {k: spark.conf.get(k, None) for k in shared.SETTINGS}
    work, kept = Workspace(spark, "one"), Workspace(spark, "two")
    one, two = work.table("a", spark.range(3).repartition(2)), kept.table("a", spark.range(4))
    assert (one.count(), two.count()) == (3, 4) and {k: spark.conf.get(k, None) for k in shared.SETTINGS} == settings
    shared.clear(spark, (*before, kept))
    with pytest.raises(Exception):
        spark.read.parquet(work.path("a"))
    assert spark.read.parquet(kept.path("a")).count() == 4 and work not in Workspace.made


def test_scores_equal_a_plain_forward_pass(spark):
    """Tables and reduceat against the network written out for one text."""
    import pyarrow as pa

    r = np.random.default_rng(2)
    net = toxicity.Classifier(r.normal(0, 1, 2 * toxicity.BUCKETS))
    net.bias, net.out, net.base, net.scale, net.shift = r.normal(0, 0.1, net.bias.shape), r.normal(0, 1, net.out.shape), -0.3, 1.7, 0.2
    texts = ["", "one", "one two", "a b c d e f g", None, " ".join(f"w{i}" for i in range(500))]
    ids, first, windows = toxicity._padded(pa.array(texts, pa.string()))
    got = net.logits(ids, first, windows)
    for z, at, n in zip(got, first, windows):
        x = net.embed[ids[at : at + n + toxicity.PAD]].sum(1)
        want = net.base
        for k, f in enumerate(net.filters):
            y = np.array([sum(x[i + j] @ f[j] for j in range(len(f))) for i in range(n)])
            want += np.maximum(y.max(0) + net.bias[k], 0) @ net.out[k]
        assert abs(z - (net.scale * want + net.shift)) < 1e-3


def test_long_texts_in_segments(monkeypatch):
    """Words, shingles, buckets and ids of a text are the same in segments."""
    import pyarrow as pa

    from blocksmith.llm import textarrays, tokens

    r = random.Random(4)
    long = "".join(r.choice(["a", "B", " ", "\n", "é", "word ", "9"]) for _ in range(20000))
    for text in (long, "x" * 5000, " " * 3000, "a " * 2000 + "z" * 3000):
        column = pa.array([text])
        sets, ids = textarrays.shingle_sets(column, 3), toxicity._padded(column)
        codes = Encoder(default_path()).encode([text])
        monkeypatch.setattr(textarrays, "MOST", 700)
        monkeypatch.setattr(tokens, "CHUNK", 300)
        assert sum(1 for _ in textarrays.segments(column)) >= (1 if text[0] == "x" else 3)
        assert [x.tolist() for x in textarrays.shingle_sets(column, 3)] == [x.tolist() for x in sets]
        assert all((x == y).all() for x, y in zip(toxicity._padded(column), ids))
        assert Encoder(default_path()).encode([text]) == codes
        monkeypatch.undo()


def test_word_pieces(spark, docs, rows, nothing, extra):
    vocabulary = set(wordpieces.word_end_vocabulary(wordpieces.default_path()))

    def greedy(word, known):
        rest, n = (*word, wordpieces.END), 0
        while rest:
            for k in range(len(rest), 0, -1):
                if rest[:k] in known:
                    n, rest = n + 1, rest[k:]
                    break
            else:
                return 1
        return n

    for r in wordpieces.token_counts(docs).collect():
        counts = [greedy(w.encode(), vocabulary) for w in spaced((rows[r["doc_id"]][1] or "").translate(LOWER))]
        assert (r["n_words"], r["n_tokens"], r["longest_word"]) == (len(counts), sum(counts), max(counts, default=0))
    r = random.Random(3)
    for _ in range(100):
        some = {tuple(r.choice(b"abc") for _ in range(r.randint(1, 5))) + (wordpieces.END,) * r.randint(0, 1) for _ in range(r.randint(1, 14))}
        machine = wordpieces.Automaton(sorted(some))
        words = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 12))) for _ in range(30)]
        ends = np.cumsum([len(w) for w in words])
        assert machine.lengths(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends).tolist() == [greedy(w, some) for w in words]
    assert wordpieces.token_counts(nothing).count() == 0 and wordpieces.token_counts(extra).count() == 4


def test_preferences(spark):
    said = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    turns = [
        (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "yes"), (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "no"), (1, False, 2, "user", None), (1, False, 1, "assistant", "no"),
        (2, True, 0, "user", "a"), (2, False, 0, "user", "a"), (3, True, None, None, "x"), (None, True, 0, "user", "q"), (4, None, 0, "user", "q"),
        (5, True, 1, "a", "t"), (5, True, 1, "b", "t"), (5, False, 1, "a", "t"),
    ]
    table = spark.createDataFrame([(*t, "clash", 9) for t in turns], "pair_id long, chosen boolean, turn long, role string, text string, c string, n_prefix int")
    got = {r["pair_id"]: r for r in preferences.format_preferences(table).collect()}
    assert set(got) == {1, 2, 3, 5}
    one = got[1]
    assert (one["n_prefix"], one["prompt"], one["chosen"], one["rejected"]) == (1, said("user", "hi"), said("assistant", "yes"), said("assistant", "no") + said("user", ""))
    start, size = map(int, one["chosen_mask"].split(":"))
    assert one["chosen"][start : start + size] == "yes<|end|>\n" and one["rejected_mask"].count(":") == 1
    assert (got[2]["prompt"], got[2]["chosen"], got[2]["rejected"], got[2]["n_prefix"]) == (said("user", "a"), "", "", 1)
    assert (got[3]["prompt"], got[3]["chosen"], got[3]["rejected"]) == ("", said("", "x"), "")
    assert got[5]["n_prefix"] == 1 and got[5]["rejected"] == "" and got[5]["chosen"] == said("b", "t")
    assert preferences.format_preferences(table.limit(0)).count() == 0


def test_driver_gives_memory_back(spark, monkeypatch):
    jvm = spark.sparkContext._jvm
    heap, full = jvm.java.lang.Runtime.getRuntime(), []
    jvm.java.lang.System.gc()
    low = heap.totalMemory() - heap.freeMemory()
    jvm.java.util.ArrayList(jvm.java.util.Collections.nCopies(60_000_000, "x"))  # 240 MB that nothing holds soon
    gc.collect()
    monkeypatch.setattr(shared, "SHARE", 0)
    monkeypatch.setattr(shared, "_next", [0.0])
    work = Workspace(spark, "relieve")
    assert work.table("few", spark.range(3)).count() == 3
    assert heap.totalMemory() - heap.freeMemory() < low + 120_000_000 and shared._next[0] >= time.monotonic() + shared.PAUSE - 5
    work.close()
    before, known = pa.total_allocated_bytes(), toxicity.relieve
    monkeypatch.setattr(toxicity, "relieve", lambda spark, now: (full.append(pa.total_allocated_bytes() - before), known(spark, now=now)))
    rows = [(i, "en", ("bad " if i % 2 else "good ") * 20_000, i % 2) for i in range(40)]
    model = toxicity.train_toxicity(spark.createDataFrame(rows, "doc_id long, lang string, text string, toxic int"))
    assert len(full) == 1 and full[0] < 2_000_000 and model.by_language.keys() == {"en"}  # its training rows have 6.4 MB
