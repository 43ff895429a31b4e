"""Benchmark decontamination by word windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes between words, before A-Z are lowered: all of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Pairs of window and item up to which the benchmark's are broadcast (some 200 bytes each); beyond, both sides are shuffled.
MOST_BROADCAST = 250_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text (null: none), with A-Z lowered and other letters as they are."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")
    ascii_ = lambda w: F.octet_length(w) == F.length(w)
    return F.transform(words, lambda w: F.xxhash64(F.when(ascii_(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))))


def _at(hashes: str, start: str, length: int) -> Column:
    return F.xxhash64(*[F.get(F.col(hashes), F.col(start) + j) for j in range(length)])


def windows(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(length, window, words, items): each window of the benchmark with the items that hold it."""
    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), word_hashes(F.col(text_col)).alias("h"))
    items = items.withColumn("n", F.size("h")).where("n > 0").withColumn("length", F.least("n", F.lit(size)))
    items = items.select("item", "h", "length", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("length"))).alias("pos"))
    key = F.coalesce(*[F.when(F.col("length") == k, _at("h", "pos", k)) for k in range(1, size + 1)])
    return items.select("item", "length", key.alias("window"), F.slice("h", F.col("pos") + 1, F.col("length")).alias("words")).groupBy("length", "window", "words").agg(F.collect_set("item").alias("items"))


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, size: int = 8, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, items, hits.

    Words are runs of digits, letters and characters beyond ASCII, with A-Z lowered.
    An item's windows are ``size`` successive words; an item of fewer is one window.
    ``hits`` are (pos, length) of windows found, ``items`` the items with such a
    window; n_hit counts document words inside any. Contaminated: at least
    ``least_items`` items.

    Windows are found by hash and confirmed word for word. Few windows are broadcast, and
    found and confirmed in one pass over the texts. Beyond MOST_BROADCAST the places of
    all windows of the texts, without the words, are joined with the benchmark's, and only
    texts with a place found are read again to confirm it. Null and empty texts have
    no words; items without words or with a null id are ignored. Rows that repeat an id and
    its text each give a row, all alike; a null id is an id like others. Empty
    tables give no rows or no hits. Further columns are ignored.
    """
    found = windows(benchmark, size, item_col, item_text_col)
    sizes = {r["length"]: r["c"] for r in found.groupBy("length").agg(F.sum(F.size("items")).alias("c")).collect()}  # at most ``size`` rows
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), word_hashes(F.col(text_col)).alias("h")).withColumn("n", F.size("h"))
    shortest = min(sizes, default=size)
    each = words.select("id", "tie", "h", "n", F.explode(F.sequence(F.lit(-1), F.greatest(F.col("n") - shortest, F.lit(-1)))).alias("pos"))
    keys = [F.struct(F.lit(k).alias("length"), _at("h", "pos", k).alias("window")) for k in sorted(sizes) or [size]]
    if len(keys) > 1:
        each = each.select("*", F.inline(F.array(*keys))).where("pos + length <= n and pos >= 0 or pos < 0 and length = (%d)" % min(sizes))
    else:
        each = each.select("*", keys[0].getField("length").alias("length"), keys[0].getField("window").alias("window"))
    side = found.select(F.col("length").alias("wl"), F.col("window").alias("ww"), "words", "items")
    same = (F.col("window") == F.col("ww")) & (F.col("length") == F.col("wl"))
    held = F.slice("h", F.greatest(F.col("pos"), F.lit(0)) + 1, F.col("length")) == F.col("words")
    hit = F.when(F.col("pos") >= 0, F.struct("pos", F.col("length").alias("length"))).alias("hit")
    whole = F.when(F.col("pos") < 0, F.col("n")).alias("n")
    if sum(sizes.values()) <= MOST_BROADCAST:
        hit = each.join(F.broadcast(side), same & (F.col("pos") >= 0) & held, "left").where("pos < 0 or wl is not null").select("id", "tie", whole, hit, "items")
    else:
        places = each.where("pos >= 0").select("id", "tie", "pos", "length", "window").join(side.select("wl", "ww").distinct(), same, "left_semi")
        places = places.groupBy(F.col("id").alias("_id"), F.col("tie").alias("_tie")).agg(F.collect_set(F.struct("pos", "length", "window")).alias("places"))
        again = words.join(places, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
        again = again.select("id", "tie", "h", F.inline("places")).select("id", "tie", "pos", "length", "window", F.slice("h", F.col("pos") + 1, F.col("length")).alias("held"))
        again = again.join(side, same & (F.col("held") == F.col("words"))).select("id", "tie", F.lit(None).cast("int").alias("n"), hit, "items")
        none = again.schema["hit"].dataType.simpleString()
        hit = words.select("id", "tie", "n", F.lit(None).cast(none).alias("hit"), F.lit(None).cast("array<string>").alias("items")).unionByName(again)
    rows = hit.groupBy("id", "tie").agg(F.max("n").cast("long").alias("n_words"), F.count("n").cast("int").alias("copies"), F.array_sort(F.collect_set("hit")).alias("hits"), F.collect_set("items").alias("items"))
    rows = rows.withColumn("items", F.array_sort(F.array_distinct(F.flatten("items"))))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["pos"] + x["length"]).alias("end"), (s["sum"] + F.greatest(F.lit(0), x["pos"] + x["length"] - F.greatest(s["end"], x["pos"]))).cast("long").alias("sum")
        ),
        lambda s: s["sum"],
    )
    n_items = F.size("items").cast("long")
    rows = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return rows.select(
        F.col("id").alias(id_col), "tie", "n_words", covered.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_items >= least_items).alias("contaminated"), "items", "hits",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated documents; all columns, whatever their names, and all other rows stay, repeated ones too."""
    name = "hit"
    while name in docs.columns:
        name += "_"
    bad = benchmark_hits(docs, benchmark, id_col=id_col, text_col=text_col, **options).where("contaminated")
    bad = bad.select(F.struct(F.col(id_col).alias("id"), "tie").alias(name)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(f"{name}.id")) & (F.xxhash64(text_col) == F.col(f"{name}.tie"))
    return docs.join(bad, same, "left_anti")
