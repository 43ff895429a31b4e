"""A convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

A word's embedding is the sum of those of its hash and of the hash of its first
bytes, so that unseen forms of a word are near to seen ones. Trained in NumPy on a
bounded sample of labelled texts, applied to whole texts by tables: a filter of width
w is the sum of 2 w look-ups for each word. Embeddings start from how much more often
a bucket occurs in positive texts. A share of the
sample is set aside to scale the score and to choose a threshold for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import relieve
from .textarrays import U64, release, segments, slices, word_hashes, words

#: Buckets of hashed words (0: padding), as many again for first bytes, embedding size, filter widths, filters of each width.
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 4
#: First bytes of a word that are hashed by themselves.
HEAD = 4
#: Most labelled rows that training reads, and bytes of text after which it takes no further row.
MOST_ROWS, MOST_BYTES = 6_000, 1 << 25
#: Positive rows that the threshold of all languages counts as in that of one.
PRIOR = 8
PAD = max(WIDTHS) - 1


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, each text followed by padding; first index and count of each text's windows (1 at least)."""
    sizes, parts, n = U64(BUCKETS - 1), [], 0
    for part in segments(column):
        data, starts, ends, bounds = words(part)
        parts.append(np.stack([word_hashes(data, starts, ends) % sizes, word_hashes(data, starts, np.minimum(starts + HEAD, ends)) % sizes + U64(BUCKETS)], 1).astype(np.int32) + 1)
        n = n + np.diff(bounds)
    buckets, bounds = np.concatenate(parts), np.append(0, np.cumsum(n))
    windows = np.maximum(n, 1)
    first = np.cumsum(windows + PAD) - windows - PAD
    ids = np.zeros((int((windows + PAD).sum()), 2), np.int32)
    row = np.repeat(np.arange(len(n)), n)
    ids[np.arange(len(buckets)) - bounds[:-1][row] + first[row]] = buckets
    return ids, first, windows


class Classifier:
    """Parameters and their use; ``scale`` and ``shift`` turn the output into a logit."""

    def __init__(self, prior: np.ndarray, seed: int = 1):
        r = np.random.Generator(np.random.PCG64(seed))
        self.embed = r.normal(0, 0.02, (2 * BUCKETS, SIZE))
        self.embed[:, 0] = prior
        self.embed[0] = 0
        self.filters = [r.normal(0, 0.3, (w, SIZE, FILTERS)) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, :] += 0.5
        self.bias = np.zeros((len(WIDTHS), FILTERS))
        self.out = np.full((len(WIDTHS), FILTERS), 0.2)
        self.base, self.scale, self.shift = -1.0, 1.0, 0.0

    def train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 3, rate: float = 0.05, seed: int = 2) -> None:
        """Adagrad, one text at a time; gradients pass through the winning window of each filter."""
        r = np.random.Generator(np.random.PCG64(seed))
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-3), 0.5 / max(1 - labels.mean(), 1e-3))
        sums = {k: np.full_like(v, 0.01) for k, v in (("embed", self.embed), ("bias", self.bias), ("out", self.out))}
        filter_sums = [np.full_like(f, 0.01) for f in self.filters]
        for _ in range(epochs):
            for t in r.permutation(len(texts)):
                ids = texts[t]
                n, x = len(ids) - PAD, self.embed[ids].sum(1)
                top = np.zeros((len(WIDTHS), FILTERS))
                where = np.zeros((len(WIDTHS), FILTERS), np.int64)
                for k, f in enumerate(self.filters):
                    y = sum(x[j : j + n] @ f[j] for j in range(WIDTHS[k]))
                    where[k] = y.argmax(0)
                    top[k] = y[where[k], np.arange(FILTERS)]
                act = np.maximum(top + self.bias, 0)
                p = 1 / (1 + np.exp(-np.clip((act * self.out).sum() + self.base, -30, 30)))
                g = (p - labels[t]) * weight[t]
                up = g * self.out * (act > 0)
                grad = g * act
                sums["out"] += grad**2
                self.out -= rate * grad / np.sqrt(sums["out"])
                sums["bias"] += up**2
                self.bias -= rate * up / np.sqrt(sums["bias"])
                self.base -= rate * g * 0.2
                for k, f in enumerate(self.filters):
                    for j in range(WIDTHS[k]):
                        at = ids[where[k] + j]
                        by = self.embed[at].sum(1) * up[k][:, None]
                        to = np.repeat(f[j].T * up[k][:, None], 2, 0)
                        at = at.ravel()
                        filter_sums[k][j] += by.T**2
                        f[j] -= rate * by.T / np.sqrt(filter_sums[k][j])
                        np.add.at(sums["embed"], at, to**2)
                        np.subtract.at(self.embed, at, rate * to / np.sqrt(sums["embed"][at]))
                self.embed[0] = 0

    def head(self) -> Classifier:
        """What is needed beside the tables."""
        small = Classifier.__new__(Classifier)
        small.bias, small.out, small.base, small.scale, small.shift = self.bias, self.out, self.base, self.scale, self.shift
        return small

    def tables(self) -> list[list[np.ndarray]]:
        return [[(self.embed @ f[j]).astype(np.float32) for j in range(len(f))] for f in self.filters]

    def logits(self, ids: np.ndarray, first: np.ndarray, windows: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        out = np.full(len(first), self.base)
        if not len(first):
            return out
        look = lambda table, at: table[at[:, 0]] + table[at[:, 1]]
        real = np.zeros(len(ids) + 1, np.int64)
        np.add.at(real, first, 1)
        np.add.at(real, first + windows, -1)
        real = np.cumsum(real)[: len(ids) - PAD] > 0
        for k, by_place in enumerate(tables or self.tables()):
            n = len(ids) - PAD
            y = look(by_place[0], ids[:n])
            for j in range(1, len(by_place)):
                y += look(by_place[j], ids[j : n + j])
            y[~real] = -np.inf
            out += np.maximum(np.maximum.reduceat(y, first, 0) + self.bias[k], 0) @ self.out[k]
        return self.scale * out + self.shift


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(0)):
            ids, first, windows = _padded(batch.column(0).slice(a, b - a))
            yield pa.record_batch(
                [pa.array([ids[x : x + n + PAD].tobytes() for x, n in zip(first, windows)], pa.binary()), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], ["ids", "label", "lang"]
            )


class ToxicityModel:
    """A trained classifier with a threshold for each language; ``threshold`` holds for all others."""

    def __init__(self, net: Classifier, threshold: float, by_language: dict[str, float]):
        self.net, self.threshold, self.by_language = net, threshold, by_language

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
        """id, score, threshold, rejected of every whole text; languages only choose the threshold.

        Null and empty texts score like a text of one unknown word. Repeated rows and
        null ids are scored like any other row. An empty table gives no rows.
        """
        small, tables = self.net.head(), self.net.tables()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch.column(1)):
                    z = small.logits(*_padded(batch.column(1).slice(a, b - a)), tables)
                    yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(_sigmoid(z)), batch.column(2).slice(a, b - a)], ["id", "score", "lang"])

        lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
        scored = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"), lang.alias("lang")).mapInArrow(run, "id long, score double, lang string")
        threshold = F.lit(self.threshold)
        for name, value in self.by_language.items():
            threshold = F.when(F.col("lang") == name, F.lit(value)).otherwise(threshold)
        return scored.select(F.col("id").alias(id_col), "score", threshold.alias("threshold"), (F.col("score") >= threshold).alias("rejected"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that the model rejects, in all their columns; needs no shuffle.

    A null text counts as an empty one, repeated rows share their fate, an empty table
    gives no rows.
    """
    return docs.mapInArrow(_passing(model, docs.columns.index(text_col), docs.columns.index(lang_col)), docs.schema)


def _passing(model: ToxicityModel, text: int, lang: int):
    """Batches without the rows that the model rejects."""
    net, tables, threshold, by_language = model.net.head(), model.net.tables(), model.threshold, model.by_language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(text)):
                part = batch.slice(a, b - a)
                limits = np.array([by_language.get(x, threshold) for x in part.column(lang).to_pylist()])
                yield part.filter(pa.array(_sigmoid(net.logits(*_padded(part.column(text)), tables)) < limits))
        release()

    return run


def _best_threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The midpoint of the gap between scores that gives the most F1; ties: the highest."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(hits) + 1) + max(label.sum(), 1))
    best = int(f1.argmax())
    after = score[order][best + 1] if best + 1 < len(order) else 0.0
    return float((score[order][best] + after) / 2)


def train_toxicity(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", key_col: str = "doc_id", most_rows: int = MOST_ROWS) -> ToxicityModel:
    """Fit on at most ``most_rows`` labelled rows, those with the smallest hashes of their key, of texts of any length.

    Rows are taken in that order until their texts have MOST_BYTES together. Rows with a
    null label or text are left out. Without rows of both labels the model scores every
    text alike. The threshold of a language with p positive rows set aside is
    (p * own + PRIOR * that of all) / (p + PRIOR).
    """
    rows = labelled.select(F.xxhash64(key_col).alias("k"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and label is not null")
    order = Window.orderBy("k", "t", "bytes").rowsBetween(Window.unboundedPreceding, -1)
    taken = rows.select("k", "t", F.octet_length("text").alias("bytes")).orderBy("k", "t").limit(most_rows)  # hashes and lengths only
    taken = taken.withColumn("before", F.coalesce(F.sum("bytes").over(order), F.lit(0))).where(F.col("before") < MOST_BYTES).select("k", "t").distinct()
    rows = rows.join(F.broadcast(taken), ["k", "t"], "left_semi").dropDuplicates(["k", "t", "label"]).orderBy("k", "t", "label").select("text", "label", "lang")  # at most ``most_rows`` keys
    model = _fitted(rows.mapInArrow(_bucket_rows, "ids binary, label int, lang string").toArrow().combine_chunks())
    relieve(labelled.sparkSession, now=True)
    return model


def _fitted(got: pa.Table) -> ToxicityModel:
    """The model of rows (ids, label, lang)."""
    texts = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 2) for x in got["ids"]]
    labels, langs = np.asarray(got["label"]).astype(np.int64), got["lang"].to_pylist()
    held = np.arange(len(got)) % 5 == 4
    fit = [x for x, h in zip(texts, held) if not h]
    y = labels[~held]
    if len(set(y.tolist())) < 2:
        net = Classifier(np.zeros(2 * BUCKETS))
        net.out[:], net.base = 0, np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
        return ToxicityModel(net, 0.5, {})
    seen = np.zeros((2, 2 * BUCKETS))
    for x, label in zip(fit, y):
        seen[label, np.unique(x)] += 1
    prior = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / (len(y) - y.sum() + 1))
    prior = np.clip(prior, -3, 3) / 3 * seen.sum(0) / (seen.sum(0) + 4)
    net = Classifier(prior)
    net.train(fit, y)
    calibration = [x for x, h in zip(texts, held) if h] or fit
    t = labels[held] if held.any() else y
    lengths = np.array([len(x) for x in calibration])
    z = net.logits(np.concatenate(calibration), np.cumsum(lengths) - lengths, lengths - PAD)
    a, b = 1.0, 0.0
    for _ in range(500):
        p = _sigmoid(a * z + b)
        ga, gb = ((p - t) * z).mean() + 1e-3 * (a - 1), (p - t).mean()
        a, b = a - 0.05 * ga, b - 0.2 * gb
    net.scale, net.shift = a, b
    score = _sigmoid(a * z + b)
    lang = np.array([x or "" for x, h in zip(langs, held) if h or not held.any()])
    every, by = _best_threshold(score, t) if t.any() else 0.5, {}
    for x in sorted(set(lang)):
        p = int(t[lang == x].sum())
        by[str(x)] = (p * _best_threshold(score[lang == x], t[lang == x]) + PRIOR * every) / (p + PRIOR) if p else every
    return ToxicityModel(net, every, by)


def held_out(key: str = "doc_id"):
    """Rows kept from training: crc32 of the key as text, modulo 5, is 0 (null: as an empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_on_labels(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> ToxicityModel:
    """The model of the ``toxic`` labels of documents that aren't held out."""
    chosen = labels.where(F.col("toxic").isNotNull() & ~held_out()).orderBy(F.xxhash64("doc_id"), "toxic").limit(most_rows).select("doc_id", "toxic")
    return train_toxicity(docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id"), most_rows=most_rows)  # at most ``most_rows`` rows
