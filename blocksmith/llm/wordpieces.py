"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie. A failure link of a node leads to the node for what is left
after the longest tokens at its front are popped, and the node keeps how many tokens
that pops. A word is read once, byte by byte; where the trie has no edge, the link is
followed and its count added, so lengths come without building any piece. Words of
many texts are read side by side in NumPy, each distinct word once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import segments, slices, word_hashes, words

#: The symbol after the last byte of a word.
END = 256
NONE = -1


class Automaton:
    """Trie of byte strings over symbols 0 to 256; a token may end with END."""

    def __init__(self, tokens: list[tuple[int, ...]]):
        edges: dict[tuple[int, int], int] = {}
        parent, symbol, final = [NONE], [NONE], [False]
        for token in tokens:
            at = 0
            for c in token:
                to = edges.get((at, c))
                if to is None:
                    to = edges[at, c] = len(parent)
                    parent.append(at)
                    symbol.append(c)
                    final.append(False)
                at = to
            final[at] = bool(token)
        n = len(parent)
        depth = np.zeros(n, np.int64)
        for v in range(1, n):  # parents come first
            depth[v] = depth[parent[v]] + 1
        link, popped = [NONE] * n, [0] * n
        for v in np.argsort(depth, kind="stable").tolist():
            if v == 0:
                continue
            if final[v]:
                link[v], popped[v] = 0, 1
                continue
            at, count = link[parent[v]], popped[parent[v]]
            while at != NONE and (at, symbol[v]) not in edges:
                count += popped[at]
                at = link[at]
            if at != NONE:
                link[v], popped[v] = edges[at, symbol[v]], count
        keys = np.array([a * 257 + c for a, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.array(list(edges.values()), np.int64)[order]
        self.link, self.popped = np.array(link), np.array(popped)

    def _step(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Target of each edge, NONE where there is none."""
        if not len(self.keys):
            return np.full(len(at), NONE)
        key = at * 257 + symbols
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.targets[i], NONE)

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word data[start:end] with END after it; 1, the unknown token, where the vocabulary can't spell it."""
        order = np.argsort(ends - starts, kind="stable")[::-1]
        starts, size = starts[order], (ends - starts)[order]
        at, count, shorter = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), -size
        for k in range(int(size[0]) + 1 if len(size) else 0):
            live = int(np.searchsorted(shorter, -k, "right"))  # words with at least k bytes
            idx = np.flatnonzero(at[:live] != NONE)
            symbols = np.where(size[idx] > k, data[np.minimum(starts[idx] + k, len(data) - 1)].astype(np.int64), END)
            while len(idx):
                to = self._step(at[idx], symbols)
                moved = to != NONE
                at[idx[moved]] = to[moved]
                idx, symbols = idx[~moved], symbols[~moved]
                count[idx] += self.popped[at[idx]]
                at[idx] = self.link[at[idx]]
                stay = at[idx] != NONE
                idx, symbols = idx[stay], symbols[stay]
        while len(idx := np.flatnonzero((at != NONE) & (at != 0))):
            count[idx] += self.popped[at[idx]]
            at[idx] = self.link[at[idx]]
        out = np.empty(len(order), np.int64)
        out[order] = np.where(at == NONE, 1, count)
        return out


def word_end_vocabulary(path: str) -> list[tuple[int, ...]]:
    """Tokens of a byte-level vocabulary whose words end with ``</w>``; special tokens are left out."""
    from .tokens import byte_characters

    plan = json.loads(open(path, encoding="utf-8").read())
    special = {x["content"] for x in plan.get("added_tokens", [])}
    to_byte = {c: b for b, c in byte_characters().items()}
    out = []
    for token in plan["model"]["vocab"]:
        if token not in special:
            body = token.removesuffix("</w>")
            out.append(tuple(to_byte[c] for c in body) + ((END,) if body != token else ()))
    return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_automata: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _automata:
        _automata[path] = Automaton(word_end_vocabulary(path))
    return _automata[path]


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_tokens, longest_word (tokens of the word that has most).

    Words are runs without space and control characters 9 to 13, with A-Z lowered;
    each is cut greedily into the longest tokens of the vocabulary, the last of which
    ends the word. A word that can't be cut so counts as one unknown token. Null and
    empty texts have no words. Rows may repeat and ids may be null. An empty table
    gives no rows. Further columns are ignored.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                n, total, most = (np.zeros(b - a, np.int64) for _ in range(3))
                for part in segments(batch.column(1).slice(a, b - a)):
                    data, starts, ends, bounds = words(part)
                    _, first, again = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
                    counts = machine.lengths(data, starts[first], ends[first])[again]
                    sums, has = np.append(0, np.cumsum(counts)), np.diff(bounds) > 0
                    n += np.diff(bounds)
                    total += sums[bounds[1:]] - sums[bounds[:-1]]
                    if len(counts):
                        most[has] = np.maximum(most[has], np.maximum.reduceat(counts, bounds[:-1][has]))
                yield pa.record_batch([batch.column(0).slice(a, b - a), *(pa.array(x.astype(np.int64)) for x in (n, total, most))], ["id", "n_words", "n_tokens", "longest_word"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
    return source.mapInArrow(run, "id long, n_words long, n_tokens long, longest_word long").withColumnRenamed("id", id_col)
