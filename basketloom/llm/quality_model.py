"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on the driver from the statistics of a bounded sample of labelled documents
(``per_class`` of each class) and kept as flat arrays, which the executors walk for whole blocks at a time.

Nulls, empty tables and odd rows: a null text counts as empty; empty texts have all-zero statistics and get a
score like any other.  Rows without id are scored, never learned from.  If either class has no labelled row,
every score is the share of the class that has (0.5 without any).  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .docstats import all_stats
from .holdout import attach, labelled_sample
from .textblocks import Block, blocks, column_of

#: Labelled documents of each class that the trees are fitted on, at most.
PER_CLASS = 6000


def features(b: Block) -> np.ndarray:
    """Statistics of each text as a matrix of floats."""
    s = all_stats(b)
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["n_chars"], 1)
    lines, distinct = np.maximum(s["n_lines"], 1), s["n_distinct_words"]
    return np.stack(
        [
            np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words,
            s["n_alpha"] / chars, s["n_upper"] / np.maximum(s["n_alpha"], 1), s["n_digits"] / chars, s["n_exclaim"] / words, s["n_pipe"] / words,
            s["n_closed_words"] / words, distinct / words, distinct / np.sqrt(words), s["n_long_words"] / words, s["n_one_char_words"] / words,
            s["n_alpha_words"] / words, s["n_same_next"] / words, s["max_word_chars"], s["n_symbol_words"] / words, words / lines, s["n_at"] / words,
        ],
        axis=1,
    ).astype(np.float32)


N_FEATURES = 21


@dataclass
class Trees:
    """Complete binary trees: node ``i`` has children ``2 i + 1`` and ``2 i + 2``; the last level holds the values."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: float = 3.0) -> Trees:
    """Logistic boosting on binned features; all nodes of a level are split from one set of histograms."""
    n, d, inner = len(y), x.shape[1], 2**depth - 1
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    model = Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])  # x <= edges[k] where code <= k
    margin, found = np.full(n, model.base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = (at - first) * bins
            best = np.full(width, 1e-6)
            pick, where = np.zeros(width, np.int64), np.full(width, -1)
            for j in range(d):
                if not len(edges[j]):
                    continue
                key = slot + code[j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain[:, len(edges[j]) :] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], pick[better], where[better] = top[better], j, k[better]
            for node in np.flatnonzero(where >= 0):
                feature[first + node], cut[first + node] = pick[node], edges[pick[node]][where[node]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[leaf]
        found.append((feature, cut, value))
    return Trees(model.base, *(np.stack(part) for part in zip(*found)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = column_of(batch, "y")
        for lo, hi, b in blocks(column_of(batch, "text")):
            x = features(b).astype(float)
            yield pa.RecordBatch.from_arrays([y.slice(lo, hi - lo).cast(pa.int32()), *map(pa.array, x.T)], names=["y", *(f"f{j}" for j in range(N_FEATURES))])


def train(documents: DataFrame, labels: DataFrame, keep: Column, per_class: int = PER_CLASS, **options) -> Trees:
    """Trees for ``labels.quality`` from the labelled rows that pass ``keep`` (a bounded sample of them)."""
    sample = labelled_sample(labels, "quality", keep, per_class)
    schema = "y int, " + ", ".join(f"f{j} double" for j in range(N_FEATURES))
    rows = attach(documents, sample, "text").select("y", "text").mapInArrow(_featured, schema).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable").to_numpy()
    return fit_trees(rows[:, 1:].astype(np.float32), rows[:, 0].astype(float), **options)


def score(documents: DataFrame, model: Trees, *extra: str, name: str = "score") -> DataFrame:
    """``doc_id``, the columns ``extra``, and the score (as column ``name``) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = list(dict.fromkeys(["doc_id", *extra]))
    fields = [f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in kept]
    return documents.select(*dict.fromkeys([*kept, "text"])).mapInArrow(_scorer(shared, kept, name), ", ".join([*fields, f"`{name}` double"]))


def _scorer(shared, kept: list[str], name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, b in blocks(column_of(batch, "text")):
                yield pa.RecordBatch.from_arrays([*(column_of(batch, k).slice(lo, hi - lo) for k in kept), pa.array(model.score(features(b)))], names=[*kept, name])

    return run
