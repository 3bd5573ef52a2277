"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are read from whole texts, binned into histograms, boosted level by level on the driver over a bounded
labelled sample, and the trees are flattened into arrays that numpy walks for a whole batch at once.

Defined cases: a null text counts as empty; an empty text has all statistics 0 and still gets a score; rows that repeat
are scored each; with no labels (or one class) every score is the smoothed share of label 1; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakframe.llm.common import bounded, examples, raw, ready, sampled, sigmoid

MARKS = b"!$%&#*|.,;:?<>{}()[]=/@_\"'-"
GROUPS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (32, 9, 13),
    "line": (10,),
    "high": range(128, 256),
    "control": [*range(0, 9), *range(14, 32)],
}
_TABLE = np.zeros((256, len(GROUPS) + len(MARKS)), np.float64)
for _k, _members in enumerate(GROUPS.values()):
    _TABLE[list(_members), _k] = 1
for _k, _mark in enumerate(MARKS):
    _TABLE[_mark, len(GROUPS) + _k] = 1


def statistics(documents: list[bytes]) -> np.ndarray:
    """One row of statistics for each text: shares of kinds of bytes, then shape of words and lines."""
    out = np.zeros((len(documents), _TABLE.shape[1] + 14), np.float32)
    for row, text in zip(out, documents, strict=True):
        if not text:
            continue
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        share = counts / len(text)
        words, lines = text.split(), [x for x in text.split(b"\n") if x]
        n, seen, lined = max(1, len(words)), Counter(words), Counter(lines)
        full = share[share > 0]
        row[: _TABLE.shape[1]] = share @ _TABLE
        row[_TABLE.shape[1] :] = (
            np.log1p(len(text)),
            np.log1p(len(words)),
            len(text) / n,
            max(map(len, words), default=0),
            len(seen) / n,
            max(seen.values(), default=0) / n,
            sum(v for v in seen.values() if v == 1) / n,
            np.log1p(len(lines)),
            len(lined) / max(1, len(lines)),
            sum(len(x) * (v - 1) for x, v in lined.items()) / len(text),
            len(words) / max(1, len(lines)),
            -(full * np.log2(full)).sum(),
            sum(w.isupper() for w in seen) / max(1, len(seen)),
            sum(not w[-1:].isalnum() and w[-1] < 128 for w in seen) / max(1, len(seen)),
        )
    return out


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: node k of tree t splits feature[t, k] at cut[t, k] into nodes 2k+1 and 2k+2."""

    depth: int
    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), sigmoid(np.float64(self.base)))
        tree, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int32)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.cut[tree, node])
        return sigmoid(self.base + self.leaf[tree, node - (2**self.depth - 1)].sum(axis=1))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0) -> Trees:
    """Boosting of the logistic loss; each level's splits come from one histogram of gradients over (node, feature, bin)."""
    n, ones = len(y), float(y.sum())
    base = float(np.log((ones + 1) / (n - ones + 1)))
    empty = Trees(depth, base, np.zeros((0, 2**depth - 1), np.int32), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    if ones in (0, n):
        return empty
    columns = x.shape[1]
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins)[1:-1])) for k in range(columns)]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    cuts = np.full((columns, bins), np.inf)
    for k, e in enumerate(edges):
        cuts[k, : len(e)] = e
    flat = np.arange(columns)[None, :] * bins + binned
    margin = np.full(n, base)
    features, splits, leaves = [], [], []
    for _ in range(trees):
        p = sigmoid(margin)
        g, h = p - y, p * (1 - p)
        feature, cut, node = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * columns * bins + flat).ravel()
            size = width * columns * bins
            left_g = np.bincount(cell, np.repeat(g, columns), size).reshape(width, columns, bins).cumsum(axis=2)
            left_h = np.bincount(cell, np.repeat(h, columns), size).reshape(width, columns, bins).cumsum(axis=2)
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
            gain[~np.isfinite(cuts)[None].repeat(width, 0) | (left_h < 1) | (right_h < 1)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in np.flatnonzero(gain.reshape(width, -1).max(axis=1) > 1e-9):
                feature[first + k], cut[first + k] = best[k] // bins, cuts[best[k] // bins, best[k] % bins]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - (2**depth - 1)
        leaf = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        margin += leaf[at]
        features.append(feature)
        splits.append(cut)
        leaves.append(leaf)
    return Trees(depth, base, np.array(features), np.array(splits), np.array(leaves))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int = 20_000) -> Trees:
    """Fits on at most max_rows labelled documents among those that `learn` (a condition on doc_id) admits."""
    ready(spark)
    picked = sampled(labels, label, learn, max_rows)
    table = examples(docs, picked, lambda found: [x.tobytes() for x in statistics(found)], "binary", max_rows).toArrow()
    y = np.array([float(v) for v in table.column("y").to_pylist()])
    width = statistics([b""]).shape[1]
    return fit(np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(len(y), width), y)


def score(docs: DataFrame, model: Trees, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns of `keep` (else doc_id) and `name`, the chance of label 1, for every row of docs."""
    ready(docs.sparkSession)
    keep = keep or ["doc_id"]
    picked = docs.select(*dict.fromkeys([*keep, "text"]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            value = pa.array(model.score(statistics(raw(b))), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), value], [*keep, name])

    schema = docs.select(*keep).withColumn(name, F.lit(0.0)).schema
    return picked.mapInArrow(scored, schema)
