"""Language ID by error-correcting output codes.

Every language gets a codeword; one binary classifier over hashed byte 2- and 3-grams predicts each bit; decoding takes
the language whose codeword has the least loss, each bit weighted by how well its classifier separates the training
texts. A small gap to the runner-up flags the text as ambiguous.

Defined cases: a text that is null or has no letter is `und` with score 0; so is every text when no language could be
learned; with one learned language every other text gets it with score 1. Ties go to the first language in sorted order.
Rows that repeat are predicted each; an id may have several texts and languages; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakframe.llm.common import bounded, examples, ready, sigmoid, texts

UNKNOWN = "und"
_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_CELLS = 8192
_CHUNK = 128


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 for each language; no column is constant, equal to another or its opposite.

    Up to five languages: every such column. More: columns drawn until the words are far apart.
    """
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 5:
        tails = [t for t in product((1, -1), repeat=languages - 1) if -1 in t]
        return np.array([(1, *t) for t in tails], float).T
    draw, bits = np.random.default_rng(7), max(15, 4 * int(np.ceil(np.log2(languages))))
    best, far = None, -1
    for _ in range(200):
        code = draw.choice((-1.0, 1.0), (languages, bits))
        if np.abs(code.sum(axis=0)).max() == languages:
            continue
        apart = min(int((code[a] != code[b]).sum()) for a, b in combinations(range(languages), 2))
        if apart > far:
            best, far = code, apart
    return best


def lettered(text: str) -> bool:
    """Whether the text has a letter: a character of Unicode's categories L."""
    return any(map(str.isalpha, text))


def cells(text: bytes) -> np.ndarray:
    """The cell of each 2-gram and 3-gram of letters and gaps."""
    a = np.frombuffer(b" " + text.translate(_BLANK) + b" ", np.uint8).astype(np.uint32)
    if len(a) > 2:
        a = a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))]
    two = a[:-1] * 257 + a[1:]
    three = two[:-1] * 257 + a[2:]
    return np.concatenate((two * np.uint32(2654435761) >> np.uint32(19), _CELLS + (three * np.uint32(2246822519) >> np.uint32(19))))


@dataclass(frozen=True)
class Codes:
    """languages in sorted order, their codewords, a weight column and intercept for each bit, each bit's say."""

    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    intercept: np.ndarray
    say: np.ndarray

    def margins(self, documents: list[bytes]) -> np.ndarray:
        out = []
        for k in range(0, len(documents), _CHUNK):
            part = [cells(t) for t in documents[k : k + _CHUNK]]
            count = np.array([len(c) for c in part])
            at = np.repeat(np.arange(len(part)) * 2 * _CELLS, count) + np.concatenate(part)
            dense = np.bincount(at, minlength=len(part) * 2 * _CELLS).astype(np.float32).reshape(len(part), -1)
            out.append(dense @ self.weight / np.maximum(1, count)[:, None] + self.intercept)
        return np.concatenate(out) if out else np.zeros((0, len(self.intercept)))

    def predict(self, documents: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score in 0 to 1, and whether the two nearest codewords are about as near."""
        known = np.array([bool(self.languages) and lettered(t) for t in documents], bool)
        names, scores, unsure = [UNKNOWN] * len(documents), np.zeros(len(documents)), np.zeros(len(documents), bool)
        if not known.any():
            return names, scores, unsure
        at = np.flatnonzero(known)
        if len(self.languages) == 1:
            near = np.ones((len(at), 1))
        else:
            margin = self.margins([documents[k].lower().encode() for k in at])
            loss = (np.logaddexp(0, -margin[:, None, :] * self.code[None]) * self.say).sum(axis=2)
            near = np.exp(loss.min(axis=1, keepdims=True) - loss)
            near /= near.sum(axis=1, keepdims=True)
        best = near.argmax(axis=1)
        for k, j in zip(at, best, strict=True):
            names[k] = self.languages[j]
        scores[at] = near[np.arange(len(at)), best]
        if len(self.languages) > 1:
            two = np.sort(near, axis=1)[:, -2:]
            unsure[at] = two[:, 1] - two[:, 0] < 0.2
        return names, scores, unsure


def pieces_of(text: str, pieces: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cells and counts of the whole text and of short pieces at places that the text itself decides."""
    if not lettered(text):
        return []
    draw, parts = np.random.default_rng(crc32(text.encode())), [text]
    for _ in range(pieces):
        length = int(draw.integers(4, 120))
        start = int(draw.integers(0, max(1, len(text) - length)))
        if lettered(text[start : start + length]):
            parts.append(text[start : start + length])
    return [np.unique(cells(t.lower().encode()), return_counts=True) for t in parts]


def fit(documents: list[str], languages: list[str], pieces: int = 3, steps: int = 60) -> Codes:
    """fit_counts on texts."""
    found = [(e, name) for text, name in zip(documents, languages, strict=True) for e in pieces_of(text, pieces)]
    return fit_counts([e for e, _ in found], [name for _, name in found], steps)


def fit_counts(rows: list[tuple[np.ndarray, np.ndarray]], languages: list[str], steps: int = 60) -> Codes:
    """Logistic bits over shares of n-grams. rows: cells and counts of each example."""
    names = sorted(set(languages))
    code = codewords(len(names))
    bits = code.shape[1] if len(names) > 1 else 1
    weight, intercept = np.zeros((2 * _CELLS, bits), np.float32), np.zeros(bits)
    if len(names) < 2:
        return Codes(names, code, weight, intercept, np.ones(bits))
    marks = [names.index(name) for name in languages]
    target = code[marks]
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    cell = np.concatenate([i for i, _ in rows])
    value = np.concatenate([c / c.sum() for _, c in rows]).astype(np.float32)
    scale = np.sqrt(1 / np.maximum(np.bincount(cell, value**2, 2 * _CELLS), 1e-3))
    share = 1 / np.maximum(1, np.bincount(marks, minlength=len(names)))[marks] / len(names)
    order, by_cell = np.argsort(cell, kind="stable"), np.bincount(cell, minlength=2 * _CELLS)
    starts, some = np.concatenate(([0], np.cumsum(by_cell)[:-1])), by_cell > 0
    row_starts = np.concatenate(([0], np.cumsum([len(i) for i, _ in rows])[:-1]))
    v, first, second = value[:, None], np.zeros_like(weight), np.zeros_like(weight)
    for step in range(1, steps + 1):
        z = np.add.reduceat(weight[cell] * v, row_starts, axis=0) + intercept
        pull = -target * sigmoid(-target * z) * share[:, None]
        grad = np.zeros_like(weight)
        grad[some] = np.add.reduceat((pull[row] * v)[order], starts[some], axis=0)
        grad = grad * scale[:, None] * 50 + 1e-5 * weight
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        weight -= 4.0 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        intercept -= 2.0 * pull.sum(axis=0)
    z = np.add.reduceat(weight[cell] * v, row_starts, axis=0) + intercept
    right = (share[:, None] * (z * target > 0)).sum(axis=0) / share.sum()
    say = np.clip(np.log(np.clip(right, 0.5, 0.999) / (1 - np.clip(right, 0.5, 0.999))), 0.05, None)
    return Codes(names, code, weight, intercept, say * 3 / say.sum())


def train(spark: SparkSession, docs: DataFrame, learn: Column, max_rows: int = 800, pieces: int = 3) -> Codes:
    """Fits on at most max_rows documents with a language among those that `learn` admits, by a hash of the id.

    Executors count whole texts and pieces of them; the driver gets counts, whose size is bounded whatever a text's length.
    """
    ready(spark)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & learn).select("doc_id", "text", F.col("lang").alias("y"))
    picked = known.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows).distinct()

    def counted(found: list[bytes]) -> list[list[bytes]]:
        return [[x.astype(np.uint32).tobytes() for e in pieces_of(t.decode(), pieces) for x in e] for t in found]

    table = examples(known, picked, counted, "array<binary>", max_rows, ("doc_id", "y")).toArrow()
    rows, languages = [], []
    for name, flat in zip(table.column("y").to_pylist(), table.column("x").to_pylist(), strict=True):
        parts = [np.frombuffer(x, np.uint32) for x in flat]
        rows += zip(parts[::2], parts[1::2], strict=True)
        languages += [name] * (len(parts) // 2)
    return fit_counts(rows, languages)


def predict(docs: DataFrame, model: Codes, keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` (else doc_id), `lang_pred`, `score` and `ambiguous` for every row of docs."""
    ready(docs.sparkSession)
    keep = keep or ["doc_id"]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            names, scores, unsure = model.predict(texts(b))
            columns = [*(b.column(k) for k in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score", "ambiguous"])

    schema = docs.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "ambiguous": F.lit(False)}).schema
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(predicted, schema)
