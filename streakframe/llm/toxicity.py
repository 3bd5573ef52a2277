"""Toxicity: a linear classifier over words and word beginnings, regularised by counterfactuals.

Identity terms are words that name somebody or something without saying anything about toxicity by themselves. Those of a list
of groups count as such wherever they occur; the others are found in the training rows: words that occur often enough in both
classes, at nearly the same rate. A term's counterpart is another term of its group, or for a term that was found the one
that keeps the most alike company. Each labelled text that holds terms has a twin in which they are swapped for their
counterparts. Fitting adds to the logistic loss a penalty on the squared change of the score between the two, so that a
mention by itself moves no score, and an L1 term that keeps the weights of ordinary words at 0.

Executors count words and features of the sampled texts; the driver gets the terms and for each text the few features that are
kept. Defined cases: a null text counts as empty; an empty text gets the score of the intercept; rows that repeat are scored
each; with no labels (or one class) every score is the smoothed share of label 1; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakframe.llm.common import bounded, examples, ready, sampled, saved, sigmoid, texts

#: Mentions of groups, by kind. Fixed values.
IDENTITY = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "girl", "boy", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "christen", "muslime", "juden", "musulmans", "juifs", "chrétiens", "musulmanes", "judíos", "cristianos"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "natives", "foreigners", "einwanderer", "flüchtlinge", "immigrés", "réfugiés", "inmigrantes", "refugiados"),
    ("old", "young", "elderly", "teenage"),
    ("blind", "deaf", "disabled", "autistic"),
)
LISTED = {w.encode(): group[(k + 1) % len(group)].encode() for group in IDENTITY for k, w in enumerate(group)}
_SPLIT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_CACHE = 300_000


def words_of(text: str) -> set[bytes]:
    """Distinct lower-case words; ASCII marks separate them."""
    return set(text.lower().encode().translate(_SPLIT).split())


def features_of(word: bytes) -> tuple[int, ...]:
    """The word itself and its first 3, 4 and 5 bytes, as 32-bit hashes."""
    return (crc32(b"w" + word), *(crc32(b"%d" % n + word[:n]) for n in (3, 4, 5) if len(word) > n))


@dataclass
class Linear:
    """score = sigmoid(intercept + sum of the weights of the distinct words' features). counterpart: the terms of training."""

    intercept: float
    weight: dict[int, float]
    counterpart: dict[bytes, bytes] = field(default_factory=dict, repr=False)
    twins: int = 0
    known: dict[bytes, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> tuple:
        return self.intercept, self.weight, self.counterpart, self.twins

    def __setstate__(self, state: tuple) -> None:
        self.intercept, self.weight, self.counterpart, self.twins = state
        self.known = {}

    def margin(self, documents: list[set[bytes]]) -> np.ndarray:
        """The log odds of texts given as their words."""
        total = np.full(len(documents), self.intercept)
        known, weight = self.known, self.weight
        for k, found in enumerate(documents):
            if len(known) > _CACHE:
                known.clear()
            s = 0.0
            for w in found:
                v = known.get(w)
                if v is None:
                    v = known[w] = sum(weight.get(f, 0.0) for f in features_of(w))
                s += v
            total[k] += s
        return total

    def score(self, documents: list[str]) -> np.ndarray:
        return sigmoid(self.margin([words_of(t) for t in documents]))

    def moved(self, documents: list[str]) -> np.ndarray:
        """How far the log odds of each text that holds terms move when these are swapped."""
        found = [words_of(t) for t in documents]
        both = [(f, t) for f in found if (t := twin(f, self.counterpart))]
        return self.margin([t for _, t in both]) - self.margin([f for f, _ in both])


def worth(counts: np.ndarray, hits: np.ndarray, n: int, ones: float, least: int = 3) -> np.ndarray:
    """How well features tell the classes apart: log ratio of the rates, times the root of the larger class count."""
    rate, other = (hits + 0.5) / (ones + 1), (counts - hits + 0.5) / (n - ones + 1)
    return np.where(counts >= least, np.abs(np.log(rate / other)) * np.sqrt(np.maximum(hits, counts - hits)), 0)


def _fold(rows: list[np.ndarray], vocabulary: np.ndarray) -> list[np.ndarray]:
    """The places in a sorted vocabulary of each row's features, with repeats; others are left out."""
    out = []
    for ids in rows:
        at = np.searchsorted(vocabulary, ids)
        at[at == len(vocabulary)] = 0
        out.append(at[vocabulary[at] == ids].astype(np.int32) if len(vocabulary) else np.zeros(0, np.int32))
    return out


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each entry."""
    count = [len(r) for r in rows]
    return np.repeat(np.arange(len(rows), dtype=np.int32), count), np.concatenate([*rows, np.zeros(0, np.int32)])


class _Places:
    """The places in a vocabulary of the features of words, looked up once for each word."""

    def __init__(self, vocabulary: np.ndarray) -> None:
        self.at = {int(f): k for k, f in enumerate(vocabulary)}
        self.known: dict[bytes, list[int]] = {}

    def of(self, found: set[bytes]) -> np.ndarray:
        out: list[int] = []
        for w in found:
            places = self.known.get(w)
            if places is None:
                if len(self.known) > _CACHE:
                    self.known.clear()
                places = self.known[w] = [self.at[f] for f in features_of(w) if f in self.at]
            out += places
        return np.sort(np.array(out, np.int32))


def _difference(plain: np.ndarray, swapped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features that two texts hold unequally often, and how many times more the second does."""
    ids, at = np.unique(np.concatenate((plain, swapped)), return_inverse=True)
    more = np.bincount(at, np.repeat((-1.0, 1.0), (len(plain), len(swapped))), len(ids))
    return ids[more != 0].astype(np.int32), more[more != 0]


def fit(x: list[np.ndarray], twins: list[np.ndarray], y: np.ndarray, keep: int = 4096, least: int = 3, **settings: float) -> Linear:
    """fit_kept over the `keep` features that tell the classes apart best.

    twins[i]: the features of text i with its identity terms swapped; empty if it names none.
    """
    n, ones = len(y), float(y.sum())
    if ones in (0, n):
        return Linear(float(np.log((ones + 1) / (n - ones + 1))), {})
    own = [np.unique(r) for r in x]
    ids, counts = np.unique(np.concatenate(own), return_counts=True)
    hits = np.bincount(np.searchsorted(ids, np.concatenate(own)), np.repeat(y, [len(r) for r in own]), len(ids))
    value = worth(counts, hits, n, ones, least)
    vocabulary = np.sort(ids[np.argsort(-value, kind="stable")[:keep]])
    vocabulary = vocabulary[value[np.searchsorted(ids, vocabulary)] > 0]
    return fit_kept(vocabulary, _fold(x, vocabulary), _fold(twins, vocabulary), np.array([len(t) > 0 for t in twins], bool), y, **settings)


def fit_kept(vocabulary: np.ndarray, x: list[np.ndarray], twins: list[np.ndarray], named: np.ndarray, y: np.ndarray, l1: float = 1e-4, swap: float = 1.0, steps: int = 600, power: float = 0.5) -> Linear:
    """Accelerated proximal gradient. x and twins: places in the vocabulary; named: the texts that have a twin.

    power: 1 gives both labels the same weight in all, 0 every text. swap: the weight of the squared change of the log odds.
    """
    n, ones, m = len(y), float(y.sum()), len(vocabulary)
    prior = float(np.log((ones + 1) / (n - ones + 1)))
    if ones in (0, n):
        return Linear(prior, {})
    cell, value = np.unique(np.ravel_multi_index(_flat(x), (n, max(1, m))), return_counts=True)
    row, col, value = (cell // max(1, m)).astype(np.int32), (cell % max(1, m)).astype(np.int32), value.astype(np.float64)
    # of a twin only what differs moves the score: (pair, feature, how many times more)
    pairs = [_difference(x[k], twins[k]) for k in np.flatnonzero(named)]
    pair, own = _flat([f for f, _ in pairs])
    sign = np.concatenate([*(v for _, v in pairs), np.zeros(0)])
    cost = np.where(y > 0, 0.5 * n / ones, 0.5 * n / (n - ones)) ** power
    w, b, at, at_b, t = np.zeros(m), prior, np.zeros(m), prior, 1.0
    many = np.bincount(row, value, n) + 1
    curve = 0.25 * np.bincount(col, value * (cost * many)[row], m) / n
    if len(own):
        spread = np.bincount(pair, np.abs(sign), len(pairs))
        curve += 2 * swap / n * np.bincount(own, np.abs(sign) * spread[pair], m)
    step, step_b = 1 / np.maximum(curve, 1e-6), 1 / (0.25 * (cost * many).sum() / n)
    for _ in range(steps):
        z = at_b + np.bincount(row, value * at[col], n)
        r = cost * (sigmoid(z) - y) / n
        grad = np.bincount(col, value * r[row], m)
        if len(own):
            change = np.bincount(pair, sign * at[own], len(pairs))
            grad += 2 * swap / n * np.bincount(own, sign * change[pair], m)
        new = at - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_b, t_next = at_b - step_b * r.sum(), (1 + (1 + 4 * t * t) ** 0.5) / 2
        at, at_b = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return Linear(float(b), {int(f): float(v) for f, v in zip(vocabulary, w, strict=True) if v}, twins=int(named.sum()))


def _vector(found: set[bytes]) -> np.ndarray:
    return np.fromiter((f for w in sorted(found) for f in features_of(w)), np.uint32)


def twin(found: set[bytes], counterpart: Mapping[bytes, bytes] = LISTED) -> set[bytes]:
    """The words with each identity term swapped; empty if there is none."""
    return {counterpart.get(w, w) for w in found} if found & counterpart.keys() else set()


def matched(names: list[bytes], together: np.ndarray) -> dict[bytes, bytes]:
    """Pairs of terms that keep the most alike company. together[i, j]: texts that hold both i and j."""
    size = np.sqrt(np.maximum(1, np.diag(together)))
    alike = together / size[:, None] / size[None, :]
    np.fill_diagonal(alike, -1)
    out: dict[bytes, bytes] = {}
    for k in np.argsort(-alike, axis=None, kind="stable"):
        a, b = names[k // len(names)], names[k % len(names)]
        if a != b and a not in out and b not in out:
            out[a], out[b] = b, a
    return out


def find_terms(sample: DataFrame, n: int, ones: int, most: int = 64, share: float = 0.005, least: int = 8) -> list[bytes]:
    """Words that say nothing about the label: in `share` and `least` of the texts of either class or more, at rates within a tenth.

    sample: (y, words); at most `most` words, those of the most nearly equal rates.
    """
    word = sample.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("c"), F.sum("y").alias("h"))
    rate, other = F.col("h") / max(1, ones), (F.col("c") - F.col("h")) / max(1, n - ones)
    gap = F.abs(F.log(rate / other))
    both = F.least(F.col("h"), F.col("c") - F.col("h"))
    often = (both >= least) & (rate >= share) & (other >= share) & (rate <= 0.2) & (F.length("word") >= 3)
    return [bytes(r.word) for r in word.where(often).where(gap <= 0.1).orderBy(gap, "word").limit(most).collect()]


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int = 6_000, keep: int = 4096, least: int = 3, **settings: float) -> Linear:
    """Fits on at most max_rows labelled documents among those that `learn` (a condition on doc_id) admits."""
    ready(spark)
    picked = sampled(labels, label, learn, max_rows)
    rows = examples(docs, picked, lambda found: [sorted(words_of(t.decode())) for t in found], "array<binary>", max_rows)
    # a few texts to a task: their number is bounded, so that of tasks is
    spread = rows.select(F.col("y").cast("double").alias("y"), F.col("x").alias("words")).repartition(max(1, max_rows // 500))
    sample = saved(spark, spread, "toxicity")
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if ones in (0, n):
        return Linear(float(np.log((ones + 1) / (n - ones + 1))), {})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, ...]] = {}
        for b in batches:
            count, hits = Counter(), Counter()
            for y, found in zip(b.column("y").to_pylist(), b.column("words").to_pylist(), strict=True):
                own = {f for w in found for f in known.get(w) or known.setdefault(w, features_of(w))}
                count.update(own)
                hits.update(own if y else ())
            ids = list(count)
            columns = [pa.array(ids, pa.int64()), pa.array([count[f] for f in ids], pa.int64()), pa.array([hits[f] for f in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "c", "h"])

    each = sample.mapInArrow(counted, "id long, c long, h long").groupBy("id").agg(F.sum("c").alias("c"), F.sum("h").alias("h"))
    log = F.log(((F.col("h") + 0.5) / (ones + 1)) / ((F.col("c") - F.col("h") + 0.5) / (n - ones + 1)))
    value = F.abs(log) * F.sqrt(F.greatest(F.col("h"), F.col("c") - F.col("h")))
    # each task sends its best to the driver: the features of a bounded sample need few tasks, however many Spark would take
    best = each.where(F.col("c") >= least).where(value > 0).coalesce(4).orderBy(value.desc(), "id").limit(keep)
    vocabulary = np.sort(np.array([r.id for r in best.select("id").collect()], np.int64)).astype(np.uint32)

    terms = find_terms(sample, n, ones)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[k for k, w in enumerate(terms) if w in own] for own in map(set, b.column("words").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["at"])

    together = np.zeros((len(terms), len(terms)))
    for at in sample.mapInArrow(held, "at array<int>").toArrow().column("at").to_pylist():
        together[np.ix_(at, at)] += 1
    counterpart = {**matched(terms, together), **LISTED}

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(vocabulary)
        for b in batches:
            found = [set(own) for own in b.column("words").to_pylist()]
            other = [twin(own, counterpart) for own in found]
            sides = [pa.array([places.of(s).tobytes() for s in side], pa.binary()) for side in (found, other)]
            yield pa.RecordBatch.from_arrays([b.column("y"), *sides, pa.array([bool(t) for t in other])], ["y", "x", "twin", "named"])

    table = sample.mapInArrow(kept, "y double, x binary, twin binary, named boolean").toArrow()
    rows = sorted(zip(*(table.column(c).to_pylist() for c in table.column_names), strict=True))
    y, x, twins, named = ([r[k] for r in rows] for k in range(4))
    x, twins = ([np.frombuffer(v, np.int32) for v in side] for side in (x, twins))
    model = fit_kept(vocabulary, x, twins, np.array(named), np.array(y), **settings)
    model.counterpart = counterpart
    return model


def score(docs: DataFrame, model: Linear, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns of `keep` (else doc_id) and `name`, the chance of being toxic, for every row of docs."""
    ready(docs.sparkSession)
    keep = keep or ["doc_id"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(model.score(texts(b)), pa.float64())], [*keep, name])

    schema = docs.select(*keep).withColumn(name, F.lit(0.0)).schema
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(scored, schema)
