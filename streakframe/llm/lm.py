"""Language-model scores: interpolated modified Kneser-Ney over word pairs.

Counting: every task counts words and pairs of its part and sends them, sorted and compressed, to shards by a hash; a
shard sums them and writes one file of sorted 64-bit keys with counts. A hot word or pair arrives as one count from each
task, and the pairs of one word spread over all shards. Shards also pass on what smoothing needs of each word: how often
and with how many different words it goes on (a context), and after how many different words it comes (a continuation).

Scoring: workers memory-map the files and look up keys by binary search, for each Arrow batch its distinct words and pairs
once. Probabilities over all known words and one unknown word sum to 1 in every context.

A word's key is its XXH64. A pair's key is the upper 40 bits of both its words' keys, kept in 8 and 2 bytes; words that share
them share pairs (n^2 / 2^41 cases among n words: one word in 2,000 of a billion), which touches smoothing only: counts of
single words use whole keys.

Sizes: a shard holds the counts of a bounded volume of text, so the number of shards grows with the input. Tasks deal to at most
MOST coarse shards, and where there are more, a second pass deals each coarse shard on to its own shards. A worker keeps a bounded number
of bytes of shards open and closes the one that it has used least recently.

Defined cases: a null text is empty and has one token, its end; without training text every token has probability 1 in
score (one unknown word) and the base is log10 of 0.1 / 0.1; null ids are scored and never learned from; rows that repeat
count and are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streakframe.llm.common import bounded, map_file, new_folder, raw, ready, saved, write_file

#: Their spaces keep these apart from any word.
END, BEGIN = (xxhash.xxh64_intdigest(x) for x in (b" end", b" begin"))
_BUFFER = 3_000_000
#: Shards that a task deals to, and bytes of shards that a worker keeps open.
MOST, OPEN_BYTES = 4096, 256 << 20
#: Of a word's key the part that pairs have: its upper 40 bits.
_CUT, _REST, _LOW = np.uint64(24), np.uint64(16), np.uint64(0xFFFF)
_ROW = "kind string, shard int, n long, blob binary, tally array<long>"


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, the first ascending: differences, byte planes, zstd."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in (first, *columns[1:])]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize * n for k in kinds]
    data = pa.decompress(blob, decompressed_size=sum(sizes), codec="zstd", asbytes=True)
    out, at = [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        planes = np.frombuffer(data, np.uint8, size, at).reshape(-1, n)
        out.append(np.ascontiguousarray(planes.T).view(kind)[:, 0])
        at += size
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


def _summed(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return [key[start], *(np.add.reduceat(v[order], start, dtype=np.uint64) if len(start) else v.astype(np.uint64) for v in values)]


def _summed_pairs(high: np.ndarray, low: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Distinct pairs in order and the sums of their counts."""
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    start = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))) if len(high) else np.zeros(0, np.int64)
    return [high[start], low[start], np.add.reduceat(count[order], start, dtype=np.uint64) if len(start) else count.astype(np.uint64)]


def _spread(key: np.ndarray, shards: int) -> np.ndarray:
    mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(shards)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "shard", "n", "blob", "tally"])


def _dealt(kind: str, shard: np.ndarray, shards: int, *columns: np.ndarray) -> list[tuple]:
    """A row for each shard that gets anything."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    return [
        (kind, k, int(cuts[k + 1] - cuts[k]), _packed(*(c[order[cuts[k] : cuts[k + 1]]] for c in columns)), None)
        for k in range(shards)
        if cuts[k + 1] > cuts[k]
    ]


def hashes(text: bytes) -> list[int]:
    """Keys of the words of a text, then of its end."""
    digest = xxhash.xxh64_intdigest
    return [*(digest(w) for w in text.lower().split()), END]


def _stream(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all tokens, keys of what comes before each, and where each document begins."""
    found = [hashes(t) for t in documents]
    count = np.array([len(f) for f in found], np.int64)
    start = np.cumsum(count) - count
    key = np.fromiter((h for f in found for h in f), np.uint64, int(count.sum()))
    before = np.roll(key, 1)
    before[start] = BEGIN
    return key, before, start


def pairs(before: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two columns of pairs' keys: 40 bits of the first word and 24 of the second, and the second's other 16."""
    return (before >> _CUT) << _CUT | key >> (_CUT + _REST), (key >> _CUT & _LOW).astype(np.uint16)


def _contexts(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 40 bits of the first and of the second word of pairs."""
    return high >> _CUT, (high & np.uint64((1 << 24) - 1)) << _REST | low


def _distinct(before: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct pair of whole keys comes first, and which of them each place has."""
    mixed = (before ^ (before >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + key
    _, first, which = np.unique(mixed, return_index=True, return_inverse=True)
    return first, which


def _counted(batches: Iterator[pa.RecordBatch], shards: int, ratio: int) -> Iterator[pa.RecordBatch]:
    """Counts of words and pairs for each coarse shard, of `ratio` shards each."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flushed() -> pa.RecordBatch:
        nonlocal size
        key, before = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        size = 0
        word, count = np.unique(key, return_counts=True)
        word, count = np.append(word, np.uint64(BEGIN)), np.append(count, 0)
        word, count = word[np.argsort(word)], count[np.argsort(word)]
        first, which = _distinct(before, key)
        high, low, times = _summed_pairs(*pairs(before[first], key[first]), np.bincount(which))
        coarse = lambda x: _spread(x, shards) // np.uint64(ratio)
        rows = _dealt("word", coarse(word >> _CUT), shards // ratio, word, count.astype(np.uint32))
        return _rows(rows + _dealt("pair", coarse(high), shards // ratio, high, low, times.astype(np.uint32)))

    for b in bounded(batches, most=1 << 20):
        key, before, _ = _stream(raw(b))
        held.append((key, before))
        size += len(key)
        if size >= _BUFFER:
            yield flushed()
    if size:
        yield flushed()


def _redealt(batches: Iterator[pa.RecordBatch], shards: int, ratio: int) -> Iterator[pa.RecordBatch]:
    """Rows of coarse shards, sorted by kind and shard, as rows of their own shards; a bounded number of keys at once."""
    held: list[list[np.ndarray]] = []
    now: tuple[str, int] | None = None

    def flushed() -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        columns = _summed(*columns) if now[0] == "word" else _summed_pairs(*columns)
        own = _spread(columns[0] >> _CUT if now[0] == "word" else columns[0], shards) - np.uint64(now[1] * ratio)
        rows = _dealt(now[0], own, ratio, *columns[:-1], columns[-1])
        return _rows([(kind, now[1] * ratio + shard, n, blob, None) for kind, shard, n, blob, _ in rows])

    for b in batches:
        for row in b.to_pylist():
            if held and (now != (row["kind"], row["shard"]) or sum(len(h[0]) for h in held) >= _BUFFER):
                yield flushed()
            now = row["kind"], row["shard"]
            held.append(_unpacked(row["blob"], row["n"], *_KINDS[now[0]]))
    if held:
        yield flushed()


#: Types of the columns that tasks send. After a second dealing counts are 64 bits.
_KINDS = {"word": (np.uint64, np.uint32), "pair": (np.uint64, np.uint16, np.uint32)}


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32 if values.max(initial=0) < 1 << 32 else np.uint64)


def _write(uri: str, *columns: np.ndarray) -> None:
    """A count, the item size of each column, then the columns."""
    head = np.array([len(columns[0]), len(columns), *(c.dtype.itemsize for c in columns)], np.uint64)
    write_file(uri, [head.tobytes(), *(np.ascontiguousarray(c).data for c in columns)])


def _map(uri: str) -> list[np.ndarray]:
    data = map_file(uri)
    n, k = (int(x) for x in np.frombuffer(data, np.uint64, 2))
    out, at = [], 8 * (2 + k)
    for size in np.frombuffer(data, np.uint64, k, 16).tolist():
        out.append(np.frombuffer(data, f"u{size}", n, at))
        at += int(size) * n
    return out


def _tally(values: np.ndarray) -> list[int]:
    """How many values are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(values, 5).astype(np.int64), minlength=6)[1:5].tolist()


def _merged(table: pa.Table, folder: str, shards: int, wide: bool = False) -> pa.RecordBatch:
    """Sums one shard. Pairs go to a file, and their contexts and continuations on to the words' shards. wide: counts of 64 bits."""
    kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
    types = (*_KINDS[kind][:-1], np.uint64 if wide else np.uint32)
    parts = [_unpacked(b, n, *types) for b, n in zip(table.column("blob").to_pylist(), table.column("n").to_pylist(), strict=True)]
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    del parts
    if kind == "word":
        key, count = _summed(*columns)
        return _rows([("word", shard, len(key), _packed(key, count), None)])
    high, low, count = _summed_pairs(*columns)
    _write(f"{folder}/pair-{shard}", high, low, _small(count))
    first, second = _contexts(high, low)
    context, total, one, two, more = _summed(first, count, count == 1, count == 2, count >= 3)
    after, times = np.unique(second, return_counts=True)
    return _rows(
        [
            ("tally", shard, 0, b"", _tally(count)),
            *_dealt("context", _spread(context, shards), shards, context, total, *(x.astype(np.uint32) for x in (one, two, more))),
            *_dealt("after", _spread(after, shards), shards, after, times.astype(np.uint32)),
        ]
    )


def _joined(table: pa.Table, folder: str) -> pa.RecordBatch:
    """Writes the file of one shard of words: key, count, continuations, context total, contexts' counts of 1, 2 and more."""
    rows = table.to_pylist()
    shard = rows[0]["shard"]
    word, count = next(_unpacked(r["blob"], r["n"], np.uint64, np.uint64) for r in rows if r["kind"] == "word")
    upper = word >> _CUT
    columns = []
    for kind, types in (("after", (np.uint64, np.uint32)), ("context", (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32))):
        parts = [_unpacked(r["blob"], r["n"], *types) for r in rows if r["kind"] == kind]
        parts = parts or [[np.zeros(0, t) for t in types]]
        own, *values = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        at = np.searchsorted(own, upper)
        at[at == len(own)] = 0
        there = own[at] == upper if len(own) else np.zeros(len(upper), bool)
        columns += [np.where(there, v[at], 0) if len(own) else np.zeros(len(upper), np.uint64) for v in values]
    _write(f"{folder}/word-{shard}", word, *(_small(c) for c in (count, *columns)))
    after = columns[0]
    tally = [int(count.sum()), int((count > 0).sum()), int(after.sum()), int((after >= 3).sum()), *_tally(after)]
    return _rows([("words", shard, 0, b"", tally)])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more; of small samples, where a count of counts is 0, 0.5, 0.75 and 0.9."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


@dataclass
class Model:
    """Files of sorted keys in `folder`, and what holds for all of them."""

    folder: str
    shards: int
    train_tokens: int = 0
    vocabulary: int = 0
    continuations: int = 0
    kinds: tuple[int, int, int] = (0, 0, 0)
    pair_discount: tuple[float, float, float] = (0.5, 0.75, 0.9)
    word_discount: tuple[float, float, float] = (0.5, 0.75, 0.9)
    there: frozenset[str] = frozenset()
    open: dict[str, list[np.ndarray]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "open": {}}

    def look_up(self, kind: str, keys: np.ndarray, shard: np.ndarray, columns: int, second: np.ndarray | None = None) -> list[np.ndarray]:
        """The columns' values of each key; 0 for a key that isn't there. second: the second column of pairs' keys."""
        out = [np.zeros(len(keys), np.float64) for _ in range(columns)]
        order = np.argsort(shard, kind="stable")
        held, first = np.unique(shard[order], return_index=True)
        for k, start, stop in zip(held.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            name = f"{kind}-{k}"
            if name not in self.there:
                continue
            own, *values = self.shard(name)
            some = order[start:stop]
            at = np.searchsorted(own, keys[some])
            last = max(0, len(own) - 1)
            there = (at <= last) & (own[np.minimum(at, last)] == keys[some])
            if second is None:
                hit = there
            else:
                # pairs that agree in the first column lie side by side, a few at most
                rest, *values = values
                hit = there & (rest[np.minimum(at, last)] == second[some])
                open_ = there & ~hit
                while open_.any():
                    at[open_] += 1
                    open_ &= (at <= last) & (own[np.minimum(at, last)] == keys[some])
                    found = open_ & (rest[np.minimum(at, last)] == second[some])
                    hit |= found
                    open_ &= ~found
            for o, v in zip(out, values, strict=True):
                o[some[hit]] = v[at[hit]]
        return out

    def shard(self, name: str) -> list[np.ndarray]:
        """A shard's columns; of those open the least recently used are closed beyond OPEN_BYTES."""
        columns = self.open.pop(name, None) or _map(f"{self.folder}/{name}")
        self.open[name] = columns
        size = sum(c.nbytes for own in self.open.values() for c in own)
        for old in list(self.open)[:-1]:
            if size <= OPEN_BYTES:
                break
            size -= sum(c.nbytes for c in self.open.pop(old))
        return columns

    def score(self, documents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each document: tokens, known tokens, base score, log10 probability."""
        key, before, start = _stream(documents)
        word, own = np.unique(np.concatenate((key, before)), return_inverse=True)
        own, context = own[: len(key)], own[len(key) :]
        count, after, total, one, two, more = self.look_up("word", word, _spread(word >> _CUT, self.shards), 6)
        first, which = _distinct(before, key)
        high, low = pairs(before[first], key[first])
        (times,) = self.look_up("pair", high, _spread(high, self.shards), 1, low)
        n, v = self.train_tokens, self.vocabulary
        base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
        lower = self._lower(after)
        d = self.pair_discount
        some = np.maximum(total, 1)
        left = np.where(total > 0, (d[0] * one + d[1] * two + d[2] * more) / some, 1.0)
        seen = np.where(total[context] > 0, _less(times[which], d) / some[context], 0.0)
        p = seen + left[context] * lower[own]
        return (
            np.diff(np.append(start, len(key))),
            np.add.reduceat((count > 0)[own].astype(np.int64), start),
            np.add.reduceat(base[own], start),
            np.add.reduceat(np.log10(p), start),
        )

    def _lower(self, after: np.ndarray) -> np.ndarray:
        if not self.continuations:
            return np.full(len(after), 1 / (self.vocabulary + 1))
        rest = sum(d * k for d, k in zip(self.word_discount, self.kinds, strict=True)) / self.continuations
        return _less(after, self.word_discount) / self.continuations + rest / (self.vocabulary + 1)


def _less(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(count > 0, count - np.array((0, *d))[np.minimum(count, 3).astype(np.int64)], 0)


def train(spark: SparkSession, docs: DataFrame, folder: str | None = None, shard_bytes: int = 24 << 20, most: int = MOST) -> Model:
    """Counts every whole text of docs. shard_bytes: text for each shard. most: shards that a task deals to at once."""
    ready(spark)
    folder = folder or new_folder(spark, "lm")
    picked = docs.select("text")
    volume = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = int(max(4, -(-volume // shard_bytes)))
    ratio = -(-wanted // most)
    shards = -(-wanted // ratio) * ratio
    counted = picked.mapInArrow(lambda batches: _counted(batches, shards, ratio), _ROW)
    if ratio > 1:
        counted = counted.repartition("kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(lambda batches: _redealt(batches, shards, ratio), _ROW)
    merged = counted.groupBy("kind", "shard").applyInArrow(lambda t: pa.Table.from_batches([_merged(t, folder, shards, ratio > 1)]), _ROW)
    merged = saved(spark, merged, "lm-counts")
    words = merged.where("kind in ('word', 'context', 'after')").groupBy("shard").applyInArrow(lambda t: pa.Table.from_batches([_joined(t, folder)]), _ROW)
    each = words.select("shard", "tally").collect()  # a row for each shard
    if not each:
        return Model(folder, shards)
    pair_rows = merged.where("kind = 'tally'").select("shard", "tally").collect()
    n, v, after, three, *tally = (sum(x) for x in zip(*(r.tally for r in each), strict=True))
    pair_tally = [sum(x) for x in zip(*(r.tally for r in pair_rows), strict=True)]
    names = frozenset([*(f"pair-{r.shard}" for r in pair_rows), *(f"word-{r.shard}" for r in each)])
    return Model(folder, shards, n, v, after, (tally[0], tally[1], three), discounts(*pair_tally), discounts(*tally), names)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` (else doc_id), n_tokens, n_known, base_score and score (log10) for every row of docs."""
    ready(docs.sparkSession)
    keep = keep or ["doc_id"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            columns = model.score(raw(b))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*keep, "n_tokens", "n_known", "base_score", "score"])

    long = F.lit(0).cast("long")
    schema = docs.select(*keep).withColumns({"n_tokens": long, "n_known": long, "base_score": F.lit(0.0), "score": F.lit(0.0)}).schema
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(scored, schema)
