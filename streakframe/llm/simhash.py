"""SimHash near-duplicates: an inverted index over positional bytes with count filtering.

A fingerprint has 64 bits, so 8 positional bytes. Two fingerprints at 4 or fewer differing bits share at least 4 of them,
so the index posts a fingerprint under every choice of 4 positions with their bytes (70 postings): exactly the pairs whose
tally of shared positional bytes reaches 4 meet in a posting list. There each pair is verified by its differing bits.
Equal fingerprints are one entry. A posting list gives a spanning forest of its links instead of all of them; a list too
long for one task is linked through the values halfway between two fingerprints, which takes work in proportion to it.
A text may have several fingerprints (lanes), each of other hashes of its features; texts link if any lane does.

Defined cases: null and blank texts have fingerprint zero and link like any other; a null id keeps its row and is never
a component's name unless all its members lack one; groups() returns repeated rows each, keep_one() one of those equal in id
and text; an id with several texts has a row, and in keep_one() a decision, for each text; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakframe.llm.common import bounded, fresh, raw, ready, row_key, saved
from streakframe.llm.components import components

SEED = 42
BITS = 4
CHOICES = list(combinations(range(8), 8 - BITS))
#: Longest posting list that one task links by comparing its members.
LIST = 20_000
_CHUNK = 1 << 20
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each run of `size` lower-cased words, repeats included; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: list[np.ndarray]) -> np.ndarray:
    """For each text's hashes the bits set in over half of them; zero for none."""
    out = np.zeros(len(hashes), np.uint64)
    count = np.array([len(h) for h in hashes], np.int64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    every, count = np.concatenate(hashes), count[some]
    first = np.cumsum(count) - count
    parts = -(-count // 255)
    part_first = np.cumsum(parts) - parts
    cut = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(part_first, parts))
    found = np.zeros(len(some), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((every >> np.uint64(bit)) & _LANES, cut)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), part_first, axis=0)
        for byte in range(8):
            found |= (2 * sums[:, byte] > count).astype(np.uint64) << np.uint64(8 * byte + bit)
    out[some] = found
    return out


def mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Other hashes of the same features for each lane; lane 0 has the hashes themselves."""
    if not lane:
        return hashes
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, size: int = 4, lanes: int = 1, distinct: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, and for each lane the 64 bits of its fingerprint as a long: fp, fp_1, and so on.

    distinct: a shingle that repeats counts once.
    """
    ready(docs.sparkSession)
    names = ["fp", *(f"fp_{k}" for k in range(1, lanes))]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            found = [shingle_hashes(t, size) for t in raw(b)]
            if distinct:
                found = [np.unique(h) for h in found]
            columns = [fingerprint([mixed(h, lane) for h in found]).view(np.int64) for lane in range(lanes)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *map(pa.array, columns)], [*keep, *names])

    schema = docs.select(*keep, *(F.lit(0).cast("long").alias(n) for n in names)).schema
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(marked, schema)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp, lane = b.column("fp").to_numpy(), b.column("lane").to_numpy().astype(np.int64)
        part = fp.view(np.uint8).reshape(-1, 8).astype(np.int64)
        for k, places in enumerate(CHOICES):
            key = lane * len(CHOICES) + k
            for place in places:
                key = key << 8 | part[:, place]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])


def _choice(key: np.ndarray) -> np.ndarray:
    """The lane and choice of places of a posting's key, as one number."""
    return key >> (8 * (8 - BITS))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; bitwise_count takes the absolute value of signed numbers, so it gets unsigned ones."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the members of one posting list."""
    a, b = [], []
    left = fp
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _apart(left, x) <= BITS
            found, left = left[near], left[~near]
            a.append(np.full(len(found), x))
            b.append(found)
            queue.extend(found)
    return np.concatenate([*a, fp[:0]]), np.concatenate([*b, fp[:0]])


def _linked(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links within whole posting lists, sorted by key, with their list's lane and choice."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((start, [len(key)])))
    own, a, b = [key[:0]], [fp[:0]], [fp[:0]]
    short = np.repeat((size > 1) & (size <= 16), size)
    k, f = key[short], fp[short]
    for apart in range(1, 16):
        same = np.flatnonzero(k[apart:] == k[:-apart])
        if not len(same):
            break
        near = same[_apart(f[same], f[same + apart]) <= BITS]
        own.append(k[near])
        a.append(f[near])
        b.append(f[near + apart])
    for s, n in zip(start[size > 16], size[size > 16], strict=True):
        x, y = _forest(fp[s : s + n])
        own.append(np.full(len(x), key[s]))
        a.append(x)
        b.append(y)
    return _choice(np.concatenate(own)), np.concatenate(a), np.concatenate(b)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by key: links (wide=false, choice, a, b), and the members a=b (wide=true) of lists too long."""

    def rows(wide: bool, choice: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), wide)), pa.array(choice), pa.array(a), pa.array(b)], ["wide", "choice", "a", "b"])

    key, fp, too_long = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def work(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal key, fp, too_long, held
        key, fp = np.concatenate([key, *(k for k, _ in held)]), np.concatenate([fp, *(f for _, f in held)])
        held = []
        if too_long is not None and len(key):
            n = int(np.searchsorted(key, too_long, side="right"))
            if n:
                yield rows(True, _choice(key[:n]), fp[:n], fp[:n])
            if n < len(key):
                too_long = None
            key, fp = key[n:], fp[n:]
        if not len(key):
            return
        done = len(key) if last else int(np.searchsorted(key, key[-1]))
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((start, [len(key)])))
        long = np.repeat(size > LIST, size)
        if long.any():
            yield rows(True, _choice(key[long]), fp[long], fp[long])
            if not last and long[-1]:
                too_long, done = key[-1], len(key)
        whole = ~long & (np.arange(len(key)) < done)
        if whole.any():
            choice, a, b = _linked(key[whole], fp[whole])
            if len(a):
                yield rows(False, choice, a, b)
        key, fp = key[done:], fp[done:]

    for batch in batches:
        held.append((batch.column("key").to_numpy(), batch.column("fp").to_numpy()))
        if sum(len(k) for k, _ in held) >= _CHUNK:
            yield from work(False)
    yield from work(True)


def _halfway(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For members of long lists every value within half of BITS flips of the bits that the list leaves open."""
    for batch in batches:
        choice, fp = batch.column("choice").to_numpy(), batch.column("a").to_numpy()
        for k in np.unique(choice):
            own, held = fp[choice == k], CHOICES[k % len(CHOICES)]
            free = [8 * place + bit for place in range(8) if place not in held for bit in range(8)]
            flips = [0]
            for n in range(1, BITS // 2 + 1):
                flips += [sum(1 << x for x in some) for some in combinations(free, n)]
            for flip in np.array(flips, np.uint64).view(np.int64):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k)), pa.array(own ^ flip), pa.array(own)], ["choice", "half", "fp"])


def links(spark: SparkSession, values: DataFrame) -> DataFrame:
    """Links (choice, a, b) that connect what is connected among the distinct fingerprints `fp` of each `lane` (0 without that column)."""
    ready(spark)
    known = values if "lane" in values.columns else values.withColumn("lane", F.lit(0))
    postings = known.select("lane", "fp").mapInArrow(_postings, "key long, fp long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = postings.repartition(parts, "key").sortWithinPartitions("key")
    found = saved(spark, dealt.mapInArrow(_verified, "wide boolean, choice long, a long, b long"), "links")
    near = found.where("not wide").select("choice", "a", "b")
    wide = found.where("wide")
    if not wide.isEmpty():
        half = wide.select("choice", "a").mapInArrow(_halfway, "choice long, half long, fp long")
        # at most 529 fingerprints lie within two flips of one value
        met = half.groupBy("choice", "half").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
        near = near.union(met.select("choice", F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b"))
    return near


def _node(fp: Column, lane: Column | int) -> Column:
    """One id for a fingerprint of a lane; that of lane 0 is the fingerprint."""
    salt = F.when(F.lit(lane) > 0, F.xxhash64(F.lit(lane).cast("long"))).otherwise(F.lit(0).cast("long"))
    return fp.bitwiseXOR(salt)


def groups(spark: SparkSession, docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest doc_id reachable over links."""
    marked = saved(spark, fingerprints(docs, size), "fingerprints")
    values = saved(spark, marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    roots = components(spark, links(spark, values.select("fp")))
    rooted = values.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = saved(spark, rooted.select("fp", "root", "least"), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least.hint("merge"), "root").select("fp", "component_id")
    return marked.join(named.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, size: int = 1, lanes: int = 3) -> DataFrame:
    """One document of each group of texts that link in any lane; rows equal in id and text are one document.

    Of a group the smallest id stays, one without id only where all lack one; of several texts of that id the one of the least
    hash. Features are the distinct shingles of a text. The default, words, is what 64 bits can tell near copies by: of texts
    that share 0.8 of their 5-word shingles, three in four differ in 4 or fewer bits, against one in six for 5-word features.
    """
    own = [fresh(n, docs.columns) for n in ("_key", "_key_2")]
    keyed = docs.withColumns(dict(zip(own, row_key(), strict=True)))
    prints = fingerprints(keyed.select("doc_id", "text", *own), size, lanes, True, ("doc_id", *own))
    marked = saved(spark, prints.withColumnsRenamed(dict(zip(own, ("k", "k_2"), strict=True))), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "k_2")
    values = saved(spark, marked.groupBy(*(c for c in marked.columns if c.startswith("fp"))).agg(F.min(first).alias("first")), "values")
    by_lane = [values.select(F.lit(k).alias("lane"), F.col(f"fp_{k}" if k else "fp").alias("fp")).distinct() for k in range(lanes)]
    found = links(spark, functools.reduce(DataFrame.union, by_lane))
    lane = F.floor(F.col("choice") / len(CHOICES))
    edges = found.select(_node(F.col("a"), lane).alias("a"), _node(F.col("b"), lane).alias("b"))
    for k in range(1, lanes):
        edges = edges.union(values.select("fp", _node(F.col(f"fp_{k}"), k)))
    roots = components(spark, edges)
    rooted = values.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    stay = rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("f")).select(F.col("f.k").alias(own[0]), F.col("f.k_2").alias(own[1]))
    return keyed.dropDuplicates(own).join(stay.hint("merge"), own, "left_semi").select(docs.columns)
