"""Best-fit packing by patterns: non-negative least squares over a histogram of lengths.

Texts become pieces of at most `size` tokens; a histogram counts pieces of each length. Patterns are the ways to fill a
sequence exactly with two or three pieces; their repeat counts are fitted to the histogram by non-negative least squares
over a set of patterns that grows by those which would lower the gap most, rounded and taken while pieces last, and what is left is packed by best fit, longest first, over counts of equal pieces.
All of this works on counts, so its cost depends on `size` alone. Pieces then get their place: the rank of a piece among
those of its length is found in buckets (no task sees all pieces of a length), and a table of ranges says which sequence
and offset a rank has. That table's size is bounded by the number of patterns, whatever the number of documents.

Defined cases: a null text is empty and has just the end id; equal documents are packed each; null ids are kept; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streakframe.llm.common import bounded, ready, saved
from streakframe.llm.tokens import encoder

SIZE = 2048


def pieces(docs: DataFrame, tokenizer: str, end: int, size: int = SIZE, share: float = 1.0) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32); row tells apart documents of one id. Only the first piece is short.

    share: of the bounds of the encoder's look-up tables; less is slower and takes less memory of a worker.
    """
    ready(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, share)
        for b in bounded(batches):
            owner, number, start, length, crc = [], [], [], [], []
            for k, own in enumerate(encode.ids(b.column("text"))):
                ids = np.append(own, np.uint32(end)).astype("<u4")
                first = len(ids) % size or size
                for j, at in enumerate([0, *range(first, len(ids), size)]):
                    part = ids[at : first if at == 0 else at + size]
                    owner.append(k)
                    number.append(j)
                    start.append(at)
                    length.append(len(part))
                    crc.append(crc32(part.tobytes()))
            columns = [b.column("doc_id").take(pa.array(owner, pa.int64())), b.column("row").take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    picked = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    long = F.lit(0).cast("long")
    schema = picked.select("doc_id", "row", F.lit(0).alias("piece"), long.alias("start"), long.alias("length"), long.alias("ids_crc32")).schema
    return picked.mapInArrow(cut, schema)


def first_patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Ways to fill `size` to begin with: alone, in pairs, and each length with two others as near to equal as there are."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    one = np.array([(size, 0, 0)] if there[size] else [], np.int64).reshape(-1, 3)
    a = lengths[(lengths >= size / 2) & (lengths < size)]
    two = a[there[size - a]]
    found = []
    for a in lengths[(lengths >= size / 3) & (lengths < size)].tolist():
        c = np.arange(max(1, size - 2 * a), (size - a) // 2 + 1)
        c = c[there[c] & there[size - a - c]]
        if len(c):
            found.append((a, size - a - c[-1], c[-1]))
    return np.concatenate([one, np.stack([two, size - two, 0 * two], axis=1), np.array(found, np.int64).reshape(-1, 3)])


def priced(lengths: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """For each length as the largest part the exact pattern of two or three whose parts are wanted most, if they are at all.

    pull[l]: how much a further piece of length l would lower the squared gap; -inf for lengths that aren't there. The work for a
    length and the memory are linear in the size.
    """
    size = len(pull) - 1
    found = []
    for a in lengths[(lengths >= size / 3) & (lengths < size)].tolist():
        rest = size - a
        c = np.arange(max(0, rest - a), rest // 2 + 1)
        gain = np.where(c > 0, pull[c], 0) + pull[rest - c]
        k = int(gain.argmax())
        if gain[k] + pull[a] > 0:
            found.append((a, rest - int(c[k]), int(c[k])))
    return np.array(found, np.int64).reshape(-1, 3)


def fit(histogram: np.ndarray, lengths: np.ndarray, rounds: int = 12, steps: int = 40, last: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and their repeat counts x >= 0 that minimise the squared gap to the histogram, by column generation.

    Each round solves the least squares over the patterns so far by accelerated projection and adds for each length the pattern
    that would lower the gap most, so that neither time nor memory ever takes all patterns. A gap at a short length weighs less:
    what is left of short pieces fills holes elsewhere.
    """
    size = len(histogram) - 1
    weight = 0.1 + np.arange(size + 1) / size
    total = histogram.sum()
    want = histogram / max(1, total)
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    table = first_patterns(lengths, size)
    x = np.zeros(len(table))

    def filled(x: np.ndarray) -> np.ndarray:
        out = np.bincount(table.ravel(), np.repeat(x, 3), size + 1)
        out[0] = 0
        return out

    for k in range(rounds + 1):
        used = table > 0
        # separable bound on the curvature: for each length, how many patterns share it
        bound = weight * filled(np.ones(len(table)))
        step = 1 / np.maximum((bound[table] * used).sum(axis=1), 1e-9)
        momentum, t = x, 1.0
        for _ in range(steps if k < rounds else last):
            gap = weight * (filled(momentum) - want)
            gap[0] = 0
            new = np.maximum(0, momentum - step * gap[table].sum(axis=1))
            t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
            momentum, x, t = new + (t - 1) / t_next * (new - x), new, t_next
        if k == rounds:
            break
        pull = np.where(there, weight * (want - filled(x)), -np.inf)
        more = priced(lengths, pull)
        live = x > 0
        live[: len(live)] |= k < 1
        table, x = np.concatenate([table[live], more]), np.concatenate([x[live], np.zeros(len(more))])
        table, first = np.unique(table, axis=0, return_index=True)
        x = x[first]
    return table, x * total


@dataclass(frozen=True)
class Plan:
    """Where pieces go: those of length[k] with rank in [first[k], first[k] + count[k]) to sequences from sequence[k] on, `each` of them in a sequence, at offset[k] and after."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    each: np.ndarray
    sequences: int


def plan(histogram: np.ndarray) -> Plan:
    """histogram[l]: how many pieces have length l (0 to size)."""
    size, left, taken = len(histogram) - 1, histogram.astype(np.int64).copy(), np.zeros(len(histogram), np.int64)
    ranges: list[tuple[int, int, int, int, int]] = []
    made = 0

    def take(length: int, sequences: int, at: int, offset: int, each: int) -> None:
        ranges.append((length, int(taken[length]), at, offset, each))
        taken[length] += sequences * each
        left[length] -= sequences * each

    lengths = np.flatnonzero(left[1:]) + 1
    table, repeats = fit(left, lengths) if len(lengths) else (np.zeros((0, 3), np.int64), np.zeros(0))
    for k in np.argsort(-repeats, kind="stable"):
        parts, counts = np.unique(table[k][table[k] > 0], return_counts=True)
        n = min(int(np.ceil(repeats[k])), int((left[parts] // counts).min()))
        if n <= 0:
            continue
        offset = 0
        for length, each in zip(parts[::-1].tolist(), counts[::-1].tolist(), strict=True):
            take(length, n, made, offset, each)
            offset += length * each
        made += n
    # best fit, longest first; open sequences with equal room are one entry: room -> [(first sequence, how many)]
    rooms: dict[int, list[tuple[int, int]]] = {}
    room_count = np.zeros(size + 1, np.int64)
    for length in range(size, 0, -1):
        while left[length]:
            fits = np.flatnonzero(room_count[length:])
            if len(fits):
                room = int(fits[0]) + length
                at, many = rooms[room].pop()
                room_count[room] -= many
                each = min(room // length, max(1, int(left[length]) // many))
                n = min(many, int(left[length]) // each)
                if n < many:
                    rooms[room].append((at + n, many - n))
                    room_count[room] += many - n
                take(length, n, at, size - room, each)
            else:
                each = max(1, min(size // length, int(left[length])))
                n, at, room = int(left[length]) // each, made, size
                take(length, n, at, 0, each)
                made += n
            room -= length * each
            if room:
                rooms.setdefault(room, []).append((at, n))
                room_count[room] += n
    order = sorted(ranges)
    columns = np.array(order, np.int64).reshape(-1, 5).T
    length, offset, each = (columns[k].astype(np.int32) for k in (0, 3, 4))
    return Plan(length, columns[1], columns[2], offset, each, made)


def pack(spark: SparkSession, cut: DataFrame, size: int = SIZE, bucket_rows: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (any table with `length` from 1 to size)."""
    rows = saved(spark, cut, "pieces")
    counts = rows.groupBy("length").count().collect()  # at most `size` rows
    histogram = np.zeros(size + 1, np.int64)
    for length, n in counts:
        histogram[length] = n
    if not histogram.sum():
        return rows.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    made = plan(histogram)
    buckets = max(8, int(histogram.sum()) // bucket_rows)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)))
    # how many pieces of the same length earlier buckets hold
    each = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = each.select("length", "_bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("row", "piece")) - 1)
    placed = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    names = [c for c in rows.columns]
    shift = np.int64(1) << 44
    keys = made.length * shift + made.first  # ranks stay below the shift

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            k = np.searchsorted(keys, length * shift + rank, side="right") - 1
            nth, slot = np.divmod(rank - made.first[k], made.each[k])
            columns = [*(b.column(c) for c in names), pa.array(made.sequence[k] + nth), pa.array(made.offset[k] + slot * length)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    schema = rows.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return placed.select(*names, "_rank").mapInArrow(place, schema)
