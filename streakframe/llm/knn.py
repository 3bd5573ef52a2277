"""Exact nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are dealt to blocks, and each pair of a query block and a candidate block is one tile. A tile gets the
vectors as their bytes, in blocks bounded by bytes. In a tile vectors are quantised to int8; the product of the int8 matrices
gives every distance within a bound that follows from the quantisation errors. A candidate whose lower bound is above the k-th smallest upper bound of a query can't be among its k
nearest; the others are recomputed in double precision. Heaps of size k merge the parts of a tile, and a limited window
merges the tiles. A tile's memory is bounded by the block sizes.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; a vector's candidates are those
of its dimension; ties go to the smaller id; equal vectors are candidates each; fewer than k candidates give all; an empty
table gives no rows; extra columns are ignored. Rows that repeat an id are candidates each (not of their own id), and one
query, that of the least vector. Where squares overflow nothing is ruled out by bounds, and such a distance is infinite.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streakframe.llm.common import ready


#: Bytes of vectors (doubles) in a block of queries and of candidates.
QUERY_BYTES, CANDIDATE_BYTES = 4 << 20, 16 << 20
_PART = 4_096


def usable(vectors: DataFrame, name: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, v): the rows that take part, components in the table's own precision."""
    v = F.col(name)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v")).where(fine & F.exists("v", lambda x: x != 0))


def matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def lengths_of(x: np.ndarray) -> np.ndarray:
    """The length of each row, without overflow unless the length itself is too large."""
    most = np.abs(x).max(axis=1, initial=0)
    most[most == 0] = 1
    return most * np.linalg.norm(x / most[:, None], axis=1)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and the length of what each row lost."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    scale[scale == 0] = 1
    code = np.rint(x / scale).astype(np.int8)
    return code, scale[:, 0], lengths_of(x - code * scale)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows. Sums of 512 products stay below 2^24, so that single precision holds them."""
    total = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 512):
        total += a[:, k : k + 512].astype(np.float32) @ b[:, k : k + 512].astype(np.float32).T
    return total


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k nearest in the tile as (distance, id), nearest first."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    with np.errstate(over="ignore", invalid="ignore"):
        q_code, q_scale, q_lost = quantised(queries)
        q_norm = lengths_of(queries)
        ids_order = np.argsort(ids, kind="stable")
        ids, candidates = ids[ids_order], candidates[ids_order]
        for start in range(0, len(ids), _PART):
            own, part = ids[start : start + _PART], candidates[start : start + _PART]
            code, scale, lost = quantised(part)
            norm = lengths_of(part)
            for first in range(0, len(queries), 256):
                s = slice(first, first + 256)
                dot = products(q_code[s], code) * q_scale[s, None] * scale
                square = q_norm[s, None] ** 2 + norm**2 - 2 * dot
                # |q.c - q'.c'| <= |q - q'| |c| + |q'| |c - c'|; the last term covers rounding
                error = 2 * (q_lost[s, None] * norm + (q_norm[s, None] + q_lost[s, None]) * lost) + 1e-12 * (q_norm[s, None] + norm) ** 2
                same = own[None, :] == query_ids[s, None]
                lower, upper = square - error, square + error
                lower[~np.isfinite(lower)] = -np.inf
                upper[same | np.isnan(upper)] = np.inf
                limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] >= k else np.full(len(upper), np.inf)
                for j in range(len(upper)):
                    heap = heaps[first + j]
                    bound = min(limit[j], (-heap[0][0]) ** 2 * (1 + 1e-12) if len(heap) >= k else np.inf)
                    kept = np.flatnonzero((lower[j] <= bound) & ~same[j])
                    # components are added in their order, as a plain loop would
                    distance = np.sqrt(((part[kept] - queries[first + j]) ** 2).cumsum(axis=1)[:, -1])
                    for d, i in zip(distance.tolist(), own[kept].tolist(), strict=True):
                        if len(heap) < k:
                            heappush(heap, (-d, -i))
                        else:
                            heappushpop(heap, (-d, -i))
    return [sorted((-d, -i) for d, i in heap) for heap in heaps]


def nearest(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 10, name: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by Euclidean distance; is_query is a condition on `id`."""
    ready(spark)
    rows = usable(vectors, name, key)
    n, m, dim = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("v"))).first()
    query_block, candidate_block = (max(1, size // (8 * (dim or 1))) for size in (QUERY_BYTES, CANDIDATE_BYTES))
    query_blocks = max(1, -(-m // query_block))
    # more, smaller candidate blocks where one block would leave machines idle
    blocks = max(1, -(-n // candidate_block), min(n // _PART, 4 * spark.sparkContext.defaultParallelism))
    c = F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(blocks))
    q = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(query_blocks))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    candidates = rows.select("id", "v", F.size("v").alias("d"), c.alias("c"), every(query_blocks).alias("q"))
    asked = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    queries = asked.select("id", "v", F.size("v").alias("d"), q.alias("q"), every(blocks).alias("c"))

    def tiled(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        ids = left.column("id").to_numpy()
        found = tile(ids, matrix(left), right.column("id").to_numpy(), matrix(right), k)
        count = [len(f) for f in found]
        flat = [x for f in found for x in f]
        return pa.table({"query_id": np.repeat(ids, count), "vec_id": pa.array([i for _, i in flat], pa.int64()), "score": pa.array([d for d, _ in flat], pa.float64())})

    parts = queries.groupBy("d", "q", "c").cogroup(candidates.groupBy("d", "q", "c")).applyInArrow(tiled, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
