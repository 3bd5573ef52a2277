"""Connected components of a graph given as a table of edges, by alternating stars. Nothing is collected.

Edges first shrink to spanning forests of the tasks that hold them. Each round is then one job: it writes its edges to the
shared folder, where a lost executor costs one round at most, and counts and sums them on the way. Both sides of its joins
grow with the data, so none is ever broadcast; a hub's edges are split by Spark's skewed joins. Rounds grow with the
logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from streakframe.llm.common import drop_folder, new_folder, ready

#: Edges of one file of a round, about; and edges that a task joins to a forest at once.
FILE_EDGES, CHUNK_EDGES = 500_000, 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def joined() -> pa.RecordBatch:
        node, root = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        if sum(len(a) for a, _ in held) >= CHUNK_EDGES:
            yield joined()
    if held:
        yield joined()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b), both longs; root is the smallest node reachable.

    Self-loops and repeated edges are allowed, and null ends are left out; a node whose only edge is a loop has no row, and a
    table without edges gives none.
    """
    ready(spark)
    pairs, before, path = _round(spark, edges.where("a <> b").select("a", "b").mapInArrow(_forests, "a long, b long").distinct(), None)
    while before[0]:
        following, after, written = _round(spark, _small_star(_large_star(pairs)), before[0])
        drop_folder(spark, path)
        pairs, path = following, written
        if after == before:
            break
        before = after
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b").distinct())


def _round(spark: SparkSession, pairs: DataFrame, expected: int | None) -> tuple[DataFrame, tuple, str]:
    """Writes the edges and reads them back; also a count and an order-free sum, which two equal sets of edges share."""
    seen, path = Observation(), new_folder(spark, "edges")
    if expected is not None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        pairs = pairs.coalesce(max(1, min(parts, -(-expected // FILE_EDGES))))
    part = F.xxhash64("a", "b").cast("decimal(38,0)")
    pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(part).alias("sum")).write.parquet(path)
    return spark.read.schema("a long, b long").parquet(path), (seen.get["n"], seen.get["sum"]), path


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each node's larger neighbours, tied to the least of its neighbours and itself. May repeat edges."""
    both = pairs.union(pairs.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself, tied to the least of them."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    moved = pairs.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", "m")).distinct()
