"""Thick lines as pixels: each segment becomes the pixels of its bounding box, a kernel of their distance, and a combination.

segments: (frame, x_0, y_0, x_1, y_1, width) with any further columns; z_0 and z_1 too in three dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streakframe.functions.stages import staged
from streakframe.kernels import raster as numeric
from streakframe.session import ship

KERNELS = ("rectangular", "gaussian", "triangular", "parabolic", "biweight")


def kernel(name: str, x: Column) -> Column:
    """x: distance over width, 0 to 1."""
    if name not in KERNELS:
        raise ValueError(f"kernel can't be {name}")
    return {
        "rectangular": F.lit(1.0),
        "gaussian": F.exp(-0.5 * F.pow(3 * x, 2)) / math.sqrt(2 * math.pi),
        "triangular": 1 - x,
        "parabolic": 0.75 * (1 - x * x),
        "biweight": 15 / 16 * F.pow(1 - x * x, 2),
    }[name]


def footprint(segments: DataFrame, shape: tuple[int, ...], max_val: float = 1.0, kernel_name: str = "rectangular") -> DataFrame:
    """All columns of segments with (module,) ss, fs and value for each pixel within width of it, border included.

    shape: (n_ss, n_fs), or (n_z, n_ss, n_fs) for segments with z. A width of 0 or less draws nothing.
    """
    axes = ("z", "y", "x")[3 - len(shape) :]
    names = {"z": "z", "y": "ss", "x": "fs"}
    spans = {}
    out = segments.where(F.col("width") > 0)
    for axis, n in zip(axes, shape, strict=True):
        a, b, w = F.col(f"{axis}_0"), F.col(f"{axis}_1"), F.col("width")
        low = F.greatest(F.ceil(F.least(a, b) - w), F.lit(0)).cast("int")
        high = F.least(F.floor(F.greatest(a, b) + w), F.lit(n - 1)).cast("int")
        spans[names[axis]] = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    for name, span in spans.items():
        out = out.withColumn(name, F.explode(span))
    along = {a: F.col(f"{a}_1") - F.col(f"{a}_0") for a in axes}
    away = {a: F.col(names[a]).cast("double") - F.col(f"{a}_0") for a in axes}
    square = sum((along[a] * along[a] for a in axes[1:]), along[axes[0]] * along[axes[0]])
    dot = sum((along[a] * away[a] for a in axes[1:]), along[axes[0]] * away[axes[0]])
    out = staged(out, _t=F.least(F.greatest(F.when(square > 0, dot / square).otherwise(0.0), F.lit(0.0)), F.lit(1.0)))
    gaps = [F.pow(away[a] - F.col("_t") * along[a], 2) for a in axes]
    ratio = F.sqrt(sum(gaps[1:], gaps[0])) / F.col("width")
    return staged(out, _x=ratio).where(F.col("_x") <= 1).withColumn("value", max_val * kernel(kernel_name, F.col("_x"))).drop("_x", "_t")


def _pixel(shape: tuple[int, ...]) -> list[str]:
    return [*(["z"] if len(shape) == 3 else []), "ss", "fs"]


def _runs(columns: list[pa.Array], before: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it. before: the row before the first, or nothing."""
    new = np.zeros(len(columns[0]), bool)
    new[0] = not before
    for k, c in enumerate(columns):
        c = pa.concat_arrays([before[k], c]) if before else c
        there = c.is_valid().to_numpy(zero_copy_only=False)
        value = c.drop_null().to_numpy(zero_copy_only=False)
        filled = np.zeros(len(c), value.dtype)
        filled[there] = value
        new[0 if before else 1 :] |= (filled[1:] != filled[:-1]) | (there[1:] != there[:-1])
    return new


def _drawn(segments: DataFrame, shape: tuple[int, ...], max_val: float, kernel_name: str, keys: dict[str, str], gathered: bool = False) -> DataFrame:
    """(frame, [z,] ss, fs, value). keys: how pixels of one key overlap, the innermost key last; frame is the first.

    Segments are shuffled, not their pixels: a frame's come together, sorted by the keys, and are drawn in passing. A worker
    holds one frame's touched pixels and a bounded number of others. gathered: they come so already.
    """
    if kernel_name not in KERNELS:
        raise ValueError(f"kernel can't be {kernel_name}")
    for how in keys.values():
        if how not in ("sum", "max"):
            raise ValueError(f"lines can't overlap by {how}")
    ship(segments.sparkSession)
    axes, names, size = ("z", "y", "x")[3 - len(shape) :], list(keys), math.prod(shape)
    numbers = [*(f"{a}_0" for a in axes), *(f"{a}_1" for a in axes), "width"]
    rows = segments.select(*names, *(F.col(c).cast("double").alias(c) for c in numbers))
    if not gathered:
        rows = rows.where(F.col("width") > 0).repartition("frame").sortWithinPartitions(*names)
    frame = segments.schema["frame"].dataType.simpleString()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outer, inner = numeric.Overlap(keys["frame"], size), numeric.Overlap(keys[names[-1]], size)
        before: list[pa.Array] = []
        labels, first = None, 0  # the frames from the number `first` on
        owner, low = np.zeros(0, int), 0  # the frame's number of each run of keys from `low` on

        def rows_of(group: np.ndarray, pixel: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(group):
                at = np.unravel_index(pixel, shape)
                columns = [labels.take(pa.array(group - first)), *(pa.array(x.astype(np.int32)) for x in at), pa.array(value)]
                yield pa.RecordBatch.from_arrays(columns, ["frame", *_pixel(shape), "value"])

        def passed(group: np.ndarray, pixel: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return outer.add(owner[group - low], pixel, value) if len(names) > 1 else (group, pixel, value)

        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(c) for c in names]
            new = _runs(columns, before)
            new_frame = _runs(columns[:1], before[:1])
            before = [c.slice(len(c) - 1) for c in columns]
            frames = np.cumsum(new_frame) - 1 + (first + len(labels) if labels is not None else 0)
            runs = np.cumsum(new) - 1 + low + len(owner)
            fresh = columns[0].filter(pa.array(new_frame))
            labels = fresh if labels is None else pa.concat_arrays([labels, fresh])
            owner = np.concatenate([owner, frames[new]])
            ends = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in numbers])
            n = len(axes)
            for of, pixel, x in numeric.touched(ends[:n], ends[n : 2 * n], ends[-1], shape):
                value = max_val * numeric.KERNELS[kernel_name](x)
                yield from rows_of(*passed(*inner.add(runs[of], pixel, value)))
            # what neither keeps is forgotten
            keep = int(runs[-1]) if inner.group is None else inner.group
            owner, low = owner[keep - low :], keep
            keep = min(int(owner[0]), int(owner[0]) if len(names) == 1 or outer.group is None else outer.group)
            labels, first = labels.slice(keep - first), keep
        if labels is not None:
            yield from rows_of(*passed(*inner.rest()))
            if len(names) > 1:
                yield from rows_of(*outer.rest())

    return rows.mapInArrow(draw, f"frame {frame}, {', '.join(f'{c} int' for c in _pixel(shape))}, value double")


def draw_lines(segments: DataFrame, shape: tuple[int, ...], max_val: float = 1.0, kernel_name: str = "rectangular", overlap: str = "sum") -> DataFrame:
    """(frame, [z,] ss, fs, value) of all pixels that a segment of the frame touches."""
    return _drawn(segments, shape, max_val, kernel_name, {"frame": overlap})


def accumulate_lines(segments: DataFrame, shape: tuple[int, ...], max_val: float = 1.0, kernel_name: str = "rectangular", in_overlap: str = "max", out_overlap: str = "sum", gathered: bool = False) -> DataFrame:
    """As draw_lines for segments with a column term: those of one term are combined first, then the terms of a frame.

    gathered: the segments of a frame come together, and within it those of a term.
    """
    return _drawn(segments, shape, max_val, kernel_name, {"frame": out_overlap, "term": in_overlap}, gathered)


def onto(image: DataFrame, drawn: DataFrame, shape: tuple[int, ...], overlap: str = "sum") -> DataFrame:
    """An image with what was drawn added, or the larger of the two."""
    at = ["frame", *_pixel(shape)]
    joined = image.join(drawn.withColumnRenamed("value", "_v"), at, "left")
    new = F.col("value") + F.coalesce("_v", F.lit(0.0)) if overlap == "sum" else F.greatest("value", "_v")
    return joined.withColumn("value", new).drop("_v")


def pattern_image(streaks: DataFrame, shape: tuple[int, int], width: float, num_modules: int = 1, kernel_name: str = "rectangular") -> DataFrame:
    """Streaks as images; the frame is num_modules * index + module_id."""
    frame = F.col("index") * num_modules + (F.col("module_id") if "module_id" in streaks.columns else F.lit(0))
    segments = streaks.select(frame.alias("frame"), "x_0", "y_0", "x_1", "y_1", F.lit(float(width)).alias("width"))
    return draw_lines(segments, shape, 1.0, kernel_name, "max")
