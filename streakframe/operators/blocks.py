"""Operators on the block layout: a row for each frame and module with its pixels in one array.

Pixels stay in arrays from the scan to the kernels: metadata are arrays too, a row for each module, and meet the frames by
module without a shuffle. Only where a frame has several modules do its arrays come together, once, by frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streakframe.kernels import stats as kernel
from streakframe.schema import PIXEL
from streakframe.session import ship

#: Most pixels of a detector whose metadata are broadcast, 17 bytes each and 8 more for each field.
MOST = 1 << 25


def meta_blocks(meta: DataFrame, *values: str) -> DataFrame:
    """(module, arrays): columns of a table with a row for each pixel, as arrays in row-major order."""
    values = values or ("flatfield", "std", "mask")
    rows = meta.groupBy("module").agg(F.sort_array(F.collect_list(F.struct("ss", "fs", *values))).alias("p"))
    return rows.select("module", *(F.col(f"p.{c}").alias(c) for c in values))


def field_blocks(fields: DataFrame, good: tuple[int, ...]) -> DataFrame:
    """(module, w): for each module the values of each of the fields (comp, module, ss, fs, value) that `good` names, in its order."""
    each = [F.max(F.when(F.col("comp") == c, F.col("value"))).cast("double").alias(f"w{k}") for k, c in enumerate(good)]
    names = [f"w{k}" for k in range(len(good))]
    return meta_blocks(fields.where(F.col("comp").isin(list(good))).groupBy(*PIXEL).agg(*each), *names).select("module", F.array(*names).alias("w"))


def side(table: DataFrame, column: str) -> DataFrame:
    """A table of arrays by module for a broadcast join while the detector is small enough; Spark deals both sides beyond."""
    total = table.agg(F.sum(F.size(column))).first()[0] or 0
    return F.broadcast(table) if total <= MOST else table


def _noise(s: Column, std_min: float) -> Column:
    return F.greatest(s, F.lit(float(std_min)))


def snr(blocks: DataFrame, meta: DataFrame, std_min: float = 0.0) -> DataFrame:
    """(frame, module, n_ss, n_fs, pixels): (value * mask - flatfield) / max(std, std_min), 0 where that divisor is 0.

    meta: of meta_blocks. With columns coef and w the frame's background is the flatfield and the fields times coef.
    """
    joined = blocks.join(meta, "module")
    base = F.col("flatfield")
    if "coef" in joined.columns:
        fields = F.zip_with("coef", "w", lambda c, w: F.transform(w, lambda x: c * x))
        base = F.aggregate(fields, F.col("flatfield"), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
        joined = joined.withColumn("_base", base)
        base = F.col("_base")
    return joined.select("frame", "module", "n_ss", "n_fs", signal(F.col("pixels"), base, F.col("std"), F.col("mask"), std_min).alias("pixels"))


def signal(pixels: Column, base: Column, std: Column, mask: Column, std_min: float) -> Column:
    """The signal-to-noise of one module's arrays."""
    parts = F.arrays_zip(pixels.alias("v"), base.alias("b"), std.alias("s"), mask.alias("m"))
    return F.transform(parts, lambda p: F.when(_noise(p["s"], std_min) > 0, (F.nanvl(p["v"].cast("double"), F.lit(0.0)) * p["m"].cast("double") - p["b"]) / _noise(p["s"], std_min)).otherwise(0.0))


def snr_of_frames(frames: DataFrame, meta: DataFrame, std_min: float = 0.0) -> DataFrame:
    """(frame, modules) as signal-to-noise, for whole frames (frame, modules); no state and no shuffle, so that it works on a stream."""
    entry = F.struct("module", F.struct(*(F.col(c).alias(c) for c in ("flatfield", "std", "mask"))))
    known = meta.agg(F.map_from_entries(F.collect_list(entry)).alias("_meta"))  # one row
    own = lambda m: F.col("_meta")[m["module"]]
    value = lambda m: signal(m["pixels"], own(m)["flatfield"], own(m)["std"], own(m)["mask"], std_min)
    modules = F.transform("modules", lambda m: F.struct(m["module"].alias("module"), m["n_ss"].alias("n_ss"), m["n_fs"].alias("n_fs"), value(m).alias("pixels")))
    return frames.crossJoin(F.broadcast(known)).select("frame", modules.alias("modules"))


def gathered(blocks: DataFrame, modules: int | None = None) -> DataFrame:
    """(frame, modules): a frame's modules in order. Frames of one module stay where they are."""
    one = F.struct("module", "n_ss", "n_fs", "pixels")
    if modules == 1:
        return blocks.select("frame", F.array(one).alias("modules"))
    return blocks.groupBy("frame").agg(F.sort_array(F.collect_list(one)).alias("modules"))


def images(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(frame, module numbers, image) of each row of gathered(); the image (modules, n_ss, n_fs) is read from the batch's own memory."""
    lists = batch.column("modules")
    module, height, width = (lists.values.field(c).to_numpy() for c in ("module", "n_ss", "n_fs"))
    pixels = lists.values.field("pixels")
    at, flat = pixels.offsets.to_numpy(), pixels.values.to_numpy(zero_copy_only=False)
    for frame, start, stop in zip(batch.column("frame").to_pylist(), lists.offsets.to_numpy(), lists.offsets.to_numpy()[1:], strict=False):
        yield frame, module[start:stop], np.stack([flat[at[k] : at[k + 1]].reshape(height[k], width[k]) for k in range(start, stop)])


def rest(blocks: DataFrame, meta: DataFrame) -> DataFrame:
    """Frames less the flatfield."""
    joined = blocks.join(meta.select("module", "flatfield"), "module")
    pixels = F.zip_with("pixels", "flatfield", lambda x, b: F.nanvl(x.cast("double"), F.lit(0.0)) - b)
    return joined.select("frame", "module", "n_ss", "n_fs", pixels.alias("pixels"))


def lsq(blocks: DataFrame, fields: DataFrame) -> DataFrame:
    """(frame, coef): for each field sum(v w) / sum(w w) over the frame, 0 where that is 0 / 0. Modules sum up on their own first."""
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    part = F.transform("w", lambda w: F.struct(product(F.col("pixels"), w).alias("a"), product(w, w).alias("b")))
    each = blocks.join(fields, "module").select("frame", F.posexplode(part).alias("k", "p"))
    sums = each.groupBy("frame", "k").agg(F.sum("p.a").alias("a"), F.sum("p.b").alias("b"))
    coef = F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0)
    return sums.groupBy("frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", coef.alias("c")))), lambda x: x["c"]).alias("coef"))


def robust_lsq(blocks: DataFrame, fields: DataFrame, r0: float, r1: float, n_iter: int, lm: float) -> DataFrame:
    """(frame, coef) without outlying pixels; a frame's modules and their fields come together as arrays."""
    ship(blocks.sparkSession)
    rows = blocks.join(fields, "module").groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("module", "pixels", F.flatten("w").alias("w")))).alias("m"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, out = b.column("m"), []
            pixels, w = (lists.values.field(c) for c in ("pixels", "w"))
            at, own = pixels.offsets.to_numpy(), w.offsets.to_numpy()
            flat, every = (x.values.to_numpy(zero_copy_only=False) for x in (pixels, w))
            for start, stop in zip(lists.offsets.to_numpy(), lists.offsets.to_numpy()[1:], strict=False):
                value = flat[at[start] : at[stop]]
                features = np.concatenate([every[own[k] : own[k + 1]].reshape(-1, at[k + 1] - at[k]) for k in range(start, stop)], axis=1)
                out.append(kernel.robust_lsq(features, value[None], r0, r1, n_iter, lm)[0].tolist())
            yield pa.RecordBatch.from_arrays([b.column("frame"), pa.array(out, pa.list_(pa.float64()))], ["frame", "coef"])

    return rows.mapInArrow(fitted, "frame long, coef array<double>")
