"""Pixel-wise operators on the long layout: masks, regions of interest, signal-to-noise images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streakframe.schema import PIXEL


def inside(roi: tuple[int, int, int, int]) -> Column:
    """roi: ss from, ss to, fs from, fs to; the ends are outside."""
    y0, y1, x0, x1 = roi
    return (F.col("ss") >= y0) & (F.col("ss") < y1) & (F.col("fs") >= x0) & (F.col("fs") < x1)


def crop(pixels: DataFrame, roi: tuple[int, int, int, int]) -> DataFrame:
    return pixels.where(inside(roi))


def select_frames(pixels: DataFrame, frames: list[int]) -> DataFrame:
    return pixels.where(F.col("frame").isin(frames))


def apply_mask(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """Values of bad pixels become 0."""
    return pixels.join(meta.select(*PIXEL, "mask"), list(PIXEL)).withColumn("value", F.col("value") * F.col("mask").cast("double")).drop("mask")


def import_mask(meta: DataFrame, new: DataFrame, update: str = "reset") -> DataFrame:
    """new: (module, ss, fs, mask). reset puts it in place of the old mask, multiply keeps what both call good."""
    if update not in ("reset", "multiply"):
        raise ValueError(f"update can't be {update}")
    both = meta.join(new.select(*PIXEL, F.col("mask").alias("_new")), list(PIXEL), "left")
    fresh = F.coalesce("_new", F.lit(True))
    return both.withColumn("mask", F.col("mask") & fresh if update == "multiply" else fresh).drop("_new")


def mask_region(meta: DataFrame, roi: tuple[int, int, int, int]) -> DataFrame:
    """Pixels in the region become bad."""
    return meta.withColumn("mask", F.col("mask") & ~inside(roi))


def reset_mask(meta: DataFrame) -> DataFrame:
    return meta.withColumn("mask", F.lit(True))


def update_mask(pixels: DataFrame, meta: DataFrame, method: str, vmin: float = 0.0, vmax: float = 65535.0, snr_max: float = 3.0, std_min: float = 0.0, std_max: float = 0.0, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The mask AND what the data say, inside the region of interest.

    all-bad, no-bad; range: all frames have vmin <= value < vmax; snr: the mean of |value| is under snr_max (values are an
    SNR image); std: the pixel's std is over std_min and under std_max, each bound where it is over 0.
    """
    here = inside(roi) if roi else F.lit(True)
    if method in ("all-bad", "no-bad"):
        good: Column = F.lit(method == "no-bad")
        return meta.withColumn("mask", F.col("mask") & (good | ~here))
    if method == "std":
        good = (F.col("std") > std_min if std_min > 0 else F.lit(True)) & (F.col("std") < std_max if std_max > 0 else F.lit(True))
        return meta.withColumn("mask", F.col("mask") & (good | ~here))
    tests = {"range": F.bool_and((F.col("value") >= vmin) & (F.col("value") < vmax)), "snr": F.avg(F.abs("value")) < snr_max}
    if method not in tests:
        raise ValueError(f"method can't be {method}")
    found = pixels.where(here).groupBy(*PIXEL).agg(tests[method].alias("_good"))
    return meta.join(found, list(PIXEL), "left").withColumn("mask", F.col("mask") & F.coalesce("_good", F.lit(True))).drop("_good")


def clip(pixels: DataFrame, vmin: float, vmax: float) -> DataFrame:
    return pixels.withColumn("value", F.least(F.greatest("value", F.lit(vmin)), F.lit(vmax)))


def import_data(whitefields: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Masked whitefields, and the metadata with masked std and a flatfield: the mean whitefield where there is none."""
    masked = whitefields.join(meta.select(*PIXEL, "mask"), list(PIXEL)).withColumn("value", F.col("value") * F.col("mask").cast("double")).drop("mask")
    mean = masked.groupBy(*PIXEL).agg(F.avg("value").alias("_mean"))
    full = meta.withColumn("std", F.col("std") * F.col("mask").cast("double")).join(mean, list(PIXEL), "left")
    return masked, full.withColumn("flatfield", F.coalesce("flatfield", "_mean")).drop("_mean")


def snr(pixels: DataFrame, meta: DataFrame, std_min: float = 0.0, whitefield: str = "flatfield") -> DataFrame:
    """(value * mask - whitefield) / max(std, std_min), 0 where that divisor is 0.

    meta: a row for each pixel; or for each frame and pixel, if it has a column frame.
    """
    keys = [*(["frame"] if "frame" in meta.columns else []), *PIXEL]
    joined = pixels.join(meta.select(*keys, "mask", "std", whitefield), keys)
    noise = F.greatest("std", F.lit(float(std_min)))
    signal = F.col("value") * F.col("mask").cast("double") - F.col(whitefield)
    return joined.select("frame", *PIXEL, F.when(noise > 0, signal / noise).otherwise(0.0).alias("value"))


def frame_shape(pixels: DataFrame) -> DataFrame:
    """One row of extents: num_frames, num_modules, n_ss, n_fs."""
    return pixels.agg(F.count_distinct("frame").alias("num_frames"), F.count_distinct("module").alias("num_modules"), (F.max("ss") + 1).alias("n_ss"), (F.max("fs") + 1).alias("n_fs"))
