"""Regions of images: labelling and dilation, moments as aggregates, fits as expressions on them.

region_pixels: (frame, region, module, ss, fs, value). Labelling needs a whole frame at once, so it runs in Arrow batches of
frames in the block layout; everything measured afterwards is an aggregate or an expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streakframe.kernels import regions as kernel
from streakframe.kernels import streaks as streak_kernel
from streakframe.kernels.structure import Structure
from streakframe.operators.blocks import gathered, images
from streakframe.session import ship

REGION = ("frame", "region")


def shifts_of(df: DataFrame, structure: Structure, centre: bool = True) -> DataFrame:
    """(dm, dss, dfs): the structure as a table, a few dozen rows."""
    rows = [(0,) * (3 - structure.rank) + d for d in (structure.shifts if centre else structure.neighbours)]
    return df.sparkSession.createDataFrame(rows, "dm int, dss int, dfs int")


def neighbours(pixels: DataFrame, structure: Structure, shape: tuple[int, int, int]) -> DataFrame:
    """(frame, module, ss, fs, from_module, from_ss, from_fs, value): what each pixel sends to those in reach and in bounds."""
    moved = pixels.crossJoin(F.broadcast(shifts_of(pixels, structure))).select(
        "frame", (F.col("module") + F.col("dm")).alias("module"), (F.col("ss") + F.col("dss")).alias("ss"), (F.col("fs") + F.col("dfs")).alias("fs"),
        F.col("module").alias("from_module"), F.col("ss").alias("from_ss"), F.col("fs").alias("from_fs"), "value",
    )
    inside = [F.col(c).between(0, n - 1) for c, n in zip(("module", "ss", "fs"), shape, strict=True)]
    return moved.where(inside[0] & inside[1] & inside[2])


def dilate(pixels: DataFrame, structure: Structure, shape: tuple[int, int, int], iterations: int = 1, mask: DataFrame | None = None) -> DataFrame:
    """(frame, module, ss, fs): set pixels and those reached in so many rounds. mask: the pixels that may be added."""
    at = ["frame", "module", "ss", "fs"]
    out = pixels.select(*at).distinct()
    for _ in range(iterations):
        grown = neighbours(out.withColumn("value", F.lit(1.0)), structure, shape).select(*at)
        if mask is not None:
            grown = grown.join(mask.select("module", "ss", "fs").distinct(), ["module", "ss", "fs"], "left_semi").select(*at)
        out = out.union(grown).distinct()
    return out


def label(blocks: DataFrame, structure: Structure, vmin: float, npts: int = 1, strict: bool = True, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """region_pixels of each frame's pixels over vmin (or at least vmin, if not strict), inside the region of interest if there is one.

    A structure of rank 2 stays within a module; of rank 3 it reaches over modules, so that a frame's modules come together.
    Regions are numbered from 1 within a frame in the order of their smallest pixel id.
    """
    ship(blocks.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = structure.expand_dims(3)
        for batch in batches:
            for frame, names, image in images(batch):
                bright = image > vmin if strict else image >= vmin
                if roi:
                    inside = np.zeros(image.shape[1:], bool)
                    inside[roi[0] : roi[1], roi[2] : roi[3]] = True
                    bright &= inside
                numbers = kernel.label(bright, full, npts)
                at = np.nonzero(numbers > 0)
                ids = [np.full(len(at[0]), frame, np.int64), numbers[at].astype(np.int64), names[at[0]], *(x.astype(np.int32) for x in at[1:])]
                yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(image[at].astype(float))], ["frame", "region", "module", "ss", "fs", "value"])

    return gathered(blocks).mapInArrow(found, "frame long, region long, module int, ss int, fs int, value double")


def from_labels(pixels: DataFrame, label: str = "label") -> DataFrame:
    """region_pixels from a table of pixels with label numbers; 0 is background."""
    return pixels.where(F.col(label) > 0).select("frame", F.col(label).cast("long").alias("region"), "module", "ss", "fs", "value")


def to_labels(regions: DataFrame, pixels: DataFrame) -> DataFrame:
    """Every pixel with the number of its region, the largest of several; 0 without one."""
    at = ["frame", "module", "ss", "fs"]
    painted = regions.groupBy(*at).agg(F.max("region").alias("label"))
    return pixels.join(painted, at, "left").withColumn("label", F.coalesce("label", F.lit(0).cast("long")))


def merge(one: DataFrame, other: DataFrame) -> DataFrame:
    """The union of regions of equal number; a pixel in both counts once, with the value of the first."""
    at = [*REGION, "module", "ss", "fs"]
    both = one.withColumn("_o", F.lit(0)).unionByName(other.withColumn("_o", F.lit(1)))
    return both.groupBy(*at).agg(F.min_by("value", "_o").alias("value"))


def moments(regions: DataFrame) -> DataFrame:
    """Sums for each region with weights max(value, 0): mass, raw first and second moments, and the first pixel."""
    w, x, y = F.greatest("value", F.lit(0.0)), F.col("fs").cast("double"), F.col("ss").cast("double")
    first = F.min(F.struct("module", "ss", "fs"))
    return regions.groupBy(*REGION).agg(
        F.count("*").alias("n"), F.sum(w).alias("mass"), F.sum(w * x).alias("mx"), F.sum(w * y).alias("my"), F.sum(w * F.col("module")).alias("mz"),
        F.sum(w * x * x).alias("mxx"), F.sum(w * y * y).alias("myy"), F.sum(w * x * y).alias("mxy"), first.alias("first"),
    )


def measures(regions: DataFrame) -> DataFrame:
    """Moments with the centroid (cz, cy, cx) and the covariance (xx, yy, xy). Without mass: the first pixel, no spread."""
    m = moments(regions)
    some = F.col("mass") > 0
    part = lambda c: F.col(c) / F.col("mass")
    m = m.withColumns(
        {"cx": F.when(some, part("mx")).otherwise(F.col("first.fs").cast("double")), "cy": F.when(some, part("my")).otherwise(F.col("first.ss").cast("double")), "cz": F.when(some, part("mz")).otherwise(F.col("first.module").cast("double"))}
    )
    spread = lambda c, a, b: F.when(some, part(c) - F.col(a) * F.col(b)).otherwise(0.0)
    return m.withColumns({"xx": spread("mxx", "cx", "cx"), "yy": spread("myy", "cy", "cy"), "xy": spread("mxy", "cx", "cy")})


#: Covariances and differences of spread under this are rounding: regions along an axis have none.
FLAT = 1e-9


def _xy() -> Column:
    return F.when(F.abs("xy") < FLAT, 0.0).otherwise(F.col("xy"))


def _gap() -> Column:
    gap = F.col("xx") - F.col("yy")
    return F.when(F.abs(gap) < FLAT, 0.0).otherwise(gap)


def _root() -> Column:
    return F.sqrt(4 * _xy() * _xy() + F.pow(_gap(), 2))


def ellipse_fit(measured: DataFrame) -> DataFrame:
    """(frame, region, a, b, theta): half widths at half maximum along the axes; theta by atan, 0 for equal spreads."""
    size = lambda sign: F.sqrt(F.greatest(2 * math.log(2) * (F.col("xx") + F.col("yy") + sign * _root()), F.lit(0.0)))
    tilt = F.when(_gap() == 0, F.signum(_xy()) * (math.pi / 4)).otherwise(0.5 * F.atan(2 * _xy() / _gap()))
    return measured.select(*REGION, size(1).alias("a"), size(-1).alias("b"), tilt.alias("theta"))


def line_fit(measured: DataFrame) -> DataFrame:
    """(frame, region, x_0, y_0, x_1, y_1): the major axis, the end along it first."""
    angle = 0.5 * F.atan2(2 * _xy(), _gap())
    half = F.sqrt(F.greatest(2 * math.log(2) * (F.col("xx") + F.col("yy") + _root()), F.lit(0.0)))
    dx, dy = half * F.cos(angle), half * F.sin(angle)
    return measured.select(*REGION, (F.col("cx") + dx).alias("x_0"), (F.col("cy") + dy).alias("y_0"), (F.col("cx") - dx).alias("x_1"), (F.col("cy") - dy).alias("y_1"))


def signal_share(pixels: DataFrame, vmin: float, by: str = "frame") -> DataFrame:
    """(frame, p0): share of pixels that reach vmin."""
    return pixels.groupBy(by).agg(F.avg((F.col("value") >= vmin).cast("double")).alias("p0"))


def segment_distance(x: Column, y: Column) -> Column:
    """Of a point to the segment (x_0, y_0)-(x_1, y_1), its ends included."""
    ax, ay = F.col("x_1") - F.col("x_0"), F.col("y_1") - F.col("y_0")
    square = ax * ax + ay * ay
    t = F.when(square > 0, ((x - F.col("x_0")) * ax + (y - F.col("y_0")) * ay) / square).otherwise(0.0)
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(x - F.col("x_0") - t * ax, y - F.col("y_0") - t * ay)


def near_counts(regions: DataFrame, lines: DataFrame, vmin: float, xtol: float) -> DataFrame:
    """(frame, region, n, k): pixels nearer than xtol to the region's line, and how many of them reach vmin."""
    near = segment_distance(F.col("fs").cast("double"), F.col("ss").cast("double")) < xtol
    rows = regions.join(lines, list(REGION))
    return rows.groupBy(*REGION).agg(F.count(F.when(near, 1)).alias("n"), F.count(F.when(near & (F.col("value") >= vmin), 1)).alias("k"))


def log_tail(n: Column, k: Column, p: Column) -> Column:
    """log of the chance of k or more hits among n."""

    @F.pandas_udf("double")
    def tail(n: pd.Series, k: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(kernel.log_binomial_tails(n.to_numpy(), k.to_numpy(), p.to_numpy()))

    return tail(n, k, p)


def p_values(regions: DataFrame, lines: DataFrame, p0: DataFrame, vmin: float, xtol: float) -> DataFrame:
    """(frame, region, n, k, log_p, min_support)."""
    ship(regions.sparkSession)
    rows = near_counts(regions, lines, vmin, xtol).join(p0, "frame").withColumn("log_p", log_tail(F.col("n"), F.col("k"), F.col("p0")))
    support = F.when((F.col("p0") > 0) & (F.col("p0") < 1), F.col("log_p") / F.log("p0")).otherwise(0.0)
    return rows.select(*REGION, "n", "k", "log_p", support.alias("min_support"))


def take_regions(regions: DataFrame, numbers: list[int]) -> DataFrame:
    """Regions by their numbers, renumbered from 1 in the order given; negative numbers count from a frame's last region."""
    order = regions.sparkSession.createDataFrame([(int(n), k) for k, n in enumerate(numbers, 1)], "_n long, _k long")
    last = regions.groupBy("frame").agg(F.max("region").alias("_last"))
    wanted = last.crossJoin(F.broadcast(order)).select("frame", F.when(F.col("_n") < 0, F.col("_last") + 1 + F.col("_n")).otherwise(F.col("_n")).alias("region"), "_k")
    return regions.join(wanted, list(REGION)).withColumn("region", F.col("_k")).drop("_k")


def keep_regions(regions: DataFrame, keep: Column) -> DataFrame:
    """The regions for which a condition on `region` holds, renumbered from 1 in their order. Its opposite drops regions."""
    some = regions.where(keep)
    numbers = some.select(*REGION).distinct().withColumn("_k", F.row_number().over(Window.partitionBy("frame").orderBy("region")).cast("long"))
    return some.join(numbers, list(REGION)).withColumn("region", F.col("_k")).drop("_k")


def append_regions(one: DataFrame, other: DataFrame) -> DataFrame:
    """The regions of two tables, those of the second numbered after the first's."""
    last = one.groupBy("frame").agg(F.max("region").alias("_last"))
    moved = other.join(last, "frame", "left").withColumn("region", F.col("region") + F.coalesce("_last", F.lit(0))).drop("_last")
    return one.unionByName(moved.select(one.columns))


def best_peaks(found: DataFrame, quantile: float) -> DataFrame:
    """The brightest share of each frame's peaks: ranks up to the whole part of quantile times their number."""
    many = F.count("*").over(Window.partitionBy("frame"))
    return found.withColumn("_n", many).where(F.col("rank") <= F.floor(F.col("_n") * quantile)).drop("_n")


def lines_to_streaks(lines: DataFrame) -> DataFrame:
    """(index, module_id, x_0, y_0, x_1, y_1) of lines in space (frame, x_0, y_0, z_0, x_1, y_1, z_1): the module nearest their middle."""
    module = F.rint((F.col("z_0") + F.col("z_1")) / 2).cast("int")
    return lines.select(F.col("frame").alias("index"), module.alias("module_id"), "x_0", "y_0", "x_1", "y_1")


def to_streaks(measured: DataFrame) -> DataFrame:
    """(index, module_id, x_0, y_0, x_1, y_1): lines of regions, at the module nearest the centroid."""
    lines = line_fit(measured).join(measured.select(*REGION, F.rint("cz").cast("int").alias("module_id")), list(REGION))
    return lines.select(F.col("frame").alias("index"), "module_id", "x_0", "y_0", "x_1", "y_1")


def peaks(blocks: DataFrame, radius: int, vmin: float, structure: Structure | None = None, npts: int = 1) -> DataFrame:
    """(frame, module, by, bx, ss, fs, value, rank): the brightest local maximum of each bin, ranked within the frame from 1."""
    ship(blocks.sparkSession)
    near = (structure or Structure((1, 1), 1)).expand_dims(3)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, names, image in images(batch):
                labeled = kernel.label(image >= vmin, near, npts) > 0
                best = streak_kernel.peak_labels(streak_kernel.detect_peaks(image, labeled, radius, vmin), image, radius)
                z, y, x = np.unravel_index(np.array(best.at, int), image.shape)
                whole = [names[z], y // radius, x // radius, y, x]
                columns = [pa.array(np.full(len(z), frame, np.int64)), *(pa.array(c.astype(np.int32)) for c in whole), pa.array(image[z, y, x].astype(float)), pa.array(np.arange(1, len(z) + 1, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["frame", "module", "by", "bx", "ss", "fs", "value", "rank"])

    return gathered(blocks).mapInArrow(found, "frame long, module int, by int, bx int, ss int, fs int, value double, rank int")
