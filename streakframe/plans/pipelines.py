"""The end-to-end plans: metadata of a run, detection of streaks, indexing of orientations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streakframe.config import Indexing, Metadata, RegionFinder, Scaling, StreakFinder
from streakframe.functions.vectors import columns, concentric
from streakframe.kernels import streaks as kernel
from streakframe.kernels.structure import Structure
from streakframe.operators import blocks, groups, indexing, pixels, regions, stats
from streakframe.schema import PIXEL, to_block
from streakframe.session import ship


def sample_frames(frames: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n frames at random without replacement, the same for the same seed."""
    return frames.select("frame").distinct().orderBy(F.xxhash64("frame", F.lit(seed)), "frame").limit(n)


def create_metadata(data: DataFrame, config: Metadata) -> DataFrame:
    """pixel_meta from a stack in the long layout: the mask by its method, then background and deviation of good values."""
    blank = data.groupBy(*PIXEL).agg(F.lit(True).alias("mask"))
    roi = config.roi.to_roi() if config.roi.size() else None
    m, b = config.mask, config.background
    settings = {"vmin": m.vmin, "vmax": m.vmax, "snr_max": m.snr_max, "std_min": m.std_min, "std_max": m.std_max, "roi": roi}
    late = m.method in ("snr", "std")
    mask = blank if late else pixels.update_mask(data, blank, m.method, **settings)
    extra = {"r0": b.r0, "r1": b.r1, "n_iter": b.n_iter, "lm": b.lm} if b.method.startswith("robust") else {}
    found = stats.background(pixels.apply_mask(data, mask), b.method, **extra)
    meta = mask.join(found, list(PIXEL)).select(*PIXEL, "mask", "std", "flatfield")
    if m.method == "std":
        return pixels.update_mask(data, meta, "std", **settings)
    if m.method == "snr":
        return pixels.update_mask(pixels.snr(data, meta), meta, "snr", **settings)
    return meta


def create_metalist(data: DataFrame, frames: int, n_frames: int, spacing: int, config: Metadata) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Whitefields of windows of frames, their common mask and std, and their principal components.

    Returns (pixel_meta, whitefields, eigen_fields, eigen_values). Each window is a stack of its own: its modules are numbered
    apart from the others', and one grouped pass goes over all windows.
    """
    modules = data.agg(F.max("module")).first()[0] + 1
    last = max(0, frames - n_frames) // spacing
    low, high = F.greatest(F.ceil((F.col("frame") - n_frames + 1) / spacing), F.lit(0)), F.least(F.floor(F.col("frame") / spacing), F.lit(last))
    held = data.where(F.col("frame").between(0, frames - 1) & (low <= high)).withColumn("wf", F.explode(F.sequence(low, high)))
    stacks = held.withColumn("module", (F.col("wf") * modules + F.col("module")).cast("int")).drop("wf")
    own = {"wf": F.floor(F.col("module") / modules), "module": F.col("module") % modules}
    metas = create_metadata(stacks, config).withColumns(own)
    fields = metas.select("wf", *PIXEL, F.col("flatfield").alias("value"))
    merged = stats.accumulate(metas)
    flat = fields.groupBy(*PIXEL).agg(F.avg("value").alias("value"))
    eigen, values = stats.pca(fields, flat)
    return merged.join(flat.withColumnRenamed("value", "flatfield"), list(PIXEL)), fields, eigen, values


def scale_background(data: DataFrame, meta: DataFrame, scaling: Scaling, fields: DataFrame | None = None) -> DataFrame:
    """meta, or a row for each frame and pixel with the frame's own background."""
    if scaling.method == "no-scale":
        return meta
    good = fields.where(F.col("comp").isin(list(scaling.good_fields)))
    flat = meta.select(*PIXEL, F.col("flatfield").alias("value"))
    rest = data.join(flat.withColumnRenamed("value", "_b"), list(PIXEL)).withColumn("value", F.col("value") - F.col("_b")).drop("_b")
    if scaling.method == "lsq":
        coef = stats.lsq(rest, good)
    elif scaling.method == "robust-lsq":
        coef = stats.robust_lsq(rest, good, scaling.r0, scaling.r1, scaling.n_iter, scaling.lm)
    else:
        raise ValueError(f"scaling can't be {scaling.method}")
    own = stats.project(coef, good, flat).withColumnRenamed("value", "flatfield")
    return own.join(meta.select(*PIXEL, "mask", "std"), list(PIXEL))


def signal(data: DataFrame, meta: DataFrame, scaling: Scaling, std_min: float, fields: DataFrame | None = None) -> DataFrame:
    return pixels.snr(data, scale_background(data, meta, scaling, fields), std_min)


def centred(streaks: DataFrame, center: tuple[float, float] | None) -> DataFrame:
    """Streaks that lie across the direction to the centre, where one is given."""
    if center is None:
        return streaks
    return streaks.where(concentric(columns("x_0", "y_0", "x_1", "y_1"), F.lit(center[0]), F.lit(center[1])))


def signal_blocks(data: DataFrame, meta: DataFrame, scaling: Scaling, std_min: float, fields: DataFrame | None = None) -> DataFrame:
    """Signal-to-noise frames in the block layout, from frames in either layout. No pixel gets a row of its own on the way from blocks."""
    frames = data if "pixels" in data.columns else to_block(data)
    known = blocks.side(blocks.meta_blocks(meta), "mask")
    if scaling.method == "no-scale":
        return blocks.snr(frames, known, std_min)
    good = blocks.side(blocks.field_blocks(fields, tuple(scaling.good_fields)), "w")
    left = blocks.rest(frames, known)
    if scaling.method == "lsq":
        coef = blocks.lsq(left, good)
    elif scaling.method == "robust-lsq":
        coef = blocks.robust_lsq(left, good, scaling.r0, scaling.r1, scaling.n_iter, scaling.lm)
    else:
        raise ValueError(f"scaling can't be {scaling.method}")
    return blocks.snr(frames.join(coef, "frame"), known.join(good, "module"), std_min)


def detect_regions(data: DataFrame, meta: DataFrame, config: RegionFinder, fields: DataFrame | None = None) -> DataFrame:
    """Streak table of regions over the threshold in signal-to-noise, inside config.roi where it has an extent. data: either layout."""
    snr = signal_blocks(data, meta, config.scaling, config.std_min, fields)
    found = regions.label(snr, config.regions.structure.to_structure(2), config.regions.vmin, config.regions.npts, roi=config.roi.to_roi() if config.roi.size() else None)
    return centred(regions.to_streaks(regions.measures(found)), config.center)


STREAK_ROWS = "index bigint, module_id int, x_0 double, y_0 double, x_1 double, y_1 double, log_p double, min_support double"


def streaks_of(frames: DataFrame, config: StreakFinder) -> DataFrame:
    """Streaks of signal-to-noise frames (frame, modules): one call of the kernel for each frame, on a stream too (no state)."""
    s, p = config.streaks, config.peaks

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["module_id", "x_0", "y_0", "x_1", "y_1", "log_p", "min_support"]
        growth, labels = s.structure.to_structure(3), Structure((0, p.structure.radius, p.structure.radius), p.structure.connectivity)
        if not config.cross_module:
            growth = s.structure.to_structure(2).expand_dims(3)
        elif s.structure.radius:
            labels = p.structure.to_structure(3)
        for b in batches:
            frame, rows = [], [np.zeros((0, 7))]
            for name, module, image in blocks.images(b):
                own = kernel.find(image, growth, s.vmin, p.npts, s.xtol, s.nfa, s.min_size, labels)
                own[:, 0] = module[own[:, 0].astype(int)]
                frame += [name] * len(own)
                rows.append(own)
            table = np.concatenate(rows)
            columns = [pa.array(frame, pa.int64()), pa.array(table[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in table[:, 1:].T)]
            yield pa.RecordBatch.from_arrays(columns, ["index", *names])

    return frames.mapInArrow(found, STREAK_ROWS)


def detect_streaks(data: DataFrame, meta: DataFrame, config: StreakFinder, fields: DataFrame | None = None, modules: int | None = None) -> DataFrame:
    """Streak table of a run in either layout. modules: of each frame; frames of one are never shuffled."""
    ship(data.sparkSession)
    snr = signal_blocks(data, meta, config.scaling, config.std_min, fields)
    return centred(streaks_of(blocks.gathered(snr, modules), config), config.center)


def detect_hits(streaks: DataFrame, threshold: int, pulses: DataFrame | None = None) -> DataFrame:
    """Streaks of frames with more than `threshold` of them, with their frame's pulse_id where pulses (frame, pulse_id) are given."""
    hits = groups.hits(streaks, threshold)
    if pulses is None:
        return hits
    return hits.join(pulses.withColumnRenamed("frame", "index"), "index", "left")


def index_patterns(patterns: DataFrame, xtals: DataFrame, lens: indexing.Lens, config: Indexing, q_abs: float | None = None, num_points: int = 100) -> DataFrame:
    """(index, peak, a_x to c_z): orientations that explain the streaks of each pattern."""
    if len(set(config.shape)) != 1:
        raise ValueError("rotation maps are cubic")
    uca = indexing.patterns_to_uca(patterns, lens)
    if q_abs is None:
        q_abs = float(uca.agg(F.sqrt(F.max("max_res"))).first()[0])
    hkl = indexing.hkl_in_ball(patterns.sparkSession, xtals, q_abs)
    rlp, crystals = indexing.lattice(hkl, xtals), xtals.limit(2).count()
    # points and streaks meet by cells of |q|^2; one crystal's points serve every pattern
    pairs = indexing.candidates(rlp.drop("index") if crystals == 1 else rlp, uca, q_abs**2 / 256)
    # candidates are dealt by pattern and sorted; what is made of them stays in that order, and no cell of a map is shuffled
    dealt = pairs.drop("min_res", "max_res").repartition("index").sortWithinPartitions("index", "streak_id")
    size = config.shape[0]
    maps = indexing.rotomap(indexing.rotograms(dealt, num_points), size, config.width, gathered=True)
    tilts = indexing.map_tilts(maps, config.threshold, config.n_max, size, config.vicinity.to_structure(3), config.connectivity.to_structure(3))
    return indexing.solutions(tilts, xtals)
