"""Detection on streams. Frames are independent once the metadata are fixed, so detection keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streakframe.config import StreakFinder
from streakframe.operators import blocks
from streakframe.plans.pipelines import streaks_of
from streakframe.session import ship


def snr_blocks(frames: DataFrame, meta: DataFrame, std_min: float = 0.0) -> DataFrame:
    """(frame, modules) of a stream as signal-to-noise.

    frames: one-module frames (frame, module, n_ss, n_fs, pixels), or whole frames (frame, modules) with such modules in an
    array, as a stream has no later row to wait for. meta: of blocks.meta_blocks; a static, small side.
    """
    if "modules" in frames.columns:
        return blocks.snr_of_frames(frames, meta, std_min)
    return blocks.gathered(blocks.snr(frames, meta, std_min), 1)


def detect(frames: DataFrame, meta: DataFrame, config: StreakFinder) -> DataFrame:
    """Streaks of a stream of frames (or of a table)."""
    ship(frames.sparkSession)
    return streaks_of(snr_blocks(frames, meta, config.std_min), config)


def hit_rate(events: DataFrame, size: str = "1 day", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """(start, events) for each window of event time. A time without zone is cast first: watermarks need one with."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = timed.withWatermark(time, late) if events.isStreaming else timed
    return rows.groupBy(F.window(time, size).alias("w")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "events")
