"""Tables of the engine, and the two layouts of an image stack.

block: one row for each frame and module with its pixels in an array. long: one row for each pixel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "frame BIGINT, module INT, n_ss INT, n_fs INT, pixels ARRAY<DOUBLE>"
PIXELS = "frame BIGINT, module INT, ss INT, fs INT, value DOUBLE"
PIXEL_META = "module INT, ss INT, fs INT, mask BOOLEAN, std DOUBLE, flatfield DOUBLE"
STREAKS = "index BIGINT, module_id INT, x_0 DOUBLE, y_0 DOUBLE, x_1 DOUBLE, y_1 DOUBLE"
PANELS = (
    "panel_id INT, name STRING, module INT, min_ss INT, max_ss INT, min_fs INT, max_fs INT, corner_x DOUBLE, corner_y DOUBLE, "
    "ss_x DOUBLE, ss_y DOUBLE, ss_z DOUBLE, fs_x DOUBLE, fs_y DOUBLE, fs_z DOUBLE, coffset DOUBLE, res DOUBLE"
)
AXES = [f"{axis}_{c}" for axis in "abc" for c in "xyz"]
XTALS = "index BIGINT, " + ", ".join(f"{c} DOUBLE" for c in AXES)
PIXEL = ("module", "ss", "fs")


def to_long(block: DataFrame) -> DataFrame:
    """Block to long. A missing value (NaN) reads as 0, as sources deliver it."""
    pixels = block.select("frame", "module", "n_fs", F.posexplode("pixels").alias("pos", "v"))
    return pixels.select(
        "frame", "module", F.expr("pos div n_fs").cast("int").alias("ss"), F.expr("pos % n_fs").cast("int").alias("fs"), F.nanvl(F.col("v").cast("double"), F.lit(0.0)).alias("value")
    )


def to_block(pixels: DataFrame) -> DataFrame:
    """Long to block, pixels in row-major order. Frames must be complete."""
    rows = pixels.groupBy("frame", "module").agg(
        (F.max("ss") + 1).alias("n_ss"), (F.max("fs") + 1).alias("n_fs"), F.sort_array(F.collect_list(F.struct("ss", "fs", "value"))).alias("p")
    )
    return rows.select("frame", "module", "n_ss", "n_fs", F.transform("p", lambda x: x["value"]).alias("pixels"))
