"""Detector geometry: from array coordinates of panels to the assembled detector.

panels: the table of schema.PANELS, a row for each panel (a few hundred at most), so it is broadcast after its size is
checked. A panel's region ends at max_ss and max_fs, both inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streakframe.functions.vectors import clip

#: Most panels that are broadcast.
MOST = 10_000


def dimension(panels: DataFrame) -> DataFrame:
    """Panels for a broadcast join while they are few."""
    return F.broadcast(panels) if panels.limit(MOST + 1).count() <= MOST else panels


def to_panel_plane(ss: Column, fs: Column, half_pixel: bool = True) -> tuple[Column, Column, Column]:
    """x, y, z of coordinates relative to a joined panel's first pixel."""
    shift = 0.5 if half_pixel else 0.0
    x = ss * F.col("ss_x") + fs * F.col("fs_x") + F.col("corner_x") + shift
    y = ss * F.col("ss_y") + fs * F.col("fs_y") + F.col("corner_y") + shift
    return x, y, ss * F.col("ss_z") + fs * F.col("fs_z") + F.col("coffset") * F.col("res")


def panel_distance(ss: Column, fs: Column) -> Column:
    """From a joined panel's region in its array; 0 inside."""
    return F.hypot(ss - clip(ss, F.col("min_ss"), F.col("max_ss") + 1), fs - clip(fs, F.col("min_fs"), F.col("max_fs") + 1))


def panel_bounds(panels: DataFrame, half_pixel: bool = True) -> DataFrame:
    """(panel_id, x_min, y_min, x_max, y_max) from two opposite corners."""
    zero = F.lit(0.0)
    a = to_panel_plane(zero, zero, half_pixel)
    b = to_panel_plane((F.col("max_ss") - F.col("min_ss")).cast("double"), (F.col("max_fs") - F.col("min_fs")).cast("double"), half_pixel)
    return panels.select("panel_id", F.least(a[0], b[0]).alias("x_min"), F.least(a[1], b[1]).alias("y_min"), F.greatest(a[0], b[0]).alias("x_max"), F.greatest(a[1], b[1]).alias("y_max"))


def bounds(panels: DataFrame) -> DataFrame:
    return panel_bounds(panels).agg(F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"))


def pixel_map(panels: DataFrame, half_pixel: bool = True) -> DataFrame:
    """(module, ss, fs, x, y, z) for each pixel of each panel."""
    grid = panels.withColumn("ss", F.explode(F.sequence("min_ss", "max_ss"))).withColumn("fs", F.explode(F.sequence("min_fs", "max_fs")))
    x, y, z = to_panel_plane((F.col("ss") - F.col("min_ss")).cast("double"), (F.col("fs") - F.col("min_fs")).cast("double"), half_pixel)
    return grid.select("module", "ss", "fs", x.alias("x"), y.alias("y"), z.alias("z"))


def pixel_indices(mapped: DataFrame) -> DataFrame:
    """(module, ss, fs, row, col): whole coordinates in the assembled image, from 0."""
    low = mapped.agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    joined = mapped.crossJoin(F.broadcast(low))  # one row
    return joined.select("module", "ss", "fs", F.rint(F.col("y") - F.col("_y")).cast("int").alias("row"), F.rint(F.col("x") - F.col("_x")).cast("int").alias("col"))


def assemble(pixels: DataFrame, indices: DataFrame) -> DataFrame:
    """(frame, row, col, value): frames painted into the assembled image; of several pixels at one place the last wins."""
    joined = pixels.join(indices, ["module", "ss", "fs"])
    return joined.groupBy("frame", "row", "col").agg(F.max_by("value", F.struct("module", "ss", "fs")).alias("value"))


def to_detector(points: DataFrame, panels: DataFrame, tolerance: float = 1.0, half_pixel: bool = True, pixel_size: float = 1.0, key: str = "point") -> DataFrame:
    """points (key, module, ss, fs) to (key, x, y, z) from the detector's least x and y.

    The panel is the last one nearer than tolerance; without one x, y and z are those of the origin.
    """
    shape = panels.agg(F.max("max_ss").alias("_s"), F.max("max_fs").alias("_f"))
    clipped = points.crossJoin(F.broadcast(shape)).select(key, "module", clip(F.col("ss"), 0.0, F.col("_s")).alias("ss"), clip(F.col("fs"), 0.0, F.col("_f")).alias("fs"))
    x, y, z = to_panel_plane(F.col("ss") - F.col("min_ss"), F.col("fs") - F.col("min_fs"), half_pixel)
    near = clipped.join(dimension(panels), "module").where(panel_distance(F.col("ss"), F.col("fs")) < tolerance)
    best = near.groupBy(key).agg(F.max_by(F.struct(x.alias("x"), y.alias("y"), z.alias("z")), "panel_id").alias("p"))
    low = bounds(panels).select("x_min", "y_min")
    full = points.select(key).distinct().join(best, key, "left").crossJoin(F.broadcast(low))
    zero = F.lit(0.0)
    return full.select(key, (pixel_size * (F.coalesce("p.x", zero) - F.col("x_min"))).alias("x"), (pixel_size * (F.coalesce("p.y", zero) - F.col("y_min"))).alias("y"), (pixel_size * F.coalesce("p.z", zero)).alias("z"))


def to_streaks(streaks: DataFrame, panels: DataFrame, half_pixel: bool = True) -> DataFrame:
    """Streaks of modules to the assembled detector, each wholly on the panel nearest both its ends.

    The end nearer that panel is placed by it, the other follows along the panel's axes, so that the length stays. Streaks that
    repeat are placed each. Panels are gathered by module first, so that a streak chooses among them within its own row.
    """
    ids = [c for c in streaks.columns if c not in ("x_0", "y_0", "x_1", "y_1", "module_id")]
    own = [c for c in panels.columns if c != "module"]
    of_module = panels.groupBy(F.col("module").alias("module_id")).agg(F.collect_list(F.struct(*own)).alias("_panels"))
    joined = streaks.join(dimension(of_module), "module_id")

    def far(p: Column, end: int) -> Column:
        ss, fs = F.col(f"y_{end}"), F.col(f"x_{end}")
        return F.hypot(ss - clip(ss, p["min_ss"], p["max_ss"] + 1), fs - clip(fs, p["min_fs"], p["max_fs"] + 1))

    ranked = F.transform("_panels", lambda p: F.struct((far(p, 0) + far(p, 1)).alias("d"), p["panel_id"].alias("panel_id"), (far(p, 0) <= far(p, 1)).alias("first"), p.alias("p")))
    # least by distance, then by number; structs compare by their fields in order
    best = joined.select("index", *[c for c in ids if c != "index"], "x_0", "y_0", "x_1", "y_1", F.array_min(ranked).alias("b")).select("*", "b.p.*", F.col("b.first").alias("_first")).drop("b")
    first = F.col("_first")
    near = lambda a: F.when(first, F.col(f"{a}_0")).otherwise(F.col(f"{a}_1"))
    other = lambda a: F.when(first, F.col(f"{a}_1")).otherwise(F.col(f"{a}_0"))
    x, y, _ = to_panel_plane(near("y") - F.col("min_ss"), near("x") - F.col("min_fs"), half_pixel)
    ds, df = other("y") - near("y"), other("x") - near("x")
    dx, dy = ds * F.col("ss_x") + df * F.col("fs_x"), ds * F.col("ss_y") + df * F.col("fs_y")
    placed = {"x_0": F.when(first, x).otherwise(x + dx), "y_0": F.when(first, y).otherwise(y + dy), "x_1": F.when(first, x + dx).otherwise(x), "y_1": F.when(first, y + dy).otherwise(y)}
    low = bounds(panels).select("x_min", "y_min")
    out = best.crossJoin(F.broadcast(low))  # one row
    return out.select("index", *[c for c in ids if c != "index"], *((placed[c] - F.col(f"{c[0]}_min")).alias(c) for c in placed))


def to_patterns(streaks: DataFrame, pixel_size: float) -> DataFrame:
    """Streaks in metres."""
    return streaks.withColumns({c: F.col(c) * pixel_size for c in ("x_0", "y_0", "x_1", "y_1")})
