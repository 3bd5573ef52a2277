"""Runs of frames in parquet: files to frame numbers, reading with pruned columns and frames, writing, and a frame index.

A run's files hold rows of the block layout without run-wide frame numbers: (row, module, n_ss, n_fs, pixels). Files go in
the order of their names, and a frame's number is its place over all files. Listing and reading go through Spark, so that
any store will do.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streakframe.config import Run, Scan
from streakframe.operators import blocks, geometry
from streakframe.schema import BLOCK
from streakframe.session import ship
from streakframe.sources import geom


def files(spark: SparkSession, folder: str, pattern: str = r".*\.parquet") -> list[tuple[str, int]]:
    """(path, modification time in ms) of a folder's files whose name matches, in the order of names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getPath().toString(), s.getModificationTime()) for s in store.listStatus(path)]
    return sorted(x for x in found if re.fullmatch(pattern, x[0].rpartition("/")[2]))


def build_index(spark: SparkSession, folder: str, pattern: str = r".*\.parquet", starts_at: int = 0) -> DataFrame:
    """(file, row, frame): a row for each frame. Files without all modules of a frame are an error."""
    names = [name for name, _ in files(spark, folder, pattern)]
    if not names:
        raise FileNotFoundError(f"{folder} has no {pattern}")
    order = spark.createDataFrame(list(enumerate(names)), "place int, file string")
    rows = spark.read.parquet(*names).select("row", "module", F.col("_metadata.file_path").alias("file"))
    frames = rows.groupBy("file", "row").agg(F.count("*").alias("modules"))
    modules = rows.agg(F.count_distinct("module")).first()[0]
    whole = F.when(F.col("modules") == modules, True).otherwise(F.raise_error(F.lit("modules differ in their number of frames")).cast("boolean"))
    frames = frames.where(whole).join(F.broadcast(order), "file")
    sizes = frames.groupBy("place", "file").agg(F.count("*").alias("n"))
    before = sizes.withColumn("first", F.sum("n").over(Window.orderBy("place")) - F.col("n"))  # a row for each file
    nth = F.row_number().over(Window.partitionBy("file").orderBy("row")) - 1
    return frames.withColumn("nth", nth).join(F.broadcast(before.select("file", "first")), "file").select("file", "row", (F.col("nth") + F.col("first") + starts_at).cast("long").alias("frame"))


def frame_index(spark: SparkSession, folder: str, cache: str | None = None, pattern: str = r".*\.parquet", starts_at: int = 0) -> DataFrame:
    """build_index, kept in `cache` and built anew when a file is newer than it or the list of files has changed."""
    if cache is None:
        return build_index(spark, folder, pattern, starts_at)
    there = files(spark, folder, pattern)
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{cache}/_SUCCESS")
    store = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(done) and store.getFileStatus(done).getModificationTime() >= max(t for _, t in there):
        kept = spark.read.parquet(cache)
        if {r.file for r in kept.select("file").distinct().collect()} == {name for name, _ in there}:
            return kept
    build_index(spark, folder, pattern, starts_at).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def numbers(index: DataFrame, frames: list[int]) -> list[int]:
    """Frame numbers as they are in the index; negative ones count from the end. A number that isn't there is an error."""
    low, high = index.agg(F.min("frame"), F.max("frame")).first()
    found = [high + 1 + f if f < 0 else f for f in frames]
    if wrong := [f for f, n in zip(frames, found, strict=True) if low is None or not low <= n <= high]:
        raise IndexError(f"no frames {wrong[:10]} among {low} to {high}")
    return found


def load(spark: SparkSession, index: DataFrame, frames: list[int] | DataFrame | None = None, roi: tuple[int, int, int, int] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The block layout of a run's frames, or of some, cut to a region; missing values (NaN) are 0.

    frames: numbers, as in numbers(), or a table of them. keep: further columns of the index. Only files that hold wanted frames
    are read.
    """
    if frames is None:
        wanted = index
    elif isinstance(frames, DataFrame):
        wanted = index.join(frames.select("frame"), "frame", "left_semi").select(index.columns)
    else:
        wanted = index.where(F.col("frame").isin(numbers(index, frames)))
    names = [r.file for r in wanted.select("file").distinct().collect()]
    if not names:
        return spark.createDataFrame([], BLOCK)
    rows = spark.read.parquet(*names).withColumn("file", F.col("_metadata.file_path")).join(wanted, ["file", "row"])
    pixels = F.transform("pixels", lambda x: F.nanvl(x.cast("double"), F.lit(0.0)))
    if roi is None:
        return rows.select("frame", "module", "n_ss", "n_fs", pixels.alias("pixels"), *keep)
    y0, y1, x0, x1 = roi
    lines = F.transform(F.sequence(F.lit(y0), F.lit(y1 - 1)), lambda y: F.slice("p", y * F.col("n_fs") + x0 + 1, F.lit(x1 - x0)))
    # a step of its own: beside a new n_fs the lambda would take that for the width of the old lines
    cut = rows.withColumn("p", pixels).select("frame", "module", F.flatten(lines).alias("pixels"), *keep)
    return cut.select("frame", "module", F.lit(y1 - y0).alias("n_ss"), F.lit(x1 - x0).alias("n_fs"), "pixels", *keep)


def save(block: DataFrame, path: str, mode: str = "append") -> None:
    """append; overwrite; insert: frames that are there already are replaced."""
    spark = block.sparkSession
    if mode != "insert":
        block.write.mode(mode).parquet(path)
        return
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, draft, old = hadoop(path), hadoop(f"{path}.new"), hadoop(f"{path}.old")
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(target) and store.exists(old):  # an insert that ended between its two renames
        store.rename(old, target)
    kept = spark.read.parquet(path).join(block.select("frame").distinct(), "frame", "left_anti")
    kept.select(block.columns).unionByName(block).write.mode("overwrite").parquet(f"{path}.new")
    # the table is whole under one of its names at any time
    store.delete(old, True)
    if not (store.rename(target, old) and store.rename(draft, target)):
        raise OSError(f"{path} could not be replaced; its rows are in {path}.old or {path}")
    store.delete(old, True)


def zip_modules(spark: SparkSession, folders: list[str], pattern: str = r".*\.parquet", starts_at: int = 0) -> DataFrame:
    """(file, row, module, frame) of a run with a folder of files for each module: the n-th rows of all modules are one frame.

    Modules with other numbers of frames are an error.
    """
    parts = [build_index(spark, folder, pattern, starts_at).withColumn("module", F.lit(k)) for k, folder in enumerate(folders)]
    every = functools.reduce(DataFrame.unionByName, parts)
    sizes = [r.n for r in every.groupBy("module").agg(F.count("*").alias("n")).collect()]  # a row for each module
    if len(sizes) != len(folders) or len(set(sizes)) != 1:
        raise ValueError("modules differ in their number of frames")
    return every.select("file", "row", "module", "frame")


def load_modules(spark: SparkSession, index: DataFrame, frames: list[int] | DataFrame | None = None, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """load() for an index of zip_modules: a module's number is that of its folder."""
    block = load(spark, index.withColumnRenamed("module", "_own"), frames, roi, ("_own",))
    return block.select("frame", F.col("_own").alias("module"), "n_ss", "n_fs", "pixels")


def assembled(block: DataFrame, panels: DataFrame) -> DataFrame:
    """Frames of one module, each the geometry-corrected image of its modules; places without a pixel are 0.

    A frame's modules come together once; the image is painted from arrays of places, so no pixel has a row of its own.
    """
    ship(block.sparkSession)
    places = geometry.pixel_indices(geometry.pixel_map(panels))
    height, width = places.agg(F.max("row") + 1, F.max("col") + 1).first()
    known = blocks.side(blocks.meta_blocks(places.withColumn("at", F.col("row") * width + F.col("col")), "at"), "at")
    parts = block.join(known, "module").groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("module", "pixels", "at"))).alias("m"))

    def painted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("m")
            pixels, at = (lists.values.field(c) for c in ("pixels", "at"))
            begin, value, place = pixels.offsets.to_numpy(), pixels.values.to_numpy(zero_copy_only=False), at.values.to_numpy(zero_copy_only=False)
            for frame, start, stop in zip(b.column("frame").to_pylist(), lists.offsets.to_numpy(), lists.offsets.to_numpy()[1:], strict=False):
                image = np.zeros(height * width)
                own = slice(begin[start], begin[stop])
                image[place[own]] = value[own]  # the last of several wins
                yield pa.RecordBatch.from_arrays([pa.array([frame], pa.int64()), *(pa.array([x], pa.int32()) for x in (0, height, width)), pa.array([image])], ["frame", "module", "n_ss", "n_fs", "pixels"])

    return parts.mapInArrow(painted, BLOCK)


def scanned(spark: SparkSession, scan: Scan, frames: list[int] | DataFrame | None = None) -> DataFrame:
    """The frames of a scan in the block layout; geometry-corrected whole images where its image_kind is `full`."""
    index = open_run(spark, scan.scan_num, scan.run, scan.file("index"))
    block = load(spark, index, frames) if "module" not in index.columns else load_modules(spark, index, frames)
    if not scan.apply_geometry:
        return block
    if not scan.run.geometry_file:
        raise ValueError("full images need a geometry file")
    return assembled(block, geom.read_geom(spark, scan.run.geometry_file))


def split(index: DataFrame, chunks: int) -> DataFrame:
    """The index with `chunk`: contiguous frames, the first chunks a frame longer."""
    from streakframe.operators.groups import split as split_rows

    return split_rows(index, chunks, ["frame"])


def open_run(spark: SparkSession, run_id: int, config: Run, cache: str | None = None) -> DataFrame:
    """The frame index of a run, by its facility's layout of files: `parquet` has all modules in each file, `modules` a folder for each."""
    folder = config.data_dir.format(run_id=run_id, module="{module}")
    if config.facility == "parquet":
        return frame_index(spark, folder, cache, config.file_pattern, config.starts_at)
    if config.facility == "modules":
        return zip_modules(spark, [folder.format(module=k) for k in range(config.num_modules)], config.file_pattern, config.starts_at)
    raise ValueError(f"no reader for {config.facility}")


def compile_tables(spark: SparkSession, paths: list[str], out: str) -> DataFrame:
    """One table from those of many chunks."""
    spark.read.parquet(*paths).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
