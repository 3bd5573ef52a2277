"""python -m streakframe.cli COMMAND: metadata, metalist, detect, index or compile, on a run of parquet frames.

Configuration is a JSON or INI file of streakframe.config.Scan and of the command's own parameters; under spark-submit the
session's settings come from there.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streakframe import config as cfg
from streakframe.operators import geometry, groups, indexing
from streakframe.plans import pipelines
from streakframe.schema import to_long
from streakframe.sources import geom, runs


def metadata(spark: SparkSession, scan: cfg.Scan, params: cfg.Metadata) -> DataFrame:
    # the sample is drawn from the index of frames, and only its files are read
    sample = pipelines.sample_frames(runs.open_run(spark, scan.scan_num, scan.run, scan.file("index")), scan.n_frames)
    pipelines.create_metadata(to_long(runs.scanned(spark, scan, sample)), params).write.mode("overwrite").parquet(out := scan.file("metadata"))
    return spark.read.parquet(out)


def metalist(spark: SparkSession, scan: cfg.Scan, params: cfg.Metadata) -> DataFrame:
    frames = runs.open_run(spark, scan.scan_num, scan.run, scan.file("index")).agg(F.max("frame")).first()[0] + 1
    data = to_long(runs.scanned(spark, scan))
    tables = pipelines.create_metalist(data, frames, scan.n_frames, scan.spacing, params)
    for name, t in zip(("metadata", "whitefields", "eigen", "eigenvalues"), tables, strict=True):
        t.write.mode("overwrite").parquet(scan.file("metalist", suffix=name))
    return spark.read.parquet(scan.file("metalist", suffix="metadata"))


def detect(spark: SparkSession, scan: cfg.Scan, params: cfg.StreakFinder | cfg.RegionFinder, kind: str = "streaks", frames_only: bool = False) -> DataFrame:
    """Streaks of frames with more than the scan's number of hits, or a CSV list of those frames alone."""
    data = runs.scanned(spark, scan)
    wanted = scan.file("metadata"), scan.file("metalist", suffix="metadata")
    meta = next(spark.read.parquet(p) for p in wanted if runs_there(spark, p))
    fields = spark.read.parquet(p) if runs_there(spark, p := scan.file("metalist", suffix="eigen")) else None
    plan = pipelines.detect_streaks if kind == "streaks" else pipelines.detect_regions
    hits = pipelines.detect_hits(plan(data, meta, params, fields), scan.hit_threshold)
    out = scan.file(kind)
    if frames_only:
        hits.select("index").distinct().write.mode("overwrite").csv(out, header=True)
        return hits.select("index").distinct()
    hits.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def index(spark: SparkSession, scan: cfg.Scan, params: cfg.Indexing, lens: indexing.Lens, xtals: str, pixel_size: float) -> DataFrame:
    streaks = spark.read.parquet(scan.file("streaks"))
    if scan.run.geometry_file:
        streaks = geometry.to_streaks(streaks.select("index", "module_id", "x_0", "y_0", "x_1", "y_1"), geom.read_geom(spark, scan.run.geometry_file))
    # numbered by their rank within the frame, so that a task that is run again numbers them the same
    ranked = groups.ranking(streaks.select("index", "x_0", "y_0", "x_1", "y_1"), ["x_0", "y_0", "x_1", "y_1"]).withColumn("streak_id", F.col("rank").cast("long")).drop("rank")
    patterns = geometry.to_patterns(ranked, pixel_size)
    found = pipelines.index_patterns(patterns, spark.read.parquet(xtals), lens, params)
    found.write.mode("overwrite").parquet(out := scan.file("solutions"))
    return spark.read.parquet(out)


def runs_there(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="streakframe", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("metadata", "metalist", "detect", "index"):
        sub = commands.add_parser(name)
        sub.add_argument("scan")
        sub.add_argument("params")
        if name == "detect":
            sub.add_argument("--kind", choices=("streaks", "regions"), default="streaks")
            sub.add_argument("--frames-only", action="store_true")
        if name == "index":
            sub.add_argument("--xtals", required=True)
            sub.add_argument("--foc-pos", type=float, nargs=3, required=True)
            sub.add_argument("--pupil-roi", type=float, nargs=4, required=True)
            sub.add_argument("--sample-z", type=float, default=0.0)
            sub.add_argument("--pixel-size", type=float, required=True)
    sub = commands.add_parser("compile")
    sub.add_argument("out")
    sub.add_argument("tables", nargs="+")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"streakframe {a.command}").getOrCreate()
    if a.command == "compile":
        runs.compile_tables(spark, a.tables, a.out)
        return
    scan = cfg.read(cfg.Scan, a.scan)
    if a.command in ("metadata", "metalist"):
        (metadata if a.command == "metadata" else metalist)(spark, scan, cfg.read(cfg.Metadata, a.params))
    elif a.command == "detect":
        detect(spark, scan, cfg.read(cfg.StreakFinder if a.kind == "streaks" else cfg.RegionFinder, a.params), a.kind, a.frames_only)
    else:
        lens = indexing.Lens(tuple(a.foc_pos), tuple(a.pupil_roi), a.sample_z)
        index(spark, scan, cfg.read(cfg.Indexing, a.params), lens, a.xtals, a.pixel_size)


if __name__ == "__main__":
    main()
