"""The commands, one after the other, on a small synthetic run."""

import numpy as np
from pyspark.sql import functions as F

from streakframe import cli
from streakframe import config as cfg


def test_commands(spark, tmp_path):
    draw = np.random.default_rng(3)
    rows = []
    for k in range(8):
        image = draw.normal(100, 1, (14, 14))
        image[3 + k, 2:11] += 80 * (k % 2)
        rows.append((k, 0, 14, 14, image.ravel().tolist()))
    data = spark.createDataFrame(rows, "row long, module int, n_ss int, n_fs int, pixels array<double>")
    data.coalesce(1).write.parquet(str(tmp_path / "run-1"))
    scan = cfg.Scan(1, output_dir=str(tmp_path), n_frames=4, spacing=4, run=cfg.Run(data_dir=str(tmp_path / "run-{run_id}")))
    files = {"scan": scan, "meta": cfg.Metadata(background=cfg.Background("median-poisson"))}
    files["find"] = cfg.StreakFinder(streaks=cfg.StreakGrowth(xtol=1.0, vmin=4.0, min_size=1.0, nfa=1), peaks=cfg.Regions(npts=2))
    for name, c in files.items():
        cfg.write(c, tmp_path / f"{name}.json")
    path = {name: str(tmp_path / f"{name}.json") for name in files}
    cli.main(["metadata", path["scan"], path["meta"]])
    assert spark.read.parquet(scan.file("metadata")).count() == 196
    cli.main(["metalist", path["scan"], path["meta"]])
    assert spark.read.parquet(scan.file("metalist", suffix="eigenvalues")).count() == 2
    cli.main(["detect", path["scan"], path["find"]])
    found = spark.read.parquet(scan.file("streaks"))
    lines = {r["index"] for r in found.where("log_p < -10").collect()}
    assert lines == {1, 3, 5, 7}, found.toPandas().to_string()
    cli.main(["compile", str(tmp_path / "all"), scan.file("streaks")])
    assert spark.read.parquet(str(tmp_path / "all")).count() == found.count()
    cli.main(["detect", path["scan"], path["find"], "--frames-only"])
    assert spark.read.csv(scan.file("streaks"), header=True).select(F.count_distinct("index")).first()[0] >= 4
