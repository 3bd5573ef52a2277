"""Sources, configuration, plans, streams and the operators that no SQL covers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from streakframe import config as cfg
from streakframe.functions import vectors as v
from streakframe.kernels.structure import Structure
from streakframe.operators import geometry, groups, indexing, pixels, raster, regions, stats
from streakframe.plans import pipelines
from streakframe.schema import AXES, BLOCK, to_block, to_long
from streakframe.sources import geom, hdf, runs
from streakframe.streaming import detect

GEOM = """
; a detector of two panels
photon_energy = 9.5 keV
clen = 120 mm
res = 13333.3
coffset = 0.01
dim0 = %
dim1 = ss
dim2 = fs
mask_good = 0x0
mask_bad = 0xff
rigid_group_q0 = a0,a1
a0/min_fs = 0
a0/max_fs = 3
a0/min_ss = 0
a0/max_ss = 3
a0/fs = +1.0x -0.2y
a0/ss = y
a0/corner_x = 0
a0/corner_y = -4
a1/min_fs = 0
a1/max_fs = 3
a1/min_ss = 4
a1/max_ss = 7
a1/fs = x
a1/ss = +1.0y
a1/corner_x = 550
a1/corner_y = 2
bad1/min_x = -3
bad1/panel = a1
"""


def test_geom():
    g = geom.parse(GEOM)
    assert list(g.panels) == ["a0", "a1"] and g.shape == (8, 4) and g.bad["bad1"]["panel"] == "a1"
    assert geom.direction("+1.0x -0.2y") == (1.0, -0.2, 0.0) and geom.direction("y") == (0, 1, 0) and geom.direction("-z") == (0, 0, -1)
    assert geom.quantity("120 mm") == pytest.approx(0.12) and geom.quantity("9.5 keV") == 9500 and geom.quantity("1 A") == geom.EV_ANGSTROM
    assert g.masks[0] == {"good": 0, "bad": 255} and g.panels["a1"].number("res") == pytest.approx(13333.3)
    with pytest.raises(ValueError):
        geom.parse("bad0/panel = nobody\n")


def test_geom_to_panels(spark, tmp_path):
    (tmp_path / "d.geom").write_text(GEOM)
    panels = geom.read_geom(spark, str(tmp_path / "d.geom"))
    assert panels.count() == 2 and geometry.pixel_map(panels).count() == 32
    b = geometry.bounds(panels).first()
    assert b.x_min == pytest.approx(0.5) and b.x_max == pytest.approx(553.5)
    s = spark.createDataFrame([(0, 0, 1.0, 1.0, 2.0, 3.0), (1, 0, 1.0, 5.0, 3.0, 6.0)], "index long, module_id int, x_0 double, y_0 double, x_1 double, y_1 double")
    out = {r["index"]: r for r in geometry.to_streaks(s, panels).collect()}
    assert out[1].x_0 == pytest.approx(551) and math.hypot(out[1].x_1 - out[1].x_0, out[1].y_1 - out[1].y_0) == pytest.approx(math.hypot(2, 1))


def test_config_round_trips(tmp_path):
    c = cfg.StreakFinder(center=(1.5, 2.5), scaling=cfg.Scaling("lsq", good_fields=(0, 2)))
    for name in ("c.json", "c.ini"):
        cfg.write(c, tmp_path / name)
        assert cfg.read(cfg.StreakFinder, tmp_path / name) == c
    assert cfg.replace(c, std_min=2.0).std_min == 2.0 and cfg.Roi(1, 4, 0, 2).to_roi() == (0, 2, 1, 4) and cfg.Roi(1, 4, 0, 2).size() == 6
    with pytest.raises(KeyError):
        cfg.from_dict(cfg.Mask, {"nothing": 1})
    with pytest.raises(ValueError):
        cfg.write(c, tmp_path / "c.txt")
    assert cfg.Scan(3, output_dir="o").file("streaks", 7, "x") == "o/scan_3_streaks_f0007_x"


def blocks(spark, n=6, size=12, seed=3):
    draw = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        image = draw.normal(100, 1, (size, size))
        image[3 + k % 3, 2:10] += 30
        rows.append((k, 0, size, size, image.ravel().tolist()))
    return spark.createDataFrame(rows, BLOCK)


def test_layouts(spark):
    b = blocks(spark)
    back = {r.frame: r.pixels for r in to_block(to_long(b)).collect()}
    assert back == {r.frame: r.pixels for r in b.collect()}
    nan = spark.createDataFrame([(0, 0, 1, 2, [float("nan"), 1.0])], BLOCK)
    assert [r.value for r in to_long(nan).orderBy("fs").collect()] == [0.0, 1.0]


def test_runs(spark, tmp_path):
    folder = str(tmp_path / "run-7")
    data = blocks(spark).withColumn("row", F.col("frame")).select("row", "module", "n_ss", "n_fs", "pixels").coalesce(1)
    data.where("row < 4").write.mode("append").parquet(folder)
    data.where("row >= 4").write.mode("append").parquet(folder)
    run = cfg.Run(data_dir=str(tmp_path / "run-{run_id}"), file_pattern=r".*\.parquet")
    index = runs.open_run(spark, 7, run, str(tmp_path / "cache"))
    assert sorted(r.frame for r in index.collect()) == list(range(6))
    again = runs.frame_index(spark, folder, str(tmp_path / "cache"))
    assert again.count() == 6
    part = runs.load(spark, index, [1, 5], (2, 5, 1, 11))
    assert part.count() == 2 and {(r.n_ss, r.n_fs, len(r.pixels)) for r in part.collect()} == {(3, 10, 30)}
    assert sorted(r["count"] for r in runs.split(index, 4).groupBy("chunk").count().collect()) == [1, 1, 2, 2]
    with pytest.raises(ValueError):
        runs.open_run(spark, 7, cfg.Run(facility="none"))
    out = str(tmp_path / "saved")
    block = blocks(spark)
    runs.save(block, out)
    runs.save(block.where("frame = 2").withColumn("n_ss", F.lit(99)), out, "insert")
    rows = {r.frame: r.n_ss for r in spark.read.parquet(out).collect()}
    assert len(rows) == 6 and rows[2] == 99 and rows[3] == 12
    assert runs.compile_tables(spark, [out], str(tmp_path / "all")).count() == 6


def test_hdf_protocol():
    p = hdf.Protocol({"data": ["/entry/data_[0-9]+", "/raw"]}, {"data": "stack"})
    assert p.find_path("data", ["raw", "entry/data_1"]) == "entry/data_1" and p.kind("data") == "stack" and p.kind("x") == "none"
    assert p.common_path("data", {"a": ["raw"], "b": ["raw"]}) == "raw"
    with pytest.raises(ValueError):
        p.common_path("data", {"a": ["raw"], "b": []})


def test_groups_errors(spark):
    df = spark.createDataFrame([(1, "a"), (3, "b")], "index long, v string")
    with pytest.raises(KeyError):
        groups.take(df, [2])
    with pytest.raises(ValueError):
        groups.concatenate([])
    with pytest.raises(ValueError):
        groups.concatenate([df.where("index > 9")])
    assert [r["index"] for r in groups.iloc(df, [-1]).collect()] == [0]
    two = groups.concatenate([df, df]).orderBy("index").collect()
    assert [r["index"] for r in two] == [1, 3, 4, 6]
    rows = spark.createDataFrame([(0, 5), (1, 5), (2, 6), (3, 7)], "n long, index long")
    with pytest.raises(Exception, match="several keys"):
        groups.reshape(rows, 2, "n").collect()


def test_updates_are_checked(spark):
    df = spark.createDataFrame([(0, 0, 0, True, 1.0, 1.0)], "module int, ss int, fs int, mask boolean, std double, flatfield double")
    with pytest.raises(ValueError):
        pixels.import_mask(df, df, "other")
    with pytest.raises(ValueError):
        pixels.update_mask(df, df, "other")
    with pytest.raises(ValueError):
        raster.kernel("other", F.lit(1.0))
    assert pixels.update_mask(df, df, "all-bad").first().mask is False and pixels.reset_mask(df).first().mask is True


def test_raster_in_three_dimensions(spark):
    s = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 4.0, 3.0, 2.0, 1.5), (0, 1.0, 1.0, 1.0, 4.0, 3.0, 2.0, 0.0)], "frame long, x_0 double, y_0 double, z_0 double, x_1 double, y_1 double, z_1 double, width double")
    got = {(r.z, r.ss, r.fs): r.value for r in raster.draw_lines(s, (5, 6, 7), 2.0, "gaussian").collect()}
    a, b = np.array([1.0, 1, 1]), np.array([2.0, 3, 4])
    for at in np.ndindex(5, 6, 7):
        p = np.array(at, float)
        t = np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
        x = np.linalg.norm(p - a - t * (b - a)) / 1.5
        if x < 0.999999:
            assert got[at] == pytest.approx(2 * math.exp(-4.5 * x * x) / math.sqrt(2 * math.pi))
        elif x > 1.000001:
            assert at not in got


def test_pca_rebuilds_whitefields(spark):
    draw = np.random.default_rng(5)
    base, mode = draw.random(16) + 10, draw.normal(size=16)
    fields = [(k, 0, p // 4, p % 4, float(base[p] + w * mode[p])) for k, w in enumerate((-1.0, 0.5, 0.5)) for p in range(16)]
    wf = spark.createDataFrame(fields, "wf long, module int, ss int, fs int, value double")
    flat = wf.groupBy("module", "ss", "fs").agg(F.avg("value").alias("value"))
    eigen, ratios = stats.pca(wf, flat)
    values = [r.ratio for r in ratios.orderBy("comp").collect()]
    assert values == sorted(values) and values[-1] == pytest.approx(1)
    top = eigen.where("comp = 2")
    data = wf.withColumnRenamed("wf", "frame")
    rest = data.join(flat.withColumnRenamed("value", "b"), ["module", "ss", "fs"]).withColumn("value", F.col("value") - F.col("b"))
    rebuilt = stats.project(stats.lsq(rest, top), top, flat).withColumnRenamed("value", "r").join(data, ["frame", "module", "ss", "fs"])
    assert rebuilt.agg(F.max(F.abs(F.col("r") - F.col("value")))).first()[0] < 1e-9
    with pytest.raises(ValueError):
        stats.pca(wf.where("wf = 0"), flat)


def test_pca_of_more_whitefields_than_pixels(spark, monkeypatch):
    x = np.random.default_rng(6).random((40, 6)) * np.arange(1, 7)
    wf = spark.createDataFrame([(k, 0, p // 3, p % 3, float(x[k, p])) for k in range(40) for p in range(6)], "wf long, module int, ss int, fs int, value double")
    flat, solved, solve = wf.groupBy("module", "ss", "fs").agg(F.avg("value").alias("value")), [], np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda a: solved.append(a.shape) or solve(a))
    eigen, ratios = stats.pca(wf, flat)
    assert solved == [(6, 6)]  # grows with pixels, not with whitefields
    u, size, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    u, size = u[:, ::-1], size[::-1]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(6)])
    want = np.concatenate([np.zeros((34, 6)), u.T @ (x - x.mean(axis=0))])
    got = np.full((40, 6), np.nan)
    for r in eigen.collect():
        got[r.comp, 3 * r.ss + r.fs] = r.value
    assert np.allclose(got, want)
    assert np.allclose([r.ratio for r in ratios.orderBy("comp").collect()], [0] * 34 + list(size**2 / (size**2).sum()))


def test_detection_finds_the_lines_and_streams_alike(spark, tmp_path):
    b = blocks(spark)
    meta = pixels.reset_mask(stats.background(to_long(blocks(spark, 6, seed=9)).withColumn("value", F.lit(100.0)), "mean-poisson").withColumn("std", F.lit(2.0)))
    finder = cfg.StreakFinder(streaks=cfg.StreakGrowth(xtol=1.0, vmin=5.0, min_size=1.0, nfa=1), peaks=cfg.Regions(npts=2))
    found = pipelines.detect_streaks(to_long(b), meta, finder)
    rows = found.collect()
    assert {r["index"] for r in rows} == set(range(6))
    assert all(abs(r.y_0 - (3 + r["index"] % 3)) < 0.6 for r in rows if r.log_p < -20)
    frames = str(tmp_path / "frames")
    b.write.parquet(frames)
    arrays = meta.groupBy("module").agg(F.sort_array(F.collect_list(F.struct("ss", "fs", "flatfield", "std", "mask"))).alias("p"))
    arrays = arrays.select("module", *(F.col(f"p.{c}").alias(c) for c in ("flatfield", "std", "mask")))
    stream = detect.detect(spark.readStream.schema(BLOCK).parquet(frames), arrays, finder)
    q = stream.writeStream.format("memory").queryName("streaks").trigger(availableNow=True).start()
    q.awaitTermination(120)
    live = spark.sql("SELECT * FROM streaks").collect()
    key = lambda r: (r["index"], round(r.x_0, 6), round(r.y_0, 6), round(r.log_p, 6))
    assert sorted(map(key, live)) == sorted(map(key, rows))
    assert pipelines.centred(found, (6.0, 6.0)).count() <= len(rows)
    assert pipelines.detect_hits(found, 0, spark.createDataFrame([(0, 77)], "frame long, pulse_id long")).where("index = 0").first().pulse_id == 77


def test_scaling_takes_a_varying_background_out(spark):
    draw = np.random.default_rng(4)
    mode = draw.normal(size=36)
    rows = [(k, 0, p // 6, p % 6, float(50.0 + w * mode[p])) for k, w in enumerate((0.5, -1.0, 2.0)) for p in range(36)]
    data = spark.createDataFrame(rows, "frame long, module int, ss int, fs int, value double")
    meta = spark.createDataFrame([(0, p // 6, p % 6, True, 1.0, 50.0) for p in range(36)], "module int, ss int, fs int, mask boolean, std double, flatfield double")
    fields = spark.createDataFrame([(0, 0, p // 6, p % 6, float(mode[p])) for p in range(36)], "comp int, module int, ss int, fs int, value double")
    for method in ("lsq", "robust-lsq"):
        out = pipelines.signal(data, meta, cfg.Scaling(method), 0.0, fields)
        assert out.agg(F.max(F.abs("value"))).first()[0] < 1e-9
    assert pipelines.signal(data, meta, cfg.Scaling(), 0.0).agg(F.max(F.abs("value"))).first()[0] > 1
    assert pipelines.sample_frames(data, 2).count() == 2


def test_rotations_are_proper(spark):
    one = spark.range(1)
    m = v.euler_matrix(F.lit(0.3), F.lit(1.1), F.lit(2.0))
    r = np.array(one.select(*v.flat(m)).first()).reshape(3, 3)
    assert r @ r.T == pytest.approx(np.eye(3)) and np.linalg.det(r) == pytest.approx(1)
    half = v.tilt_matrix(F.lit(math.pi), F.lit(1.0), F.lit(0.4))
    theta, alpha, beta = one.select(*v.tilt_angles(half)).first()
    assert theta == pytest.approx(math.pi) and (alpha, beta) in (pytest.approx((1.0, 0.4)), pytest.approx((math.pi - 1, 0.4 - math.pi)))
    inv = v.matmul(v.inverse(m), m)
    assert np.array(one.select(*v.flat(inv)).first()).reshape(3, 3) == pytest.approx(np.eye(3))
    assert one.select(*v.from_spherical(*v.to_spherical((F.lit(1.0), F.lit(2.0), F.lit(-2.0))))).first() == pytest.approx((1, 2, -2))


LENS = indexing.Lens((0.0, 0.0, -0.11), (-0.0005, 0.0005, -0.0005, 0.0005), -0.1)


def test_rotations_of_candidates_reach_the_arc(spark):
    s = spark.createDataFrame([(0, 1, 0.020, 0.010, 0.021, 0.012)], "index long, streak_id long, x_0 double, y_0 double, x_1 double, y_1 double")
    uca = indexing.patterns_to_uca(s, LENS)
    u = uca.first()
    k = np.array([u.kx, u.ky, u.kz])
    assert np.linalg.norm(k) == pytest.approx(1) and u.min_res < u.max_res
    size = math.sqrt((u.min_res + u.max_res) / 2)
    rlp = spark.createDataFrame([(0, 1, 0, 0, size, 0.0, 0.0), (0, 0, 1, 0, 0.0, 5.0, 0.0)], "index long, h int, k int, l int, qx double, qy double, qz double")
    pairs = indexing.candidates(rlp, uca)
    assert [r.h for r in pairs.collect()] == [1]
    curve = indexing.rotograms(pairs, 25).orderBy("seg").collect()
    assert len(curve) == 24
    targets = []
    for r in curve:
        p = np.array([r.x_0, r.y_0, r.z_0])
        theta = 4 * math.tan(np.linalg.norm(p))
        n = p / np.linalg.norm(p)
        cross = np.array([[0, -n[2], n[1]], [n[2], 0, -n[0]], [-n[1], n[0], 0]])
        turn = math.cos(theta) * np.eye(3) + math.sin(theta) * cross + (1 - math.cos(theta)) * np.outer(n, n)
        targets.append(min((turn @ [size, 0, 0], turn.T @ [size, 0, 0]), key=lambda q: abs(np.linalg.norm(k - q) - 1)))
    targets = np.array(targets)
    assert np.ptp(targets, axis=0).max() < 1e-6 and np.linalg.norm(k - targets[0]) == pytest.approx(1)


def test_refined_peaks_and_solutions(spark):
    maps = spark.createDataFrame([(0, 10, 12, 10, 5.0), (0, 10, 13, 10, 5.0), (0, 2, 2, 2, 1.0)], "index long, z int, y int, x int, value double")
    peaks = indexing.to_peaks(maps, 0.5, 5)
    assert peaks.count() == 2
    tilts = indexing.refine_peaks(peaks, maps, 21, Structure((1, 1, 1), 1))
    r = tilts.first()
    assert (r.ax, r.ay, r.az) == pytest.approx((0, 1, 0)) and r.theta == pytest.approx(4 * math.tan(0.25))
    xtal = spark.createDataFrame([(0, *np.eye(3).ravel().tolist())], "index long, " + ", ".join(f"{c} double" for c in AXES))
    basis = np.array(indexing.solutions(tilts, xtal).select(*AXES).first()).reshape(3, 3)
    assert basis @ basis.T == pytest.approx(np.eye(3)) and basis[1] == pytest.approx([0, 1, 0])
    assert indexing.rotogrid(spark, 3).count() == 27


def test_source_lines_meet_the_laue_condition(spark):
    wide = indexing.Lens((0.0, 0.0, -0.1), (-0.02, 0.02, -0.02, 0.02), 0.0)
    draw = np.random.default_rng(8)
    rows = [(0, 1, k, 0, *(draw.normal(size=3) * [0.15, 0.15, 0.02]).tolist()) for k in range(200)]
    rlp = spark.createDataFrame(rows, "index long, h int, k int, l int, qx double, qy double, qz double")
    out = indexing.source_lines(rlp, wide).collect()
    assert out
    for r in out:
        kin, q = np.array([r.kx, r.ky, r.kz]), np.array([r.qx, r.qy, r.qz])
        assert np.linalg.norm(kin) == pytest.approx(1) and abs(np.linalg.norm(kin + q) - 1) < 1e-4


def test_hkl_boxes(spark):
    xtal = spark.createDataFrame([(0, 0.1, 0.0, 0.0, 0.0, 0.1, 0.0, 0.0, 0.0, 0.1)], "index long, " + ", ".join(f"{c} double" for c in AXES))
    q = lambda x: spark.createDataFrame([(0, 1, x, 0.0, 0.05)], "index long, streak_id long, qx double, qy double, qz double")
    box = indexing.hkl_bounds(q(0.12), q(0.31), xtal)
    b = box.first()
    assert (b.h_min, b.h_max, b.k_min, b.k_max, b.l_min, b.l_max) == (1, 4, 0, 0, 0, 1)
    offsets = indexing.hkl_offsets(box)
    miller = spark.createDataFrame([(0, 1, 1, 1)], "index long, h int, k int, l int")
    assert indexing.offset(miller, offsets).count() == offsets.count() == 6 * 2 * 4


def test_region_errors_and_streak_table(spark):
    b = blocks(spark, 2)
    found = regions.label(b, Structure((1, 1), 1), 110.0, 3)
    table = regions.to_streaks(regions.measures(found))
    assert table.columns == ["index", "module_id", "x_0", "y_0", "x_1", "y_1"] and table.count() == 2
    assert regions.ellipse_fit(regions.measures(found)).where("a > 0").count() == 2


def test_true_triples_have_the_least_loss(spark):
    """Streaks made from a crystal: the triple that made one misses the pupil least."""
    wide = indexing.Lens((0.0, 0.0, -0.2), (-0.002, 0.002, -0.002, 0.002), -0.19)
    basis = np.diag([0.12, 0.13, 0.15])
    low, high = wide.kin_min[:2], wide.kin_max[:2]
    rows = []
    for k, hkl in enumerate([(1, 0, 0), (0, -1, 0), (1, 1, 0), (-2, 1, 0), (0, 2, 0)]):
        q = np.array(hkl) @ basis
        # k in on the Bragg plane, within the pupil where it can be
        line = [kin for kin in (np.array([a, b, math.sqrt(1 - a * a - b * b)]) for a in np.linspace(low[0], high[0], 41) for b in np.linspace(low[1], high[1], 41)) if abs(kin @ q + q @ q / 2) < 0.02]
        kin = np.array(line[len(line) // 2]) if line else np.array([0.0, 0.0, 1.0])
        ends = []
        for d in (-0.0005, 0.0005):
            kout = kin + q + d * np.array([-q[1], q[0], 0]) / np.linalg.norm(q)
            ends += [0.19 * kout[0] / kout[2], 0.19 * kout[1] / kout[2]]
        rows.append((0, k, *map(float, ends)))
    patterns = spark.createDataFrame(rows, "index long, streak_id long, x_0 double, y_0 double, x_1 double, y_1 double")
    xtal = spark.createDataFrame([(0, *map(float, basis.ravel()))], "index long, " + ", ".join(f"{c} double" for c in AXES))
    miller = indexing.init_miller(patterns, xtal, wide)
    losses = indexing.model_loss(patterns, miller, xtal, wide, 3)
    best = {r.streak_id: r for r in indexing.best_hkl(losses).collect()}
    each = {r.streak_id: r.loss for r in indexing.per_streak(losses).collect()}
    assert set(best) == set(each) == set(range(5)) and all(best[k].loss == each[k] for k in each)
    assert (best[0].h, best[0].k) == (1, 0) and (best[1].h, best[1].k) == (0, -1)
    assert indexing.keep_best_streaks(losses, 0.5).count() == 3
    assert indexing.sample_points(patterns, 4, seed=1).collect() == indexing.sample_points(patterns, 4, seed=1).collect()


def test_random_tables(spark):
    from streakframe.functions import random

    m = np.array([list(r)[1:] for r in random.rotations(spark, 5, 3).collect()]).reshape(5, 3, 3)
    assert np.allclose(m @ m.transpose(0, 2, 1), np.eye(3)) and np.allclose(np.linalg.det(m), 1)
    assert random.arrays(spark, 4, ["a", "b"], 1, "beta", a=2.0, b=3.0).where("a > 0 and a < 1").count() == 4
    assert random.orientations(spark, np.eye(3).tolist(), 3, 2).count() == 3


def test_positional_zip(spark):
    a = spark.createDataFrame([(3,), (1,)], "x int")
    one = spark.createDataFrame([("z",)], "y string")
    assert sorted((r.position, r.x, r.y) for r in groups.positional_zip(a, ["x"], one, ["y"]).collect()) == [(0, 1, "z"), (1, 3, "z")]
    with pytest.raises(ValueError):
        groups.positional_zip(a, ["x"], a.union(a), ["x"])
