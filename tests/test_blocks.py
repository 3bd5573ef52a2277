"""Block-layout operators, sources of several kinds of runs, HDF5 through a stand-in for its library, random draws, slopes of the loss."""

import math
import sys
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from streakframe import config as cfg
from streakframe.functions import random
from streakframe.kernels import regions as region_kernel
from streakframe.kernels import streaks as streak_kernel
from streakframe.kernels.structure import Structure
from streakframe.operators import blocks, geometry, indexing, pixels, regions
from streakframe.plans import pipelines
from streakframe.schema import AXES, BLOCK, PANELS, to_block, to_long
from streakframe.sources import hdf, runs
from streakframe.streaming import detect


def stack(spark, frames=5, modules=2, shape=(6, 7), seed=0):
    draw = np.random.default_rng(seed)
    rows = [(f, m, *shape, draw.normal(100, 5, shape).ravel().tolist()) for f in range(frames) for m in range(modules)]
    return spark.createDataFrame(rows, BLOCK)


def meta_of(spark, modules=2, shape=(6, 7)):
    rows = [(m, s, f, (s + f) % 5 != 0, 2.0 + m if f else 0.0, 99.0 + s) for m in range(modules) for s in range(shape[0]) for f in range(shape[1])]
    return spark.createDataFrame(rows, "module int, ss int, fs int, mask boolean, std double, flatfield double")


def values(df):
    return {(r.frame, r.module, r.ss, r.fs): r.value for r in df.collect()}


@pytest.mark.parametrize("method", ["no-scale", "lsq", "robust-lsq"])
def test_both_layouts_have_one_signal(spark, method):
    data, meta = stack(spark), meta_of(spark)
    draw = np.random.default_rng(1)
    fields = spark.createDataFrame([(c, m, s, f, float(draw.normal())) for c in range(3) for m in range(2) for s in range(6) for f in range(7)], "comp int, module int, ss int, fs int, value double")
    scaling = cfg.Scaling(method, good_fields=(0, 2))
    want = values(pipelines.signal(to_long(data), meta, scaling, 0.5, fields))
    got = values(to_long(pipelines.signal_blocks(data, meta, scaling, 0.5, fields)))
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert values(to_long(pipelines.signal_blocks(to_long(data), meta, scaling, 0.5, fields))) == pytest.approx(got)


def test_detection_from_arrays_makes_no_row_of_a_pixel(spark):
    data, meta = stack(spark, modules=1), meta_of(spark, modules=1)
    known = spark.createDataFrame(meta.collect(), meta.schema)
    plan = pipelines.detect_streaks(data, known, cfg.StreakFinder(), modules=1)._jdf.queryExecution().executedPlan().toString()
    frames = plan.split("BroadcastExchange")[0]
    assert "Exchange" not in frames and "Generate" not in frames


def test_streams_of_frames_with_several_modules(spark, tmp_path):
    data, meta = stack(spark), meta_of(spark)
    finder = cfg.StreakFinder(streaks=cfg.StreakGrowth(xtol=1.0, vmin=1.0, min_size=0.5, nfa=1), peaks=cfg.Regions(npts=1))
    want = pipelines.detect_streaks(data, meta, finder).collect()
    whole = blocks.gathered(data)
    whole.write.parquet(str(tmp_path / "frames"))
    stream = detect.detect(spark.readStream.schema(whole.schema).parquet(str(tmp_path / "frames")), blocks.meta_blocks(meta), finder)
    query = stream.writeStream.format("memory").queryName("several").trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: tuple(round(x, 9) for x in r)
    assert want and sorted(map(key, spark.sql("SELECT * FROM several").collect())) == sorted(map(key, want))


def test_regions_stay_in_the_region_of_interest(spark):
    image = np.zeros((8, 8))
    image[1, 1:4] = image[5, 2:7] = 9
    data = spark.createDataFrame([(0, 0, 8, 8, image.ravel().tolist())], BLOCK)
    everywhere, inside = (regions.label(data, Structure((1, 1), 1), 1.0, 2, roi=roi).collect() for roi in (None, (4, 8, 0, 5)))
    assert len(everywhere) == 8 and {(r.ss, r.fs) for r in inside} == {(5, 2), (5, 3), (5, 4)}


def test_tail_probabilities_of_a_batch():
    draw = np.random.default_rng(2)
    n = draw.integers(0, 80, 300)
    k, p = np.array([draw.integers(0, x + 3) for x in n]), draw.choice([0.0, 0.2, 0.9, 1.0], 300)
    one = [region_kernel.log_binomial_tail(int(a), int(b), float(c)) for a, b, c in zip(n, k, p, strict=True)]
    assert np.allclose(region_kernel.log_binomial_tails(n, k, p), one)


def test_p_value_of_a_streaks_own_footprint():
    data = np.random.default_rng(3).random((1, 20, 20)) * 0.3
    data[0, 9, 3:15] = 1
    structure, labeled = Structure((0, 1, 1), 1), data >= 0.4
    peaks = streak_kernel.peak_labels(streak_kernel.detect_peaks(data, labeled, 2, 0.4), data, 2)
    finder = streak_kernel.Finder(data, peaks, structure, 0.4)
    finder.fit_linelets()
    longest = max(finder.detect(1.0, 0), key=len)
    p0 = float((data >= 0.4).mean())
    at = np.stack(np.unravel_index(finder.pixels(longest), data.shape), axis=1)
    ends = region_kernel.line_fit(at, data[tuple(at.T)])
    near = region_kernel.distance(at, ends) < 1.0
    hits = int((near & (data[tuple(at.T)] >= 0.4)).sum())
    want = region_kernel.log_binomial_tail(int(near.sum()), hits, p0)
    assert want < -10 and finder.p_value(longest, 1.0, p0) == pytest.approx(want)


def test_streaks_that_repeat_are_placed_each(spark):
    panels = spark.createDataFrame([(0, "p", 0, 0, 9, 0, 9, 1.0, 2.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)], PANELS)
    s = spark.createDataFrame([(3, 0, 1.0, 1.0, 4.0, 5.0)] * 3 + [(4, 0, 1.0, 1.0, 4.0, 5.0)], "index long, module_id int, x_0 double, y_0 double, x_1 double, y_1 double")
    assert sorted(r["index"] for r in geometry.to_streaks(s, panels).collect()) == [3, 3, 3, 4]


def test_frames_are_numbered_and_missing_ones_are_an_error(spark, tmp_path):
    run = str(tmp_path / "run")
    stack(spark, 6, 1).withColumnRenamed("frame", "row").repartitionByRange(2, "row").write.parquet(run)
    index = runs.build_index(spark, run)
    assert sorted(r.frame for r in runs.load(spark, index, [0, -1, -6]).collect()) == [0, 5]
    for wrong in ([6], [-7], [0, 99]):
        with pytest.raises(IndexError):
            runs.load(spark, index, wrong)
    some = spark.createDataFrame([(2,), (4,)], "frame long")
    assert sorted(r.frame for r in runs.load(spark, index, some).collect()) == [2, 4]


def test_modules_in_folders_and_whole_images(spark, tmp_path):
    for m, n in ((0, 4), (1, 4), (2, 3)):
        stack(spark, n, 1, (3, 3), seed=m).drop("module").withColumnRenamed("frame", "row").withColumn("module", F.lit(0)).coalesce(1).write.parquet(str(tmp_path / f"run-7/m{m}"))
    config = cfg.Run("modules", str(tmp_path / "run-{run_id}/m{module}"), num_modules=2)
    index = runs.open_run(spark, 7, config)
    block = runs.load_modules(spark, index, [1, -1])
    assert sorted((r.frame, r.module) for r in block.collect()) == [(1, 0), (1, 1), (3, 0), (3, 1)]
    with pytest.raises(ValueError):
        runs.open_run(spark, 7, cfg.Run("modules", str(tmp_path / "run-{run_id}/m{module}"), num_modules=3))
    with pytest.raises(ValueError):
        runs.open_run(spark, 7, cfg.Run("tape"))
    rows = [(0, "a", 0, 0, 2, 0, 2, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), (1, "b", 1, 0, 2, 0, 2, 4.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    panels = spark.createDataFrame(rows, PANELS)
    image = runs.assembled(block, panels).where("frame = 3").first()
    got = np.array(image.pixels).reshape(image.n_ss, image.n_fs)
    want = np.zeros((4, 7))
    own = {r.module: np.array(r.pixels).reshape(3, 3) for r in block.where("frame = 3").collect()}
    want[:3, :3], want[1:, 4:] = own[0], own[1]
    assert np.allclose(got, want)


def test_full_images_need_a_geometry(spark, tmp_path):
    stack(spark, 2, 1, (3, 3)).withColumnRenamed("frame", "row").coalesce(1).write.parquet(str(tmp_path / "run-1"))
    scan = cfg.Scan(1, "full", str(tmp_path), run=cfg.Run(data_dir=str(tmp_path / "run-{run_id}")))
    with pytest.raises(ValueError):
        runs.scanned(spark, scan)


def test_insert_survives_a_crash_between_its_renames(spark, tmp_path):
    path = str(tmp_path / "frames")
    block = stack(spark, 4, 1)
    runs.save(block, path)
    (tmp_path / "frames").rename(tmp_path / "frames.old")
    runs.save(block.where("frame = 2").withColumn("n_ss", F.lit(77)), path, "insert")
    assert sorted((r.frame, r.n_ss) for r in spark.read.parquet(path).collect()) == [(0, 6), (1, 6), (2, 77), (3, 6)]
    assert not (tmp_path / "frames.old").exists() and not (tmp_path / "frames.new").exists()


# a stand-in for h5py: files are dictionaries of arrays that stay in memory


class _Set:
    def __init__(self, data):
        self.data = data

    shape = property(lambda self: self.data.shape)

    def __len__(self):
        return len(self.data)

    def __getitem__(self, at):
        return self.data[at]

    def __setitem__(self, at, value):
        self.data[at] = value

    def resize(self, n, axis=0):
        self.data = np.concatenate([self.data, np.zeros((n - len(self.data), *self.data.shape[1:]), self.data.dtype)])


class _File(dict):
    disk: dict = {}

    def __new__(cls, name, mode="r"):
        if mode == "w":
            cls.disk[name] = dict.__new__(cls)
            open(name, "w").close()
        name = name if name in cls.disk else f"{name}.draft"
        return cls.disk[name]

    def __init__(self, name, mode="r"):
        pass

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def close(self):
        pass

    def create_dataset(self, name, shape, maxshape, dtype, chunks=None):
        self[name] = _Set(np.zeros(shape, dtype))
        return self[name]

    def visititems(self, f):
        for name, item in self.items():
            f(name, item)


@pytest.fixture
def h5(monkeypatch):
    _File.disk = {}
    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=_File))
    draw = np.random.default_rng(0)
    for name, n in (("b.h5", 3), ("a.h5", 5)):
        f = dict.__new__(_File)
        f.update({"entry/data": _Set(draw.random((n, 2, 4, 6))), "entry/pulse": _Set(np.arange(n) + 10.0), "entry/energy": _Set(np.array(9.5))})
        f["entry/data"].data[0, 0, 1, 1] = np.nan
        _File.disk[name] = f
    return _File.disk


def read_all(reader):
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_hdf_scan_of_frames_and_a_rectangle(h5):
    options = {"files": "b.h5,a.h5", "dataset": "entry/data", "rows": "2", "values": "entry/pulse", "scalars": "entry/energy"}
    rows = read_all(hdf.HdfReader(options))
    assert len(rows) == 16 and [r["frame"] for r in rows[::2]] == list(range(8)) and {r["energy"] for r in rows} == {9.5}
    first = next(r for r in rows if r["frame"] == 0 and r["module"] == 0)
    assert first["file"] == "a.h5" and first["pulse"] == 10 and first["pixels"][7] == 0.0
    some = read_all(hdf.HdfReader({**options, "frames": "6,-1,1", "roi": "1,3,2,5"}))
    assert sorted({(r["file"], r["row"], r["frame"]) for r in some}) == [("a.h5", 1, 1), ("b.h5", 1, 6), ("b.h5", 2, 7)]
    r = next(r for r in some if r["frame"] == 6 and r["module"] == 1)
    assert (r["n_ss"], r["n_fs"]) == (2, 3) and np.allclose(r["pixels"], h5["b.h5"]["entry/data"].data[1, 1, 1:3, 2:5].ravel())
    with pytest.raises(IndexError):
        hdf.HdfReader({**options, "frames": "8"}).partitions()
    assert hdf.HdfSource({**options}).schema().endswith("pixels array<double>, pulse double, energy double")


def test_hdf_protocol(h5, tmp_path):
    protocol = hdf.Protocol({"data": ["/entry/nothing", "/entry/d.*"], "pulse_id": ["entry/pulse"]}, {"data": "stack", "pulse_id": "sequence"})
    names = {name: hdf.datasets(f) for name, f in h5.items()}
    assert protocol.common_path("data", names) == "entry/data"
    for ending in ("json", "ini"):
        protocol.write(tmp_path / f"p.{ending}")
        assert hdf.Protocol.read(tmp_path / f"p.{ending}") == protocol
    (tmp_path / "wrong.json").write_text('{"paths": {"a": "x"}, "kinds": {"a": "cube"}}')
    with pytest.raises(ValueError):
        hdf.Protocol.read(tmp_path / "wrong.json")


def test_hdf_part_is_written_whole(h5, spark, tmp_path):
    frames = blocks.gathered(stack(spark, 3)).orderBy("frame").toArrow()
    name, count = hdf.write_part(iter(frames.combine_chunks().to_batches()), str(tmp_path), "entry/data")
    assert count == 3 and [p.name for p in tmp_path.iterdir()] == [name.rpartition("/")[2]]
    f = _File(name)
    assert f["entry/data"].shape == (3, 2, 6, 7) and f["frames"].data.tolist() == [0, 1, 2]
    want = {(r.frame, r.module): r.pixels for r in stack(spark, 3).collect()}
    assert np.allclose(f["entry/data"].data[1, 1].ravel(), want[(1, 1)])
    assert hdf.write_part(iter([]), str(tmp_path), "entry/data") is None


def test_hdf_needs_its_library(spark):
    if "h5py" in sys.modules:
        pytest.skip("h5py is installed")
    with pytest.raises(RuntimeError):
        hdf.read_hdf(spark, ["a.h5"], "entry/data")


# random draws and the slope of the loss


@pytest.mark.parametrize(
    ("how", "settings", "mean", "deviation"),
    [
        ("uniform", {"low": 2.0, "high": 4.0}, 3, 2 / 12**0.5), ("normal", {"loc": 1.0, "scale": 2.0}, 1, 2), ("lognormal", {"sigma": 0.5}, math.exp(0.125), None),
        ("exponential", {"scale": 3.0}, 3, 3), ("laplace", {"scale": 1.0}, 0, 2**0.5), ("logistic", {}, 0, math.pi / 3**0.5), ("gumbel", {}, 0.5772, math.pi / 6**0.5),
        ("pareto", {"a": 5.0}, 0.25, None), ("power", {"a": 3.0}, 0.75, None), ("rayleigh", {}, (math.pi / 2) ** 0.5, None), ("weibull", {"a": 2.0}, math.gamma(1.5), None),
        ("triangular", {"left": 0.0, "mode": 1.0, "right": 3.0}, 4 / 3, (7 / 18) ** 0.5), ("gamma", {"shape": 3, "scale": 2.0}, 6, 12**0.5), ("beta", {"a": 2, "b": 3}, 0.4, 0.2),
        ("chisquare", {"df": 5}, 5, 10**0.5), ("f", {"dfnum": 4, "dfden": 10}, 1.25, None), ("standard_t", {"df": 8}, 0, (8 / 6) ** 0.5), ("binomial", {"n": 10, "p": 0.3}, 3, 2.1**0.5),
        ("geometric", {"p": 0.25}, 4, 12**0.5), ("integers", {"low": 0, "high": 10}, 4.5, 8.25**0.5),
    ],
)
def test_draws_have_their_moments_and_do_not_depend_on_tasks(spark, how, settings, mean, deviation):
    df = random.draws(spark, 20_000, ["a", "b"], 5, how, **settings)
    m, s, r = df.agg(F.avg("a"), F.stddev("a"), F.corr("a", "b")).first()
    assert m == pytest.approx(mean, abs=5 * s / 20_000**0.5 + 1e-3) and abs(r) < 0.05
    assert deviation is None or s == pytest.approx(deviation, rel=0.05)
    assert df.where("i = 7").first() == df.repartition(3).where("i = 7").first() != random.draws(spark, 20_000, ["a", "b"], 6, how, **settings).where("i = 7").first() or how in ("integers", "binomial", "geometric")


def test_cauchy_and_shuffles(spark):
    assert random.draws(spark, 20_000, ["a"], 1, "standard_cauchy").agg(F.median("a")).first()[0] == pytest.approx(0, abs=0.05)
    places = [r.id for r in random.shuffled(spark.range(50), 3, "id").orderBy("place").collect()]
    assert sorted(places) == list(range(50)) != places


def test_slope_of_the_loss_is_that_of_nearby_crystals(spark):
    lens = indexing.Lens((0.0, 0.0, -0.2), (-0.002, 0.002, -0.002, 0.002), -0.19)
    patterns = spark.createDataFrame([(0, 0, 0.02, 0.0, 0.02, 0.001), (0, 1, 0.0, 0.03, 0.001, 0.03), (1, 0, 0.01, 0.02, 0.012, 0.02)], "index long, streak_id long, x_0 double, y_0 double, x_1 double, y_1 double")
    basis = np.diag([0.12, 0.13, 0.15])
    xtal = lambda *moved: spark.createDataFrame([(k, *map(float, (basis + m).ravel())) for k, m in enumerate(moved)], "index long, " + ", ".join(f"{c} double" for c in AXES))
    miller = spark.createDataFrame([(0, 0, 1, 0, 0), (0, 1, 0, 1, 0), (1, 0, 1, 1, 0)], "index long, streak_id long, h int, k int, l int")
    slope = {r["index"]: np.array([r[c] for c in AXES]) for r in indexing.loss_gradient(patterns, miller, xtal(0 * basis, 0 * basis), lens, loss="l2").collect()}
    assert set(slope) == {0, 1} and all(np.abs(x).max() > 0 for x in slope.values())

    def loss(step):
        found = indexing.per_streak(indexing.model_loss(patterns, miller, xtal(step, step), lens, loss="l2"))
        return {r["index"]: r.loss for r in indexing.per_pattern(found, xtal(step, step)).collect()}

    way = np.random.default_rng(0).normal(size=(3, 3)) * 1e-5
    up, down = loss(way), loss(-way)
    for k in (0, 1):
        assert (up[k] - down[k]) / 2 == pytest.approx(float(slope[k] @ way.ravel()), rel=1e-3)


def test_lists_of_regions(spark):
    rows = [(f, r, 0, r, x, 1.0) for f in range(2) for r in range(1, 4 + f) for x in range(r)]
    found = spark.createDataFrame(rows, "frame long, region long, module int, ss int, fs int, value double")
    size = lambda df: {(r.frame, r.region): r["count"] for r in df.groupBy("frame", "region").count().collect()}
    assert size(regions.take_regions(found, [-1, 2])) == {(0, 1): 3, (0, 2): 2, (1, 1): 4, (1, 2): 2}
    assert size(regions.keep_regions(found, F.col("region") != 2)) == {(0, 1): 1, (0, 2): 3, (1, 1): 1, (1, 2): 3, (1, 3): 4}
    assert size(regions.append_regions(found, found.where("region = 1"))) == {**size(found), (0, 4): 1, (1, 5): 1}
