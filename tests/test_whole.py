"""Queries that do the whole job: no region, segment, frame, streak or key is left out."""

import math

import numpy as np
import pytest

from streakframe import config as cfg
from streakframe.functions import vectors as v
from streakframe.kernels.structure import Structure
from streakframe.operators import groups, indexing, raster, regions
from streakframe.plans import pipelines
from streakframe.queries import QUERIES
from streakframe.schema import AXES

SF = "/root/testdata/sf0.001"


def test_every_region_has_its_fits(spark):
    wanted = {(r.frame, r.region) for r in QUERIES["label_regions"](spark, SF).select("frame", "region").distinct().collect()}
    for name in ("line_fit", "ellipse_fit", "p_values"):
        rows = QUERIES[name](spark, SF).select("frame", "region").collect()
        assert len(rows) == len(wanted) and {tuple(r) for r in rows} == wanted, name


@pytest.mark.parametrize("noise", [0.0, 1e-16, -1e-16])
def test_fits_along_an_axis_do_not_turn_with_rounding(spark, noise):
    rows = [(0, 1, 3.0, 2.0, 2 / 3, 0.0, noise), (0, 2, 3.0, 2.0, 0.0, 2 / 3, noise), (0, 3, 1.0, 1.0, 0.5, 0.5 + noise, 0.0)]
    measured = spark.createDataFrame(rows, "frame long, region long, cx double, cy double, xx double, yy double, xy double")
    half, round_ = math.sqrt(4 * math.log(2) * 2 / 3), math.sqrt(2 * math.log(2) * 1)
    lines = {r.region: (r.x_0, r.y_0, r.x_1, r.y_1) for r in regions.line_fit(measured).collect()}
    assert np.allclose(lines[1], (3 + half, 2, 3 - half, 2)) and np.allclose(lines[2], (3, 2 + half, 3, 2 - half)) and np.allclose(lines[3], (1 + round_, 1, 1 - round_, 1))
    assert all(abs(r.theta) < 1e-12 for r in regions.ellipse_fit(measured).collect())


def test_losses_by_hand(spark):
    lens = indexing.Lens((0.0, 0.0, -0.2), (-0.002, 0.002, -0.002, 0.002), -0.19)
    # on the plane k_x = -0.3: (-0.3, 0.2, 0.9); from (0, 0.2, 0.9) on by s = -0.06 / (0.85 + sqrt(0.85))
    kin, s = np.array([0.1, 0.2, 0.9]), -0.06 / (0.85 + math.sqrt(0.85))
    rows = [(0, 0, 0, 1, 0, 0, 0.6, 0.0, 0.0, *map(float, kin))]
    pairs = spark.createDataFrame(rows, "index long, streak_id long, point int, h int, k int, l int, qx double, qy double, qz double, kin_x double, kin_y double, kin_z double")
    line = pairs.select(*(x.alias(c) for x, c in zip(indexing.source_line(v.columns("kin_x", "kin_y", "kin_z"), v.columns("qx", "qy", "qz")), "xyz", strict=True))).first()
    assert np.allclose(tuple(line), (-0.3, 0.2 * (1 - s), 0.9 * (1 - s)))
    edge = 0.002 / math.sqrt(2 * 0.002**2 + 0.2**2)
    for f, by in ((indexing.pupil_loss, edge), (indexing.line_loss, -edge)):
        target = np.array([by, edge, math.sqrt(1 - 2 * edge**2)])
        assert np.isclose(f(pairs, lens).first().loss, np.abs(target - kin).sum()), f.__name__
        assert np.isclose(f(pairs, lens, "l2").first().loss, ((target - kin) ** 2).sum()), f.__name__


def test_model_loss_by_either_projector_and_streaks_in_the_shell(spark):
    lens = indexing.Lens((0.0, 0.0, -0.2), (-0.002, 0.002, -0.002, 0.002), -0.19)
    patterns = spark.createDataFrame([(0, 0, 0.02, 0.0, 0.02, 0.001), (0, 1, 0.0, 0.03, 0.001, 0.03)], "index long, streak_id long, x_0 double, y_0 double, x_1 double, y_1 double")
    xtal = spark.createDataFrame([(0, *map(float, np.diag([0.12, 0.13, 0.15]).ravel()))], "index long, " + ", ".join(f"{c} double" for c in AXES))
    miller = spark.createDataFrame([(0, 0, 1, 0, 0), (0, 0, 1, 1, 0), (0, 1, 0, 1, 0)], "index long, streak_id long, h int, k int, l int")
    pupil, line = ({tuple(r)[:5]: r.loss for r in indexing.model_loss(patterns, miller, xtal, lens, projector=p).collect()} for p in ("pupil", "line"))
    assert pupil.keys() == line.keys() and len(pupil) == 3 and pupil != line
    with pytest.raises(ValueError):
        indexing.model_loss(patterns, miller, xtal, lens, projector="plane")
    # a streak with one triple beyond the shell is out with all of its triples
    for q_abs, ids in ((0.15, [1]), (0.2, [0, 0, 1]), (0.1, [])):
        assert sorted(r.streak_id for r in indexing.keep_in_shell(miller, xtal, q_abs).collect()) == ids


def test_every_segment_is_drawn_on_every_frame(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_suppkey = 4").toPandas()
    want, (ss, fs) = np.zeros((12, 60)), np.mgrid[:12, :60]
    for r in li.itertuples():
        x, y, ax, ay = r.l_quantity, 100 * r.l_discount, 1 + r.l_linenumber, 100 * (r.l_tax - r.l_discount)
        t = np.clip(((fs - x) * ax + (ss - y) * ay) / (ax * ax + ay * ay), 0, 1)
        far = np.hypot(fs - x - t * ax, ss - y - t * ay) / 1.5
        want += np.where(far <= 1, 15 / 16 * (1 - far**2) ** 2, 0)
    for name, base, times in (("draw_lines", 0, 2), ("draw_onto", 1, 1)):
        got = np.full((12, 60), float(base))
        for r in QUERIES[name](spark, SF).where("frame = 4").collect():
            got[r.ss, r.fs] = r.value
        assert np.allclose(got, base + times * want, atol=2e-6), name
    assert QUERIES["draw_onto"](spark, SF).count() == 720 * spark.read.parquet(f"{SF}/supplier.parquet").count()


def test_every_supplier_is_a_streak_and_patterns_grow_with_them(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    caps = QUERIES["uncertainty_caps"](spark, sf).toPandas()
    assert len(caps) == spark.read.parquet(f"{sf}/supplier.parquet").count() == 100 and caps["index"].nunique() == 10
    assert {r[0] for r in QUERIES["index_patterns"](spark, sf).select("index").distinct().collect()} == set(caps["index"])


def test_every_frame_has_its_background(spark):
    frames = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    got = QUERIES["project_background"](spark, SF)
    assert frames > 50 and got.count() == 64 * frames and got.select("frame").distinct().count() == frames


@pytest.mark.parametrize(("size", "spacing"), [(4, 4), (4, 3), (2, 5), (9, 4)])
def test_whitefields_of_windows_are_those_of_each_window(spark, size, spacing):
    rows = [(f, m, 0, x, float((7 * f + 3 * m + 5 * x * f) % 11 + 1)) for f in range(13) for m in range(2) for x in range(2)]
    data = spark.createDataFrame(rows, "frame long, module int, ss int, fs int, value double")
    config = cfg.Metadata(background=cfg.Background("mean-poisson"))
    fields = {tuple(r)[:4]: r.value for r in pipelines.create_metalist(data, 13, size, spacing, config)[1].select("wf", "module", "ss", "fs", "value").collect()}
    sets = {}
    for r in groups.windows_of(spark, 13, size, spacing).collect():
        sets.setdefault(r.window, set()).add(r.frame)
    want = {(w, m, 0, x): np.mean([r[4] for r in rows if r[0] in fs and r[1] == m and r[3] == x]) for w, fs in sets.items() for m in range(2) for x in range(2)}
    assert fields.keys() == want.keys() and all(np.isclose(fields[k], want[k]) for k in want)


def test_metalist_takes_all_frames(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    assert QUERIES["create_metalist"](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count() // 25


def test_every_order_and_customer_is_looked_up(spark):
    orders, lineitem, customer = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem", "customer"))
    wanted = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey, "left_semi").count()
    assert QUERIES["get_index"](spark, SF).count() == wanted
    rows = QUERIES["positional_zip"](spark, SF).toPandas()
    assert sorted(rows.position) == list(range(customer.count())) and rows.richer.is_unique and rows.c_name.is_unique


@pytest.mark.parametrize("name", ["draw_lines", "draw_lines_max", "draw_lines_gaussian", "accumulate_lines", "pattern_image", "draw_onto"])
def test_drawing_shuffles_segments_and_not_their_pixels(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    drawn = plan[plan.index("MapInArrow") :]
    assert "Aggregate" not in plan and "Generate" not in drawn.split("Join")[0] and drawn.count("RepartitionByExpression [frame") == 1


@pytest.mark.parametrize(("inner", "outer"), [("max", "sum"), ("sum", "max")])
def test_frames_and_terms_that_go_on_over_batches(spark, inner, outer):
    draw = np.random.default_rng(3)
    rows = [(f, t, *draw.uniform(-2, 12, 4).tolist(), float(w)) for f in (None, 0, 3, 2**40) for t in (None, 1, 5) for w in draw.uniform(-0.5, 2, 30)]
    rows += [(9, 1, 400.0, 400.0, 401.0, 400.0, 1.0), (0, 1, float("nan"), 1.0, 2.0, 3.0, 1.0), (0, 1, None, 1.0, 2.0, 3.0, 1.0)]  # nothing in the image
    df = spark.createDataFrame(rows, "frame long, term int, x_0 double, y_0 double, x_1 double, y_1 double, width double")
    ss, fs = np.mgrid[:9, :11]
    want = {}
    for f, t, *ends, w in rows:
        if w > 0 and None not in ends:
            (x, y), (ax, ay) = ends[:2], (ends[2] - ends[0], ends[3] - ends[1])
            along = np.clip(((fs - x) * ax + (ss - y) * ay) / (ax * ax + ay * ay), 0, 1)
            far = np.hypot(fs - x - along * ax, ss - y - along * ay) / w
            for at in zip(*np.nonzero(far <= 1), strict=True):
                want.setdefault((f, *map(int, at)), {}).setdefault(t, []).append(1 - far[at])
    how = {"sum": sum, "max": max}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {tuple(r)[:3]: r.value for r in raster.accumulate_lines(df, (9, 11), 1.0, "triangular", inner, outer).collect()}
        lines = {tuple(r)[:3]: r.value for r in raster.draw_lines(df, (9, 11), 1.0, "triangular", inner).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() == lines.keys()
    assert all(np.isclose(got[k], how[outer](how[inner](v) for v in terms.values())) for k, terms in want.items())
    assert all(np.isclose(lines[k], how[inner](x for v in terms.values() for x in v)) for k, terms in want.items())


def test_patterns_are_indexed_without_a_shuffle_of_cells(spark):
    plan = QUERIES["index_patterns"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    after = plan.split("RepartitionByExpression [index")
    assert len(after) == 2 and not any(x in after[0] for x in ("Window", "Aggregate", "Repartition", "FlatMapGroups"))


def test_tilts_in_one_pass_are_those_of_peaks_refined(spark):
    draw = np.random.default_rng(4)
    rows = [(i, int(z), int(y), int(x), float(draw.integers(1, 6))) for i in (7, 2, 5) for z, y, x in draw.permutation(list(np.ndindex(6, 6, 6)))[:150]]
    maps = spark.createDataFrame(rows, "index long, z int, y int, x int, value double").coalesce(1)
    vicinity = Structure((1, 1, 1), 1)
    for threshold, n_max in ((0.7, 5), (0.3, 1000)):
        want = sorted(map(tuple, indexing.refine_peaks(indexing.to_peaks(maps, threshold, n_max), maps, 6, vicinity).collect()))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
        try:
            got = sorted(map(tuple, indexing.map_tilts(maps, threshold, n_max, 6, vicinity).collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) and np.allclose(got, want)


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_many_groups_go_to_one_call_and_none_is_cut(spark, size):
    rows = [(k, float(7 * k % 5 + j)) for k in range(40) for j in range(1 + k % 6)] + [(None, 3.0), (None, 5.0)] * 4
    df = spark.createDataFrame(rows, "index long, x double").coalesce(1)

    def spans(rows):
        import pandas as pd

        own = rows.groupby("index", sort=False, dropna=False)
        return pd.DataFrame({"n": own.size(), "sum": own.x.sum()}).reset_index().assign(groups=own.ngroups)

    def one(rows):
        assert rows["index"].nunique(dropna=False) == 1
        return spans(rows)

    schema, want = "index long, n int, sum double, groups int", {}
    for k, x in rows:
        n, total = want.get(k, (0, 0.0))
        want[k] = n + 1, total + x
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        many, single = (groups.per_group(df, f, schema, many=m).collect() for f, m in ((spans, True), (one, False)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for got in (many, single):
        assert len(got) == len(want) and {r["index"]: (r.n, r.sum) for r in got} == want
    assert size < 1000 or max(r.groups for r in many) > 5
