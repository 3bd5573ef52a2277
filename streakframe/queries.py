"""Queries over the given tables, each with the SQL that says the same.

The tables stand in for detector data: an embedding of 64 values is a frame of 8 x 8 pixels with intensities 100 (1 + v);
lineitem is a table grouped by l_orderkey, and its numbers are segments; events have the time of frames.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakframe import config as cfg
from streakframe.functions import indices
from streakframe.functions import vectors as v
from streakframe.kernels.structure import Structure
from streakframe.operators import geometry, groups, indexing, pixels, raster, regions, stats
from streakframe.plans import pipelines
from streakframe.schema import AXES, PANELS, PIXEL, to_block, to_long
from streakframe.session import shared_root
from streakframe.sources import runs
from streakframe.streaming import detect

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str) -> Column:
    """Rounded so that the order of additions doesn't show."""
    return F.floor((F.col(x) if isinstance(x, str) else x) * 1e6 + 0.5) / 1e6


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def s6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


# stand-ins


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("pos", "x"))
    return e.select("frame", F.lit(0).alias("module"), F.expr("pos div 8").cast("int").alias("ss"), (F.col("pos") % 8).alias("fs"), (100 * (1 + F.col("x").cast("double"))).alias("value"))


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames as arrays."""
    pixels_ = F.transform("embedding", lambda x: 100 * (1 + x.cast("double")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.lit(0).alias("module"), F.lit(8).alias("n_ss"), F.lit(8).alias("n_fs"), pixels_.alias("pixels"))


PX = "px AS (SELECT vec_id AS frame, 0 AS module, ((i - 1) // 8)::INT AS ss, ((i - 1) % 8)::INT AS fs, 100 * (1 + embedding[i]::DOUBLE) AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"
META = "meta AS (SELECT module, ss, fs, median(value) AS flatfield, sqrt(median(value)) AS std FROM px GROUP BY ALL)"
SNR = "snr AS (SELECT frame, module, ss, fs, (value - flatfield) / std AS value FROM px JOIN meta USING (module, ss, fs))"
BASE = f"WITH RECURSIVE {PX}, {META}, {SNR}"


def metadata(px: DataFrame) -> DataFrame:
    return stats.background(px, "median-poisson").withColumn("mask", F.lit(True))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = frames(spark, sf_dir)
    return pixels.snr(px, metadata(px))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments from lineitem: index l_orderkey, row l_linenumber."""
    li = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    return li.select(
        F.col("l_orderkey").alias("index"), F.col("l_partkey").alias("part"), F.col("l_linenumber").cast("int").alias("row"), x.alias("x_0"), y.alias("y_0"), (x + 1 + F.col("l_linenumber")).alias("x_1"), (F.col("l_tax") * 100).alias("y_1")
    )


SEG = "seg AS (SELECT l_orderkey AS index, l_partkey AS part, l_linenumber::INT AS row, l_quantity AS x_0, l_discount * 100 AS y_0, l_quantity + 1 + l_linenumber AS x_1, l_tax * 100 AS y_1 FROM lineitem)"


def segment() -> v.Vec:
    return v.columns("x_0", "y_0", "x_1", "y_1")


# statistics and masks


@query(f"{BASE} SELECT frame, count(*) AS n FROM snr WHERE value > 1.25 GROUP BY frame HAVING count(*) > 10")
def hit_frames(spark, sf_dir):
    bright = signal(spark, sf_dir).where("value > 1.25").withColumnRenamed("frame", "index")
    return groups.counts(groups.hits(bright, 10)).withColumnRenamed("index", "frame")


@query(f"WITH {PX} SELECT module, ss, fs, median(value) AS value FROM px GROUP BY ALL")
def whitefield_median(spark, sf_dir):
    return stats.whitefield(frames(spark, sf_dir), "median")


@query(f"WITH {PX} SELECT module, ss, fs, {s6('avg(value)')} AS value FROM px GROUP BY ALL")
def whitefield_mean(spark, sf_dir):
    return rounded(stats.whitefield(frames(spark, sf_dir), "mean"), "value")


@query(f"WITH {PX} SELECT module, ss, fs, {s6('sqrt(avg(value))')} AS std FROM px GROUP BY ALL")
def std_poisson(spark, sf_dir):
    px = frames(spark, sf_dir)
    return rounded(stats.deviation(px, px, "poisson"), "std")


@query(f"{BASE} SELECT frame, module, ss, fs, {s6('value')} AS value FROM snr")
def snr(spark, sf_dir):
    return rounded(signal(spark, sf_dir), "value")


@query(f"WITH {PX} SELECT module, ss, fs, bool_and(value >= 65 AND value < 140) AS mask FROM px GROUP BY ALL")
def mask_range(spark, sf_dir):
    px = frames(spark, sf_dir)
    return pixels.update_mask(px, metadata(px), "range", vmin=65, vmax=140).select(*PIXEL, "mask")


@query(f"{BASE} SELECT module, ss, fs, avg(abs(value)) < 1.0 AS mask FROM snr GROUP BY ALL")
def mask_snr(spark, sf_dir):
    px = frames(spark, sf_dir)
    return pixels.update_mask(signal(spark, sf_dir), metadata(px), "snr", snr_max=1.0).select(*PIXEL, "mask")


@query(f"{BASE} SELECT module, ss, fs, std > 9.99 AND std < 10.02 AS mask FROM meta")
def mask_std(spark, sf_dir):
    px = frames(spark, sf_dir)
    return pixels.update_mask(px, metadata(px), "std", std_min=9.99, std_max=10.02).select(*PIXEL, "mask")


@query(f"{BASE} SELECT module, ss, fs, NOT (ss >= 2 AND ss < 5 AND fs >= 1 AND fs < 4) AND fs <> 7 AS mask FROM meta")
def mask_region_and_import(spark, sf_dir):
    px = frames(spark, sf_dir)
    meta = pixels.mask_region(metadata(px), (2, 5, 1, 4))
    new = meta.select(*PIXEL, (F.col("fs") != 7).alias("mask"))
    return pixels.import_mask(meta, new, "multiply").select(*PIXEL, "mask")


@query(f"WITH {PX} SELECT frame, sum(CASE WHEN fs = 3 THEN 0 ELSE value END) > 5600 AS bright FROM px GROUP BY frame")
def apply_mask(spark, sf_dir):
    px = frames(spark, sf_dir)
    meta = metadata(px).withColumn("mask", F.col("fs") != 3)
    return pixels.apply_mask(px, meta).groupBy("frame").agg((F.sum("value") > 5600).alias("bright"))


@query(f"WITH {PX} SELECT frame, module, ss, fs, value FROM px WHERE ss >= 1 AND ss < 3 AND fs >= 2 AND fs < 6")
def crop(spark, sf_dir):
    return pixels.crop(frames(spark, sf_dir), (1, 3, 2, 6))


@query(f"WITH {PX} SELECT frame, module, ss, fs, least(greatest(value, 95.0), 105.0) AS value FROM px WHERE frame IN (3, 5, 8)")
def select_and_clip(spark, sf_dir):
    return pixels.clip(pixels.select_frames(frames(spark, sf_dir), [3, 5, 8]), 95.0, 105.0)


@query(f"WITH {PX} SELECT count(DISTINCT frame) AS num_frames, count(DISTINCT module) AS num_modules, max(ss) + 1 AS n_ss, max(fs) + 1 AS n_fs FROM px")
def frame_shape(spark, sf_dir):
    return pixels.frame_shape(frames(spark, sf_dir))


def robust_mean_ctes(steps: int, r0: float, r1: float, lm: float) -> str:
    out = [f"WITH {PX}", "n AS (SELECT *, count(*) OVER w AS n, median(value) OVER w AS m FROM px WINDOW w AS (PARTITION BY module, ss, fs))"]
    last = "n"
    for k in range(steps):
        out.append(f"k{k} AS (SELECT *, row_number() OVER (PARTITION BY module, ss, fs ORDER BY power(value - m, 2), frame) - 1 AS k FROM {last})")
        out.append(f"m{k} AS (SELECT * EXCLUDE (m, k), avg(CASE WHEN k >= floor({r0} * n) AND k < greatest(floor({r1} * n), floor({r0} * n) + 1) THEN value END) OVER (PARTITION BY module, ss, fs) AS m FROM k{k})")
        last = f"m{k}"
    out.append(f"e AS (SELECT *, power(value - m, 2) AS e FROM {last})")
    out.append("s AS (SELECT *, row_number() OVER w - 1 AS k, sum(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM e WINDOW w AS (PARTITION BY module, ss, fs ORDER BY e, frame))")
    out.append(f"c AS (SELECT *, min(CASE WHEN {lm} * s < k * e THEN k END) OVER (PARTITION BY module, ss, fs) AS cut FROM s)")
    return ", ".join(out)


ROBUST = f"{robust_mean_ctes(2, 0.0, 0.5, 9.0)} SELECT module, ss, fs, {s6('avg(value)')} AS mean, {s6('sqrt(avg(e))')} AS std FROM c WHERE cut IS NULL OR k < cut GROUP BY ALL"


@query(ROBUST)
def robust_mean_windows(spark, sf_dir):
    return rounded(stats.robust_mean_sql(frames(spark, sf_dir), list(PIXEL), n_iter=2), "mean", "std")


@query(ROBUST)
def robust_mean(spark, sf_dir):
    return rounded(stats.robust_mean(frames(spark, sf_dir), list(PIXEL), n_iter=2), "mean", "std")


def label_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean frame of each label, as whitefields (wf, module, ss, fs, value)."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").cast("long").alias("wf"))
    return frames(spark, sf_dir).join(labels, "frame").groupBy("wf", *PIXEL).agg(F.avg("value").alias("value"))


FIELDS = "wf AS (SELECT label::BIGINT AS wf, module, ss, fs, avg(value) AS value FROM px JOIN embeddings ON vec_id = frame GROUP BY ALL)"


@query(f"WITH {PX}, {FIELDS} SELECT frame, wf::INT AS comp, {s6('sum(p.value * w.value) / sum(w.value * w.value)')} AS coef FROM px p JOIN wf w USING (module, ss, fs) WHERE wf < 3 GROUP BY ALL")
def lsq_projection(spark, sf_dir):
    fields = label_fields(spark, sf_dir).where("wf < 3").withColumn("comp", F.col("wf").cast("int"))
    return rounded(stats.lsq(frames(spark, sf_dir), fields), "coef")


@query(
    f"WITH {PX}, {FIELDS}, flat AS (SELECT module, ss, fs, avg(value) AS b FROM wf GROUP BY ALL), d AS (SELECT wf, module, ss, fs, value - b AS v FROM wf JOIN flat USING (module, ss, fs)) "
    f"SELECT a.wf AS i, b.wf AS j, {s6('sum(a.v * b.v)')} AS g FROM d a JOIN d b USING (module, ss, fs) WHERE a.wf <= b.wf GROUP BY ALL"
)
def gram_matrix(spark, sf_dir):
    fields = label_fields(spark, sf_dir)
    return rounded(stats.gram(fields, fields.groupBy(*PIXEL).agg(F.avg("value").alias("value"))), "g")


@query()
def pca(spark, sf_dir):
    fields = label_fields(spark, sf_dir)
    _, ratios = stats.pca(fields, fields.groupBy(*PIXEL).agg(F.avg("value").alias("value")))
    return rounded(ratios, "ratio")


LSQ1 = (
    f"WITH {PX}, w AS (SELECT module, ss, fs, median(value) AS w FROM px GROUP BY ALL), y AS (SELECT frame, ss, fs, value AS y, w, count(*) OVER (PARTITION BY frame) AS n, ss * 8 + fs AS pix FROM px JOIN w USING (module, ss, fs)), "
    "f0 AS (SELECT *, sum(y * w) OVER p / sum(w * w) OVER p AS f FROM y WINDOW p AS (PARTITION BY frame)), "
    "k0 AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY power(y - f * w, 2), pix) - 1 AS k FROM f0), "
    "f1 AS (SELECT * EXCLUDE (f, k), sum(CASE WHEN k >= floor(0.5 * n) AND k < floor(0.99 * n) THEN y * w END) OVER p / sum(CASE WHEN k >= floor(0.5 * n) AND k < floor(0.99 * n) THEN w * w END) OVER p AS f FROM k0 WINDOW p AS (PARTITION BY frame)), "
    "e AS (SELECT *, power(y - f * w, 2) AS e FROM f1), "
    "s AS (SELECT *, row_number() OVER o - 1 AS k, sum(e) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM e WINDOW o AS (PARTITION BY frame ORDER BY e, pix)), "
    "c AS (SELECT *, min(CASE WHEN 9 * s < k * e THEN k END) OVER (PARTITION BY frame) AS cut FROM s) "
    f"SELECT frame, 0 AS comp, {s6('sum(y * w) / sum(w * w)')} AS coef FROM c WHERE cut IS NULL OR k < cut GROUP BY frame"
)


@query(LSQ1)
def robust_lsq(spark, sf_dir):
    px = frames(spark, sf_dir)
    field = stats.whitefield(px, "median").withColumn("comp", F.lit(0))
    return rounded(stats.robust_lsq(px, field, n_iter=1), "coef")


@query(f"WITH {PX}, {FIELDS} SELECT module, ss, fs, bool_and(value > 99) AS mask, {s6('sqrt(avg(value * value))')} AS std FROM wf GROUP BY ALL")
def accumulate_metadata(spark, sf_dir):
    metas = label_fields(spark, sf_dir).select(*PIXEL, (F.col("value") > 99).alias("mask"), F.col("value").alias("std"))
    return rounded(stats.accumulate(metas), "std")


@query(
    "SELECT l_suppkey AS target, 'add' AS how, sum(l_linenumber)::DOUBLE AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'min', min(l_quantity)::DOUBLE FROM lineitem GROUP BY 1 "
    "UNION ALL SELECT l_suppkey, 'set', arg_max(l_quantity, l_orderkey * 10 + l_linenumber)::DOUBLE FROM lineitem GROUP BY 1"
)
def scatter(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("target"), F.col("l_linenumber").alias("n"), "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"))
    parts = [stats.scatter(li, ["target"], how, value).select("target", F.lit(how).alias("how"), F.col("value").cast("double").alias("value")) for how, value in (("add", "n"), ("min", "l_quantity"), ("set", "l_quantity"))]
    return groups.concatenate(parts, None)


# regions

ON = "lab AS (SELECT frame, ss, fs, ss * 8 + fs AS pix, value FROM snr WHERE value > 1.25)"
REACH = f"{ON}, reach(frame, pix, root) AS (SELECT frame, pix, pix FROM lab UNION SELECT b.frame, b.pix, r.root FROM reach r JOIN lab a ON a.frame = r.frame AND a.pix = r.pix JOIN lab b ON b.frame = a.frame AND abs(a.ss - b.ss) + abs(a.fs - b.fs) = 1)"
REG = f"{REACH}, rt AS (SELECT frame, pix, min(root) AS root FROM reach GROUP BY ALL), rg AS (SELECT l.*, root FROM lab l JOIN rt USING (frame, pix)), big AS (SELECT frame, root, row_number() OVER (PARTITION BY frame ORDER BY root) AS region FROM rg GROUP BY frame, root HAVING count(*) >= 3), reg AS (SELECT frame, region, ss, fs, value FROM rg JOIN big USING (frame, root))"
MOM = "mo AS (SELECT frame, region, count(*) AS n, sum(value) AS m, sum(value * fs) / sum(value) AS cx, sum(value * ss) / sum(value) AS cy, sum(value * fs * fs) / sum(value) AS sxx, sum(value * ss * ss) / sum(value) AS syy, sum(value * fs * ss) / sum(value) AS sxy FROM reg GROUP BY ALL), cov AS (SELECT *, sxx - cx * cx AS xx, syy - cy * cy AS yy, sxy - cx * cy AS xy FROM mo)"
CROSS = Structure((1, 1), 1)


def bright_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.label(to_block(signal(spark, sf_dir)), CROSS, 1.25, 3)


@query(f"{BASE}, {REG} SELECT frame, region, 0 AS module, ss, fs FROM reg")
def label_regions(spark, sf_dir):
    return bright_regions(spark, sf_dir).select("frame", "region", "module", "ss", "fs")


@query(f"{BASE}, {REG}, {MOM} SELECT frame, region, n, {s6('m')} AS mass, {s6('cx')} AS cx, {s6('cy')} AS cy, {s6('xx')} AS xx, {s6('yy')} AS yy, {s6('xy')} AS xy FROM cov")
def region_moments(spark, sf_dir):
    m = regions.measures(bright_regions(spark, sf_dir)).select("frame", "region", "n", "mass", "cx", "cy", "xx", "yy", "xy")
    return rounded(m, "mass", "cx", "cy", "xx", "yy", "xy")


@query(f"{BASE} SELECT frame, avg((value >= 1.0)::INT) AS p0 FROM snr GROUP BY frame")
def signal_share(spark, sf_dir):
    return regions.signal_share(signal(spark, sf_dir), 1.0)


# A covariance or a difference of spreads that is rounding counts as 0, so that regions along an axis have one fit.
FIT = "fit AS (SELECT * EXCLUDE (xy), CASE WHEN abs(xy) < 1e-9 THEN 0 ELSE xy END AS xy, CASE WHEN abs(xx - yy) < 1e-9 THEN 0 ELSE xx - yy END AS gap FROM cov), wide AS (SELECT *, sqrt(4 * xy * xy + gap * gap) AS d FROM fit)"
AXIS = f"{FIT}, t AS (SELECT *, 0.5 * atan2(2 * xy, gap) AS th, sqrt(2 * ln(2) * (xx + yy + d)) AS hw FROM wide)"


@query(f"{BASE}, {REG}, {MOM}, {AXIS} SELECT frame, region, {s6('cx + hw * cos(th)')} AS x_0, {s6('cy + hw * sin(th)')} AS y_0, {s6('cx - hw * cos(th)')} AS x_1, {s6('cy - hw * sin(th)')} AS y_1 FROM t")
def line_fit(spark, sf_dir):
    return rounded(regions.line_fit(regions.measures(bright_regions(spark, sf_dir))), "x_0", "y_0", "x_1", "y_1")


@query(f"{BASE}, {REG}, {MOM}, {FIT} SELECT frame, region, {s6('sqrt(2 * ln(2) * (xx + yy + d))')} AS a, {s6('sqrt(greatest(2 * ln(2) * (xx + yy - d), 0))')} AS b, {s6('CASE WHEN gap = 0 THEN sign(xy) * pi() / 4 ELSE 0.5 * atan(2 * xy / gap) END')} AS theta FROM wide")
def ellipse_fit(spark, sf_dir):
    return rounded(regions.ellipse_fit(regions.measures(bright_regions(spark, sf_dir))), "a", "b", "theta")


@query(
    f"{BASE}, {REG}, {MOM}, {AXIS}, "
    "ln4 AS (SELECT frame, region, cx + hw * cos(th) AS x_0, cy + hw * sin(th) AS y_0, -2 * hw * cos(th) AS ax, -2 * hw * sin(th) AS ay FROM t), "
    "d AS (SELECT frame, region, value, least(greatest(((fs - x_0) * ax + (ss - y_0) * ay) / (ax * ax + ay * ay), 0), 1) AS t, fs - x_0 AS dx, ss - y_0 AS dy, ax, ay FROM reg JOIN ln4 USING (frame, region)), "
    "c AS (SELECT frame, region, count(*) FILTER (sqrt(power(dx - t * ax, 2) + power(dy - t * ay, 2)) < 0.5) AS n, count(*) FILTER (sqrt(power(dx - t * ax, 2) + power(dy - t * ay, 2)) < 0.5 AND value >= 1.5) AS k FROM d GROUP BY ALL), "
    "p AS (SELECT frame, avg((value >= 1.5)::INT) AS p FROM snr GROUP BY frame), "
    "q AS (SELECT c.*, nullif(p, 0) AS p, unnest(range(k, n + 1)) AS i FROM c JOIN p USING (frame)) "
    f"SELECT frame, region, n, k, CASE WHEN k = 0 THEN 0 ELSE {s6('ln(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))))')} END AS log_p FROM q GROUP BY frame, region, n, k"
)
def p_values(spark, sf_dir):
    found = bright_regions(spark, sf_dir)
    fits = regions.line_fit(regions.measures(found))
    return rounded(regions.p_values(found, fits, regions.signal_share(signal(spark, sf_dir), 1.5), 1.5, 0.5).drop("min_support"), "log_p")


@query(
    f"{BASE}, {ON}, sh AS (SELECT a AS dss, b AS dfs FROM (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b) WHERE abs(a) + abs(b) <= 1), "
    "one AS (SELECT DISTINCT frame, ss + dss AS ss, fs + dfs AS fs FROM lab, sh WHERE ss + dss BETWEEN 0 AND 7 AND fs + dfs BETWEEN 0 AND 7) "
    "SELECT DISTINCT frame, 0 AS module, (ss + dss)::INT AS ss, (fs + dfs)::INT AS fs FROM one, sh WHERE ss + dss BETWEEN 0 AND 7 AND fs + dfs BETWEEN 0 AND 7"
)
def dilation(spark, sf_dir):
    return regions.dilate(signal(spark, sf_dir).where("value > 1.25"), CROSS, (1, 8, 8), 2)


@query(f"{BASE}, {REG}, p AS (SELECT frame, ss, fs, max(region) AS label FROM reg GROUP BY ALL) SELECT x.frame, x.module, x.ss, x.fs, coalesce(label, 0) AS label FROM px x LEFT JOIN p USING (frame, ss, fs)")
def label_image(spark, sf_dir):
    image = regions.to_labels(bright_regions(spark, sf_dir), frames(spark, sf_dir))
    return regions.to_labels(regions.from_labels(image), frames(spark, sf_dir)).drop("value")


@query(f"{BASE}, {ON} SELECT frame, ss, fs, count(*) AS n FROM (SELECT DISTINCT frame, ss, fs FROM lab UNION SELECT frame, ss, 7 - fs FROM lab) GROUP BY ALL")
def merge_regions(spark, sf_dir):
    on = signal(spark, sf_dir).where("value > 1.25").withColumn("region", F.lit(1).cast("long"))
    both = regions.merge(on, on.withColumn("fs", 7 - F.col("fs")))
    return both.groupBy("frame", "ss", "fs").agg(F.count("*").alias("n"))


@query(
    f"{BASE}, n AS (SELECT a.frame, a.ss, a.fs, a.value, count(*) AS k FROM snr a JOIN snr b ON a.frame = b.frame AND abs(a.ss - b.ss) + abs(a.fs - b.fs) = 1 AND a.value >= b.value WHERE a.value > 1.0 GROUP BY ALL), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY frame, ss // 2, fs // 2 ORDER BY value DESC, fs, ss) AS j FROM n WHERE k = 4) "
    "SELECT frame, 0 AS module, (ss // 2)::INT AS by, (fs // 2)::INT AS bx, ss, fs, (row_number() OVER (PARTITION BY frame ORDER BY value DESC, ss // 2, fs // 2))::INT AS rank FROM b WHERE j = 1"
)
def detect_peaks(spark, sf_dir):
    return regions.peaks(to_block(signal(spark, sf_dir)), 2, 1.0).drop("value")


# groups


@query(f"WITH {SEG} SELECT s.* FROM seg s JOIN (SELECT unnest([1, 3, 7, 3]) AS index) k USING (index)")
def take(spark, sf_dir):
    return groups.take(lines(spark, sf_dir), [1, 3, 7, 3])


@query(f"WITH {SEG} SELECT pos AS index, part, row, x_0, y_0, x_1, y_1 FROM seg s JOIN (VALUES (7, 0::BIGINT), (1, 1::BIGINT)) k(index, pos) USING (index)")
def loc(spark, sf_dir):
    return groups.loc(lines(spark, sf_dir), [7, 1])


@query(f"WITH {SEG}, k AS (SELECT index, dense_rank() OVER (ORDER BY index) - 1 AS p FROM (SELECT DISTINCT index FROM seg)) SELECT (CASE p WHEN 5 THEN 0 ELSE 1 END)::BIGINT AS index, part, row, x_0, y_0, x_1, y_1 FROM seg JOIN k USING (index) WHERE p IN (5, 10)")
def iloc(spark, sf_dir):
    return groups.iloc(lines(spark, sf_dir), [5, 10])


@query(f"WITH {SEG} SELECT dense_rank() OVER (ORDER BY index) - 1 AS index, part, row, x_0, y_0, x_1, y_1 FROM seg")
def reset_index(spark, sf_dir):
    return groups.reset(lines(spark, sf_dir))


@query(f"WITH {SEG} SELECT DISTINCT index FROM seg")
def unique_keys(spark, sf_dir):
    return groups.unique(lines(spark, sf_dir))


@query("SELECT o_orderkey AS query, l_partkey AS row FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def get_index(spark, sf_dir):
    """Of every order, where get_index and its SQL take 1 in 7."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"), F.col("o_orderkey").alias("index"))
    return groups.get_index(lines(spark, sf_dir).select("index", F.col("part").alias("row")), wanted)


@query("SELECT o_orderkey AS index, (SELECT count(*) FROM lineitem WHERE l_orderkey < o_orderkey) AS place FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def insert_index(spark, sf_dir):
    return groups.insert_index(lines(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("index")))


@query(
    "WITH s AS (SELECT user_id AS index, lead(user_id) OVER (ORDER BY event_id) AS a FROM events) SELECT bool_and(coalesce(a >= index, true)) AS is_increasing, bool_and(coalesce(a <= index, true)) AS is_decreasing, count(DISTINCT index) = count(*) AS is_unique FROM s"
)
def monotonicity(spark, sf_dir):
    return groups.monotonicity(table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("index")), "event_id")


@query(f"WITH {SEG} SELECT index, row, part, ntile(7) OVER (ORDER BY index, row, part) - 1 AS chunk FROM seg")
def split_rows(spark, sf_dir):
    return groups.split(lines(spark, sf_dir).select("index", "row", "part"), 7, ["index", "row", "part"])


@query(f"WITH {SEG}, e AS (SELECT min(index) AS lo, max(index) AS hi FROM seg) SELECT index, row, part FROM seg UNION ALL SELECT index + hi + 1 - lo, row, part FROM seg, e")
def concatenate_rebased(spark, sf_dir):
    rows = lines(spark, sf_dir).select("index", "row", "part")
    return groups.concatenate([rows, rows.where("index < 0"), rows])


@query("SELECT n_nationkey AS k, 0 AS block FROM nation UNION ALL SELECT r_regionkey, 1 FROM region")
def stack_tables(spark, sf_dir):
    return groups.stack([table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))])


@query("SELECT (event_id // 5)::BIGINT AS block, count(*) AS n, min(user_id) AS first FROM events GROUP BY 1")
def reshape_rows(spark, sf_dir):
    blocks = groups.reshape(table(spark, sf_dir, "events").select("event_id", "user_id"), 5, "event_id", None)
    return blocks.select("block", F.size("rows").cast("long").alias("n"), F.array_min(F.transform("rows", lambda x: x["user_id"])).alias("first"))


@query(f"WITH {SEG} SELECT * FROM seg WHERE index IN (SELECT index FROM seg GROUP BY index HAVING count(*) > 6)")
def hit_groups(spark, sf_dir):
    return groups.hits(lines(spark, sf_dir), 6)


@query(f"WITH {SEG}, r AS (SELECT *, row_number() OVER (PARTITION BY index ORDER BY x_0, part, row) - 1 AS k, count(*) OVER (PARTITION BY index) AS n FROM seg) SELECT index, part, row, x_0, y_0, x_1, y_1 FROM r WHERE k < 0.4 * n")
def keep_best(spark, sf_dir):
    tied = lines(spark, sf_dir).withColumn("_t", F.struct("part", "row"))
    return groups.keep_best(tied, "x_0", 0.4, tie="_t").drop("_t")


@query("SELECT w AS window, (w * 30 + i)::INT AS frame FROM (SELECT unnest(range(0, 4))::BIGINT AS w), (SELECT unnest(range(0, 10)) AS i)")
def frame_windows(spark, sf_dir):
    return groups.windows_of(spark, 100, 10, 30).withColumn("frame", F.col("frame").cast("int"))


@query("SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1")
def pulse_lookup(spark, sf_dir):
    pulses = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(pulses, "c_nationkey", "left")


@query(f"WITH {PX}, m AS (SELECT *, value / max(value) OVER (PARTITION BY frame) AS s FROM px), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY value DESC, ss DESC, fs DESC) AS k FROM m WHERE s > 0.9) SELECT frame AS index, 0 AS z, ss AS y, fs AS x, value FROM r WHERE k <= 4")
def top_peaks(spark, sf_dir):
    maps = frames(spark, sf_dir).select(F.col("frame").alias("index"), F.lit(0).alias("z"), F.col("ss").alias("y"), F.col("fs").alias("x"), "value")
    return indexing.to_peaks(maps, 0.9, 4)


# segments and rasters


@query(
    f"WITH {SEG} SELECT index, part, row, {s6('sqrt(power(x_1 - x_0, 2) + power(y_1 - y_0, 2))')} AS length, "
    f"{s6('x_0 + least(greatest(((20 - x_0) * (x_1 - x_0) + (3 - y_0) * (y_1 - y_0)) / (power(x_1 - x_0, 2) + power(y_1 - y_0, 2)), 0), 1) * (x_1 - x_0)')} AS px, "
    f"{s6('x_0 + 0.25 * (x_1 - x_0)')} AS sx FROM seg"
)
def segment_measures(spark, sf_dir):
    x, _ = v.project(segment(), F.lit(20.0), F.lit(3.0))
    return lines(spark, sf_dir).select("index", "part", "row", r6(v.length(segment())).alias("length"), r6(x).alias("px"), r6(v.sample(segment(), 0.25)[0]).alias("sx"))


@query(
    f"WITH {SEG}, t AS (SELECT *, y_1 - y_0 AS nx, x_0 - x_1 AS ny, (x_0 + x_1) / 2 - 25 AS rx, (y_0 + y_1) / 2 - 4.3 AS ry FROM seg), u AS (SELECT *, (nx * rx + ny * ry) / (nx * nx + ny * ny) AS k FROM t) "
    "SELECT index, part, row FROM u WHERE sqrt(power(rx - k * nx, 2) + power(ry - k * ny, 2)) / sqrt(rx * rx + ry * ry) < 0.33"
)
def concentric_only(spark, sf_dir):
    return lines(spark, sf_dir).where(v.concentric(segment(), F.lit(25.0), F.lit(4.3))).select("index", "part", "row")


@query(f"WITH {SEG} SELECT a.index, a.row, a.part, {s6('a.x_0 + ((b.x_0 - a.x_0) * (b.y_1 - b.y_0) - (b.y_0 - a.y_0) * (b.x_1 - b.x_0)) / ((a.x_1 - a.x_0) * (b.y_1 - b.y_0) - (a.y_1 - a.y_0) * (b.x_1 - b.x_0)) * (a.x_1 - a.x_0)')} AS x FROM seg a JOIN seg b ON a.index = b.index AND b.row = a.row + 1 WHERE abs((a.x_1 - a.x_0) * (b.y_1 - b.y_0) - (a.y_1 - a.y_0) * (b.x_1 - b.x_0)) > 0.5")
def segment_intersections(spark, sf_dir):
    a = lines(spark, sf_dir)
    b = a.select("index", (F.col("row") - 1).alias("row"), *(F.col(c).alias(f"b_{c}") for c in ("x_0", "y_0", "x_1", "y_1")))
    other = v.columns("b_x_0", "b_y_0", "b_x_1", "b_y_1")
    x, _ = v.intersection(segment(), other)
    apart = F.abs((segment()[2] - segment()[0]) * (other[3] - other[1]) - (segment()[3] - segment()[1]) * (other[2] - other[0])) > 0.5
    return a.join(b, ["index", "row"]).where(apart).select("index", "row", "part", r6(x).alias("x"))


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn_from(table(spark, sf_dir, "lineitem"))


def drawn_from(li: DataFrame) -> DataFrame:
    return li.select(F.col("l_suppkey").alias("frame"), F.col("l_linenumber").alias("term"), F.col("l_quantity").alias("x_0"), (F.col("l_discount") * 100).alias("y_0"), (F.col("l_quantity") + 1 + F.col("l_linenumber")).alias("x_1"), (F.col("l_tax") * 100).alias("y_1"), F.lit(1.5).alias("width"))


DRAW = (
    "WITH s AS (SELECT l_suppkey AS frame, l_linenumber AS term, l_quantity AS x_0, l_discount * 100 AS y_0, l_quantity + 1 + l_linenumber AS x_1, l_tax * 100 AS y_1, row_number() OVER () AS id FROM lineitem), "
    "g AS (SELECT *, x_1 - x_0 AS ax, y_1 - y_0 AS ay FROM s, (SELECT unnest(range(0, 12))::INT AS ss), (SELECT unnest(range(0, 60))::INT AS fs) WHERE fs BETWEEN x_0 - 2 AND x_1 + 2), "
    "t AS (SELECT *, least(greatest(((fs - x_0) * ax + (ss - y_0) * ay) / (ax * ax + ay * ay), 0), 1) AS t FROM g), "
    "d AS (SELECT frame, term, ss, fs, sqrt(power(fs - x_0 - t * ax, 2) + power(ss - y_0 - t * ay, 2)) / 1.5 AS x FROM t), k AS (SELECT *, exp(-0.5 * power(3 * x, 2)) / sqrt(2 * pi()) AS gauss, 0.75 * (1 - x * x) AS para, 0.9375 * power(1 - x * x, 2) AS bi, 1 - x AS tri FROM d WHERE x <= 1) "
)


@query(DRAW + f"SELECT frame, ss, fs, {s6('sum(2 * bi)')} AS value FROM k WHERE x < 0.999999 GROUP BY ALL HAVING {s6('sum(2 * bi)')} > 0")
def draw_lines(spark, sf_dir):
    return rounded(raster.draw_lines(strokes(spark, sf_dir), (12, 60), 2.0, "biweight", "sum"), "value").where("value > 0")


@query(DRAW + f"SELECT frame, ss, fs, {s6('max(tri)')} AS value FROM k GROUP BY ALL HAVING {s6('max(tri)')} > 0")
def draw_lines_max(spark, sf_dir):
    return rounded(raster.draw_lines(strokes(spark, sf_dir), (12, 60), 1.0, "triangular", "max"), "value").where("value > 0")


@query(DRAW + f", m AS (SELECT frame, term, ss, fs, max(para) AS value FROM k GROUP BY ALL) SELECT frame, ss, fs, {s6('sum(value)')} AS value FROM m GROUP BY ALL HAVING {s6('sum(value)')} > 0")
def accumulate_lines(spark, sf_dir):
    return rounded(raster.accumulate_lines(strokes(spark, sf_dir), (12, 60), 1.0, "parabolic", "max", "sum"), "value").where("value > 0")


@query(DRAW + "SELECT frame * 8 + term AS frame, ss, fs, 1.0::DOUBLE AS value FROM k GROUP BY ALL")
def pattern_image(spark, sf_dir):
    s = strokes(spark, sf_dir).select(F.col("frame").alias("index"), F.col("term").alias("module_id"), "x_0", "y_0", "x_1", "y_1")
    return raster.pattern_image(s, (12, 60), 1.5, num_modules=8)


@query(DRAW + f"SELECT px.frame, ss, fs, {s6('px.v + coalesce(d.s, 0)')} AS value FROM (SELECT s_suppkey AS frame, ss, fs, 1.0 AS v FROM supplier, (SELECT unnest(range(0, 12))::INT AS ss), (SELECT unnest(range(0, 60))::INT AS fs)) px LEFT JOIN (SELECT frame, ss, fs, sum(bi) AS s FROM k GROUP BY ALL) d USING (frame, ss, fs)")
def draw_onto(spark, sf_dir):
    blank = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("ss"))
    blank = blank.withColumn("fs", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumn("value", F.lit(1.0))
    return rounded(raster.onto(blank, raster.draw_lines(strokes(spark, sf_dir), (12, 60), 1.0, "biweight", "sum"), (12, 60)), "value")


@query(f"WITH {SEG} SELECT index, row, part, x_0, y_0, lead(x_0) OVER w AS x_1, lead(y_0) OVER w AS y_1 FROM seg WINDOW w AS (PARTITION BY index ORDER BY row, part, x_0, y_0)")
def path_segments(spark, sf_dir):
    points = lines(spark, sf_dir).select("index", "row", "part", "x_0", "y_0")
    return groups.consecutive(points, ["row", "part", "x_0", "y_0"], {"x_0": "x_1", "y_0": "y_1"})


@query(f"WITH {SEG}, n AS (SELECT index, row, part, sum(x_1 - x_0) OVER (PARTITION BY index, row) AS s FROM seg) SELECT index, row, part, (row_number() OVER (PARTITION BY index ORDER BY s DESC, row, part) - 1)::INT AS rank FROM n")
def streak_ranking(spark, sf_dir):
    total = F.sum(F.col("x_1") - F.col("x_0")).over(groups.Window.partitionBy("index", "row"))
    rows = lines(spark, sf_dir).withColumn("s", total).select("index", "row", "part", "s")
    return groups.ranking(rows, [F.desc("s"), "row", "part"]).drop("s")


@query("WITH a AS (SELECT c_custkey AS richer, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS position FROM customer), b AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer) SELECT position, richer, c_name FROM a JOIN b USING (position)")
def positional_zip(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a, b = c.select(F.col("c_custkey").alias("richer"), "c_acctbal"), c.select("c_custkey", "c_name")
    return groups.positional_zip(a, ["c_acctbal", "richer"], b, ["c_custkey"]).select("position", "richer", "c_name")


@query(f"WITH {PX}, {FIELDS}, flat AS (SELECT module, ss, fs, avg(value) AS b FROM wf GROUP BY ALL), c AS (SELECT frame, wf, sum(p.value * w.value) / sum(w.value * w.value) AS c FROM px p JOIN wf w USING (module, ss, fs) WHERE wf < 3 GROUP BY ALL) SELECT frame, module, ss, fs, {s6('b + sum(c * w.value)')} AS value FROM c JOIN wf w USING (wf) JOIN flat USING (module, ss, fs) GROUP BY frame, module, ss, fs, b")
def project_background(spark, sf_dir):
    fields = label_fields(spark, sf_dir)
    good = fields.where("wf < 3").withColumn("comp", F.col("wf").cast("int"))
    flat = fields.groupBy(*PIXEL).agg(F.avg("value").alias("value"))
    return rounded(stats.project(stats.lsq(frames(spark, sf_dir), good), good, flat), "value")


@query(f"WITH {PX} SELECT module, ss, fs, median(value) AS flatfield, sqrt(median(value)) AS std FROM px GROUP BY ALL")
def background_median_poisson(spark, sf_dir):
    return stats.background(frames(spark, sf_dir), "median-poisson")


@query("SELECT l_suppkey AS target, arg_min(row, (l_quantity, row)) AS value FROM (SELECT *, l_orderkey * 10 + l_linenumber AS row FROM lineitem) GROUP BY 1")
def scatter_argmin(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("target"), "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"))
    return stats.scatter(li, ["target"], "argmin", "l_quantity")


@query(f"WITH {PX}, s AS (SELECT a AS dss, b AS dfs FROM (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b) WHERE abs(a) + abs(b) <= 1) SELECT frame, (ss + dss)::INT AS ss, (fs + dfs)::INT AS fs, {s6('avg(value)')} AS value FROM px, s WHERE ss + dss BETWEEN 0 AND 7 AND fs + dfs BETWEEN 0 AND 7 GROUP BY ALL")
def neighbour_mean(spark, sf_dir):
    sent = regions.neighbours(frames(spark, sf_dir), CROSS, (1, 8, 8))
    return rounded(sent.groupBy("frame", "ss", "fs").agg(F.avg("value").alias("value")), "value")


@query("SELECT frame, n FROM (SELECT vec_id AS frame, label FROM embeddings) JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label)")
def block_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    whole = to_block(frames(spark, sf_dir)).where("n_ss = 8 and n_fs = 8 and size(pixels) = 64").select("frame")
    sizes = e.groupBy("label").agg(F.count("*").alias("n"))
    return whole.join(e.select(F.col("vec_id").alias("frame"), "label"), "frame").join(sizes, "label").select("frame", "n")


# geometry: four panels of 4 x 4 pixels that stand for supplier coordinates

_PANELS = [
    (0, "p0", 0, 0, 3, 0, 3, -5.0, -5.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.5, 10.0),
    (1, "p1", 0, 0, 3, 4, 7, 1.0, -5.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.5, 10.0),
    (2, "p2", 0, 4, 7, 0, 3, -1.0, 2.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.5, 10.0),
    (3, "p3", 0, 4, 7, 4, 7, 5.0, 6.0, -1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.5, 10.0),
]
P_SQL = "p(panel_id, name, module, min_ss, max_ss, min_fs, max_fs, corner_x, corner_y, ss_x, ss_y, ss_z, fs_x, fs_y, fs_z, coffset, res) AS (VALUES " + ", ".join(str(r) for r in _PANELS) + ")"
MAP = f"{P_SQL}, mp AS (SELECT panel_id, module, ss::INT AS ss, fs::INT AS fs, (ss - min_ss) * ss_x + (fs - min_fs) * fs_x + corner_x + 0.5 AS x, (ss - min_ss) * ss_y + (fs - min_fs) * fs_y + corner_y + 0.5 AS y, coffset * res AS z FROM p, (SELECT unnest(range(0, 8)) AS ss), (SELECT unnest(range(0, 8)) AS fs) WHERE ss BETWEEN min_ss AND max_ss AND fs BETWEEN min_fs AND max_fs)"


def panels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PANELS, PANELS)


@query(f"WITH {MAP} SELECT module, ss, fs, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM mp")
def pixel_map(spark, sf_dir):
    return geometry.pixel_map(panels(spark))


@query(f"WITH {PX}, {MAP}, lo AS (SELECT min(x) AS lx, min(y) AS ly FROM mp), i AS (SELECT ss, fs, (y - ly)::INT AS row, (x - lx)::INT AS col FROM mp, lo) SELECT frame, row, col, arg_max(value, ss * 8 + fs) AS value FROM px JOIN i USING (ss, fs) GROUP BY ALL")
def assemble_frames(spark, sf_dir):
    return geometry.assemble(frames(spark, sf_dir), geometry.pixel_indices(geometry.pixel_map(panels(spark))))


@query(
    f"WITH {MAP}, lo AS (SELECT min(x) AS lx, min(y) AS ly FROM mp), pt AS (SELECT s_suppkey AS point, s_suppkey % 8 AS ss, (s_suppkey // 8) % 8 AS fs FROM supplier) SELECT point, (x - lx)::DOUBLE AS x, (y - ly)::DOUBLE AS y, z::DOUBLE AS z FROM pt JOIN mp USING (ss, fs), lo"
)
def to_detector(spark, sf_dir):
    key = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(key.alias("point"), F.lit(0).alias("module"), (key % 8).cast("double").alias("ss"), (F.expr("s_suppkey div 8") % 8).cast("double").alias("fs"))
    return geometry.to_detector(points, panels(spark), tolerance=0.5)


TO_STREAKS = (
    f"WITH {MAP}, lo AS (SELECT min(x) AS lx, min(y) AS ly FROM mp), s AS (SELECT s_suppkey AS index, (s_suppkey % 7)::DOUBLE AS x_0, (s_suppkey % 5)::DOUBLE AS y_0, (s_suppkey % 6)::DOUBLE AS x_1, (s_suppkey % 8)::DOUBLE AS y_1 FROM supplier), "
    "d AS (SELECT *, sqrt(power(y_0 - least(greatest(y_0, min_ss), max_ss + 1), 2) + power(x_0 - least(greatest(x_0, min_fs), max_fs + 1), 2)) AS d0, sqrt(power(y_1 - least(greatest(y_1, min_ss), max_ss + 1), 2) + power(x_1 - least(greatest(x_1, min_fs), max_fs + 1), 2)) AS d1 FROM s, p), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY index ORDER BY d0 + d1, panel_id) AS k FROM d), "
    "e AS (SELECT *, d0 <= d1 AS f, CASE WHEN d0 <= d1 THEN x_0 ELSE x_1 END AS nx, CASE WHEN d0 <= d1 THEN y_0 ELSE y_1 END AS ny, CASE WHEN d0 <= d1 THEN x_1 ELSE x_0 END AS ox, CASE WHEN d0 <= d1 THEN y_1 ELSE y_0 END AS oy FROM b WHERE k = 1), "
    "g AS (SELECT index, f, (ny - min_ss) * ss_x + (nx - min_fs) * fs_x + corner_x + 0.5 - lx AS x, (ny - min_ss) * ss_y + (nx - min_fs) * fs_y + corner_y + 0.5 - ly AS y, (oy - ny) * ss_x + (ox - nx) * fs_x AS dx, (oy - ny) * ss_y + (ox - nx) * fs_y AS dy FROM e, lo) "
    f"SELECT index, {s6('0.1 * CASE WHEN f THEN x ELSE x + dx END')} AS x_0, {s6('0.1 * CASE WHEN f THEN y ELSE y + dy END')} AS y_0, {s6('0.1 * CASE WHEN f THEN x + dx ELSE x END')} AS x_1, {s6('0.1 * CASE WHEN f THEN y + dy ELSE y END')} AS y_1 FROM g"
)


@query(TO_STREAKS)
def streaks_to_detector(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("index"), F.lit(0).alias("module_id"), *((F.col("s_suppkey") % k).cast("double").alias(c) for c, k in (("x_0", 7), ("y_0", 5), ("x_1", 6), ("y_1", 8))))
    return rounded(geometry.to_patterns(geometry.to_streaks(s, panels(spark)), 0.1), "x_0", "y_0", "x_1", "y_1")


# vectors, rotations, crystals


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"))
    return c.select("i", ((F.col("i") % 89) * 0.07).alias("a"), (0.1 + (F.col("i") % 83) * 0.035).alias("b"), ((F.col("i") % 97) * 0.06).alias("c"))


ANG = "an AS (SELECT c_custkey AS i, (c_custkey % 89) * 0.07::DOUBLE AS a, 0.1::DOUBLE + (c_custkey % 83) * 0.035::DOUBLE AS b, (c_custkey % 97) * 0.06::DOUBLE AS c FROM customer)"


def abc() -> v.Vec:
    return v.columns("a", "b", "c")


@query(
    f"WITH {ANG} SELECT i, {s6('cos(a) * cos(c) - sin(a) * sin(c) * cos(b)')} AS Rxx, {s6('sin(a) * cos(c) + cos(a) * sin(c) * cos(b)')} AS Rxy, {s6('sin(c) * sin(b)')} AS Rxz, {s6('-cos(a) * sin(c) - sin(a) * cos(c) * cos(b)')} AS Ryx, "
    f"{s6('-sin(a) * sin(c) + cos(a) * cos(c) * cos(b)')} AS Ryy, {s6('cos(c) * sin(b)')} AS Ryz, {s6('sin(a) * sin(b)')} AS Rzx, {s6('-cos(a) * sin(b)')} AS Rzy, {s6('cos(b)')} AS Rzz FROM an"
)
def euler_matrix(spark, sf_dir):
    names = [f"R{x}{y}" for x in "xyz" for y in "xyz"]
    return rounded(angles(spark, sf_dir).select("i", *v.flat(v.euler_matrix(*abc()))), *names)


@query(f"WITH {ANG} SELECT i, {s6('a')} AS phi1, {s6('b')} AS phi, {s6('c')} AS phi2 FROM an WHERE a > 0 AND c > 0 AND a < 6.28 AND c < 6.28")
def euler_round_trip(spark, sf_dir):
    found = v.euler_angles(v.euler_matrix(*abc()))
    rows = angles(spark, sf_dir).where("a > 0 and c > 0 and a < 6.28 and c < 6.28")
    return rounded(rows.select("i", *(x.alias(n) for x, n in zip(found, ("phi1", "phi", "phi2"), strict=True))), "phi1", "phi", "phi2")


@query(f"WITH {ANG} SELECT i, {s6('b')} AS theta, {s6('c / 2')} AS alpha FROM an WHERE b < 3 AND c / 2 BETWEEN 0.1 AND 3")
def tilt_round_trip(spark, sf_dir):
    rows = angles(spark, sf_dir).where("b < 3 and c / 2 between 0.1 and 3")
    found = v.tilt_angles(v.tilt_matrix(F.col("b"), F.col("c") / 2, F.col("a") / 4))
    return rounded(rows.select("i", found[0].alias("theta"), found[1].alias("alpha")), "theta", "alpha")


@query(
    f"WITH {ANG}, k AS (SELECT i, a - 1 AS x, b - 2 AS y FROM an), n AS (SELECT *, sqrt(power(x - 0.1, 2) + power(y - 0.2, 2) + 4) AS n FROM k) SELECT i, {s6('(x - 0.1) / n')} AS kx, {s6('(y - 0.2) / n')} AS ky, {s6('2 / n')} AS kz, {s6('x')} AS back_x, {s6('y')} AS back_y FROM n"
)
def detector_wave_vectors(spark, sf_dir):
    source = (F.lit(0.1), F.lit(0.2), F.lit(-2.0))
    k = v.det_to_k(F.col("a") - 1, F.col("b") - 2, source)
    back = v.k_to_det(k, source)
    rows = angles(spark, sf_dir).select("i", *(x.alias(n) for x, n in zip((*k, *back), ("kx", "ky", "kz", "back_x", "back_y"), strict=True)))
    return rounded(rows, "kx", "ky", "kz", "back_x", "back_y")


@query(f"WITH {ANG} SELECT i, {s6('a + 3')} AS la, {s6('b + 4')} AS lb, {s6('c + 5')} AS lc, 1.4::DOUBLE AS alpha, 1.5::DOUBLE AS beta, 1.7::DOUBLE AS gamma, 1.0::DOUBLE AS one FROM an")
def unit_cell_round_trip(spark, sf_dir):
    basis = v.cell_to_basis((F.col("a") + 3, F.col("b") + 4, F.col("c") + 5), (F.lit(1.4), F.lit(1.5), F.lit(1.7)))
    sizes, corners = v.unit_cell(basis)
    one = v.dot(v.reciprocate(basis)[2], basis[2])
    rows = angles(spark, sf_dir).select("i", *(x.alias(n) for x, n in zip((*sizes, *corners, one), ("la", "lb", "lc", "alpha", "beta", "gamma", "one"), strict=True)))
    return rounded(rows, "la", "lb", "lc", "alpha", "beta", "gamma", "one")


@query(f"WITH {ANG} SELECT i, {s6('abs(a - 3)')} AS l1, {s6('power(b - 1, 2)')} AS l2, {s6('ln(cosh(c - 2))')} AS lc, {s6('sqrt(a * a + b * b + c * c)')} AS r, {s6('CASE WHEN 1 - power(a / 9, 2) - power(b / 4, 2) > 0 THEN sqrt(1 - power(a / 9, 2) - power(b / 4, 2)) ELSE 0 END')} AS kz FROM an")
def losses_and_spheres(spark, sf_dir):
    size = v.to_spherical(abc())[0]
    kz = v.kxy_to_k(F.col("a") / 9, F.col("b") / 4)[2]
    rows = angles(spark, sf_dir).select("i", v.LOSSES["l1"](F.col("a") - 3).alias("l1"), v.LOSSES["l2"](F.col("b") - 1).alias("l2"), v.LOSSES["log_cosh"](F.col("c") - 2).alias("lc"), size.alias("r"), kz.alias("kz"))
    return rounded(rows, "l1", "l2", "lc", "r", "kz")


# lattices and indexing


def crystals(spark: SparkSession) -> DataFrame:
    rows = [(0, 0.11, 0.01, 0.0, 0.0, 0.12, 0.02, 0.01, 0.0, 0.14), (1, 0.1, 0.0, 0.03, 0.02, 0.13, 0.0, 0.0, -0.01, 0.15)]
    return spark.createDataFrame(rows, "index long, " + ", ".join(f"{c} double" for c in AXES))


X_SQL = f"x(index, {', '.join(AXES)}) AS (VALUES (0, 0.11, 0.01, 0.0, 0.0, 0.12, 0.02, 0.01, 0.0, 0.14), (1, 0.1, 0.0, 0.03, 0.02, 0.13, 0.0, 0.0, -0.01, 0.15))"
HKL = f"{X_SQL}, g AS (SELECT h::INT AS h, k::INT AS k, l::INT AS l FROM (SELECT unnest(range(-6, 7)) AS h), (SELECT unnest(range(-6, 7)) AS k), (SELECT unnest(range(-6, 7)) AS l) WHERE h <> 0 OR k <> 0 OR l <> 0), q AS (SELECT index, h, k, l, h * a_x + k * b_x + l * c_x AS qx, h * a_y + k * b_y + l * c_y AS qy, h * a_z + k * b_z + l * c_z AS qz FROM g, x)"


@query(f"WITH {HKL} SELECT DISTINCT h, k, l FROM q WHERE sqrt(qx * qx + qy * qy + qz * qz) < 0.3")
def hkl_in_ball(spark, sf_dir):
    return indexing.hkl_in_ball(spark, crystals(spark), 0.3)


@query(f"WITH {HKL}, b AS (SELECT DISTINCT h, k, l FROM q WHERE sqrt(qx * qx + qy * qy + qz * qz) < 0.3) SELECT index::BIGINT AS index, h, k, l, {s6('qx')} AS qx, {s6('qy')} AS qy, {s6('qz')} AS qz FROM q JOIN b USING (h, k, l)")
def hkl_to_q(spark, sf_dir):
    xtals = crystals(spark)
    rlp = indexing.hkl_range(indexing.hkl_in_ball(spark, xtals, 0.3), xtals, [0, 1])
    back = indexing.collapse(indexing.q_to_hkl(rlp.select("index", "qx", "qy", "qz"), xtals))
    return rounded(indexing.hkl_to_q(back, xtals), "qx", "qy", "qz")


def shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") % 2).alias("index"), F.col("p_partkey").alias("streak_id"), (F.col("p_size") * 0.001).alias("min_res"), (F.col("p_size") * 0.001 + 0.002).alias("max_res"))


CAND = f"WITH {HKL}, b AS (SELECT DISTINCT h, k, l FROM q WHERE sqrt(qx * qx + qy * qy + qz * qz) < 0.3), u AS (SELECT p_partkey % 2 AS index, p_partkey AS streak_id, p_size * 0.001 AS lo, p_size * 0.001 + 0.002 AS hi FROM part) SELECT u.index::BIGINT AS index, streak_id, h, k, l FROM q JOIN b USING (h, k, l) JOIN u ON u.index = q.index AND qx * qx + qy * qy + qz * qz > lo AND qx * qx + qy * qy + qz * qz < hi"


@query(CAND)
def candidates(spark, sf_dir):
    xtals = crystals(spark)
    rlp = indexing.hkl_range(indexing.hkl_in_ball(spark, xtals, 0.3), xtals, [0, 1])
    return indexing.candidates(rlp, shells(spark, sf_dir)).select("index", "streak_id", "h", "k", "l")


@query(CAND)
def candidates_by_cells(spark, sf_dir):
    xtals = crystals(spark)
    rlp = indexing.hkl_range(indexing.hkl_in_ball(spark, xtals, 0.3), xtals, [0, 1])
    return indexing.candidates(rlp, shells(spark, sf_dir), cell=0.002).select("index", "streak_id", "h", "k", "l")


@query(f"WITH {SEG}, b AS (SELECT index, row, min((x_0, part)) AS m FROM seg GROUP BY ALL) SELECT index, row, m[1] AS loss, m[2] AS part FROM b")
def best_candidates(spark, sf_dir):
    rows = lines(spark, sf_dir).select("index", F.col("row").alias("streak_id"), F.col("part").alias("h"), F.lit(0).alias("k"), F.lit(0).alias("l"), F.col("x_0").alias("loss"))
    return indexing.best_hkl(rows).select("index", F.col("streak_id").alias("row"), "loss", F.col("h").alias("part"))


@query("SELECT o_orderkey AS index, coalesce(avg(l_quantity), 0) AS loss FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def loss_per_pattern(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("index"), F.col("l_quantity").alias("loss"))
    return indexing.per_pattern(rows, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("index")))


@query("SELECT epoch(date_trunc('day', ts))::BIGINT AS start, count(*) AS events FROM events GROUP BY 1")
def hit_rate(spark, sf_dir):
    return detect.hit_rate(table(spark, sf_dir, "events").select("ts")).withColumn("start", F.unix_timestamp("start"))


# whole plans

FINDER = cfg.StreakFinder(streaks=cfg.StreakGrowth(xtol=1.0, vmin=1.0, min_size=1.5, nfa=1), peaks=cfg.Regions(npts=2))


@query()
def detect_streaks(spark, sf_dir):
    made = pipelines.detect_streaks(blocks_of(spark, sf_dir), metadata(frames(spark, sf_dir)), FINDER, modules=1)
    return rounded(made, "x_0", "y_0", "x_1", "y_1", "log_p", "min_support")


@query(f"{BASE}, {REG}, {MOM}, {AXIS} SELECT frame AS index, 0 AS module_id, {s6('cx + hw * cos(th)')} AS x_0, {s6('cy + hw * sin(th)')} AS y_0, {s6('cx - hw * cos(th)')} AS x_1, {s6('cy - hw * sin(th)')} AS y_1 FROM t")
def detect_regions(spark, sf_dir):
    px = frames(spark, sf_dir)
    finder = cfg.RegionFinder(regions=cfg.Regions(vmin=1.25, npts=3))
    return rounded(pipelines.detect_regions(blocks_of(spark, sf_dir), metadata(px), finder), "x_0", "y_0", "x_1", "y_1")


@query(f"WITH {PX}, m AS (SELECT module, ss, fs, median(value) AS f, bool_and(value >= 60 AND value < 142) AS mask FROM px GROUP BY ALL) SELECT module, ss, fs, mask, {s6('CASE WHEN mask THEN sqrt(f) ELSE 0 END')} AS std, CASE WHEN mask THEN f ELSE 0 END AS flatfield FROM m")
def create_metadata(spark, sf_dir):
    made = pipelines.create_metadata(frames(spark, sf_dir), cfg.Metadata(mask=cfg.Mask("range", vmin=60, vmax=142)))
    return rounded(made, "std")


@query()
def create_metalist(spark, sf_dir):
    px = frames(spark, sf_dir)
    n = px.agg(F.max("frame")).first()[0] + 1
    _, _, _, ratios = pipelines.create_metalist(px, n, 25, 25, cfg.Metadata(background=cfg.Background("mean-poisson")))
    return rounded(ratios, "ratio")


LENS = indexing.Lens((0.0, 0.0, -0.11), (-0.0005, 0.0005, -0.0005, 0.0005), -0.1)


def sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two patterns of short streaks for each 24 suppliers."""
    return streaks_of(table(spark, sf_dir, "supplier"))


def streaks_of(supplier: DataFrame) -> DataFrame:
    block, place = F.expr("(s_suppkey - 1) div 24"), (F.col("s_suppkey") - 1) % 24 + 1
    s = supplier.select((2 * block + F.col("s_suppkey") % 2).alias("index"), F.col("s_suppkey").alias("streak_id"), place.alias("place"))
    angle, far = F.col("streak_id") * 2.399, 0.012 + F.col("place") * 0.0008
    x, y = far * F.cos(angle), far * F.sin(angle)
    return s.select("index", "streak_id", (x - 0.002 * F.sin(angle)).alias("x_0"), (y + 0.002 * F.cos(angle)).alias("y_0"), (x + 0.002 * F.sin(angle)).alias("x_1"), (y - 0.002 * F.cos(angle)).alias("y_1"))


SKY = (
    "t AS (SELECT 2 * ((s_suppkey - 1) // 24) + s_suppkey % 2 AS index, s_suppkey AS streak_id, s_suppkey * 2.399::DOUBLE AS an, 0.012::DOUBLE + ((s_suppkey - 1) % 24 + 1) * 0.0008::DOUBLE AS r FROM supplier), "
    "sky AS (SELECT index, streak_id, r * cos(an) - 0.002 * sin(an) AS x_0, r * sin(an) + 0.002 * cos(an) AS y_0, r * cos(an) + 0.002 * sin(an) AS x_1, r * sin(an) - 0.002 * cos(an) AS y_1 FROM t)"
)
CAPS = (
    f"WITH {SKY}, e AS (SELECT 0.0005 / sqrt(2 * 0.0005 * 0.0005 + 0.11 * 0.11) AS k), "
    "m AS (SELECT *, (x_0 + x_1) / 2 AS mx, (y_0 + y_1) / 2 AS my, sqrt(x_0 * x_0 + y_0 * y_0 + 0.01) AS n0, sqrt(x_1 * x_1 + y_1 * y_1 + 0.01) AS n1 FROM sky, e), "
    "o AS (SELECT *, sqrt(mx * mx + my * my + 0.01) AS nm FROM m), "
    "q AS (SELECT index, streak_id, mx / nm AS kx, my / nm AS ky, 0.1 / nm AS kz, least(x_0 / n0, x_1 / n1) + k AS ax, greatest(x_0 / n0, x_1 / n1) - k AS bx, least(y_0 / n0, y_1 / n1) + k AS ay, greatest(y_0 / n0, y_1 / n1) - k AS uy FROM o), "
    "c AS (SELECT *, unnest([ax, ax, bx, bx]) AS qx, unnest([ay, uy, ay, uy]) AS qy FROM q), "
    "r AS (SELECT *, power(qx, 2) + power(qy, 2) + power(kz - sqrt(1 - power(kx - qx, 2) - power(ky - qy, 2)), 2) AS res FROM c) "
    f"SELECT index, streak_id, {s6('kx')} AS kx, {s6('ky')} AS ky, {s6('kz')} AS kz, {s6('min(res)')} AS min_res, {s6('max(res)')} AS max_res FROM r GROUP BY index, streak_id, kx, ky, kz"
)


@query(CAPS)
def uncertainty_caps(spark, sf_dir):
    caps = indexing.patterns_to_uca(sky(spark, sf_dir), LENS).select("index", "streak_id", "kx", "ky", "kz", "min_res", "max_res")
    return rounded(caps, "kx", "ky", "kz", "min_res", "max_res")


@query()
def index_patterns(spark, sf_dir):
    made = pipelines.index_patterns(sky(spark, sf_dir), crystals(spark).where("index = 0"), LENS, cfg.Indexing(shape=(21, 21, 21), width=1.5, threshold=0.6, n_max=5), num_points=40)
    return rounded(made, *AXES)


# more of the operators: lists of regions, groups, numbers of points, projections, losses


@query(DRAW + f"SELECT frame, ss, fs, {s6('sum(gauss)')} AS value FROM k GROUP BY ALL")
def draw_lines_gaussian(spark, sf_dir):
    return rounded(raster.draw_lines(strokes(spark, sf_dir), (12, 60), 1.0, "gaussian", "sum"), "value")


@query(f"{BASE}, {REG}, k AS (SELECT frame, region, row_number() OVER (PARTITION BY frame ORDER BY region) AS k FROM (SELECT DISTINCT frame, region FROM reg WHERE region % 2 = 1)), l AS (SELECT frame, max(region) AS last FROM reg GROUP BY frame) SELECT frame, region, ss, fs FROM reg UNION ALL SELECT frame, k + last AS region, ss, fs FROM reg JOIN k USING (frame, region) JOIN l USING (frame)")
def region_list(spark, sf_dir):
    found = bright_regions(spark, sf_dir)
    return regions.append_regions(found, regions.keep_regions(found, F.col("region") % 2 == 1)).select("frame", "region", "ss", "fs")


@query(f"{BASE}, {REG}, l AS (SELECT frame, max(region) AS last FROM reg GROUP BY frame), w AS (SELECT frame, last AS region, 1 AS k FROM l UNION ALL SELECT frame, 1, 2 FROM l) SELECT frame, k::BIGINT AS region, ss, fs FROM reg JOIN w USING (frame, region)")
def last_and_first_region(spark, sf_dir):
    return regions.take_regions(bright_regions(spark, sf_dir), [-1, 1]).select("frame", "region", "ss", "fs")


@query(f"SELECT p.* FROM ({ORACLES['detect_peaks']}) p JOIN (SELECT frame AS f, floor(count(*) * 0.6) AS most FROM ({ORACLES['detect_peaks']}) GROUP BY frame) ON frame = f WHERE rank <= most")
def best_peaks(spark, sf_dir):
    return regions.best_peaks(detect_peaks(spark, sf_dir), 0.6)


@query("SELECT l_orderkey AS index, round((l_linenumber + l_linenumber + 2) / 2)::INT AS module_id, l_quantity AS x_0, l_tax AS y_0, l_quantity + 1 AS x_1, l_discount AS y_1 FROM lineitem")
def lines_to_streaks(spark, sf_dir):
    li, z = table(spark, sf_dir, "lineitem"), F.col("l_linenumber").cast("double")
    found = li.select(F.col("l_orderkey").alias("frame"), F.col("l_quantity").alias("x_0"), F.col("l_tax").alias("y_0"), z.alias("z_0"), (F.col("l_quantity") + 1).alias("x_1"), F.col("l_discount").alias("y_1"), (z + 2).alias("z_1"))
    return regions.lines_to_streaks(found)


@query(f"WITH {SEG} SELECT index, count(*)::INT AS n, max(x_1) - min(x_0) AS span FROM seg GROUP BY index")
def per_group(spark, sf_dir):
    def spans(rows):
        import pandas as pd

        own = rows.groupby("index", sort=False, dropna=False)
        return pd.DataFrame({"n": own.size(), "span": own.x_1.max() - own.x_0.min()}).reset_index()

    return groups.per_group(lines(spark, sf_dir).select("index", "x_0", "x_1"), spans, "index long, n int, span double", many=True)


@query(f"WITH {SEG} SELECT index, row, part, x_0 + 1 AS x_0, -y_0 AS y_0, x_1, y_1 FROM seg")
def replace_columns(spark, sf_dir):
    return groups.replace(lines(spark, sf_dir), x_0=F.col("x_0") + 1, y_0=-F.col("y_0"))


@query(f"WITH {SEG}, h AS (SELECT index FROM seg GROUP BY index HAVING count(*) > 4) SELECT index, row, part, o_custkey AS pulse_id FROM seg JOIN h USING (index) LEFT JOIN orders ON o_orderkey = index AND o_orderstatus = 'F'")
def detect_hits(spark, sf_dir):
    pulses = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("frame"), F.col("o_custkey").alias("pulse_id"))
    return pipelines.detect_hits(lines(spark, sf_dir), 4, pulses).select("index", "row", "part", "pulse_id")


_P = ORACLES["p_values"]
_P_FULL = _P.rpartition("SELECT frame, region, n, k")[0] + f"SELECT frame, region, n, k, CASE WHEN k = 0 THEN 0 ELSE ln(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)))) END AS lp, any_value(p) AS p FROM q GROUP BY frame, region, n, k"


@query(f"SELECT frame, region, {s6('CASE WHEN p > 0 AND p < 1 THEN lp / ln(p) ELSE 0 END')} AS min_support FROM ({_P_FULL})")
def min_support(spark, sf_dir):
    found = bright_regions(spark, sf_dir)
    p = regions.p_values(found, regions.line_fit(regions.measures(found)), regions.signal_share(signal(spark, sf_dir), 1.5), 1.5, 0.5)
    return rounded(p.select("frame", "region", "min_support"), "min_support")


@query("SELECT l_orderkey AS o, l_linenumber AS n, (l_orderkey % 5 * 6 + l_partkey % 6) * 7 + l_linenumber % 7 AS number, l_orderkey % 5 AS z, l_partkey % 6 AS y, (l_linenumber % 7)::BIGINT AS x, ((l_linenumber - 4) % 3 + 3) % 3 AS back, l_orderkey % 5 < 4 AND l_partkey % 6 - 1 BETWEEN 0 AND 2 AS inside FROM lineitem")
def pixel_numbers(spark, sf_dir):
    at = (F.col("l_orderkey") % 5, F.col("l_partkey") % 6, (F.col("l_linenumber") % 7).cast("long"))
    li = table(spark, sf_dir, "lineitem").withColumn("number", indices.linear(at, (5, 6, 7)))
    z, y, x = indices.point(F.col("number"), (5, 6, 7))
    back, there = indices.modulo(F.col("l_linenumber") - 4, 3), indices.inside((at[0], at[1] - 1), (4, 3))
    return li.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), "number", z.alias("z"), y.alias("y"), x.alias("x"), back.alias("back"), there.alias("inside"))


@query(f"WITH {ANG} SELECT i, CASE WHEN b > 1 THEN {s6('sqrt(b - 1)')} ELSE 0 END AS root, CASE WHEN i % 89 = 0 THEN 0 ELSE {s6('b / a')} END AS ratio, {s6('least(greatest(a, 1.0), 2.0)')} AS rx, {s6('least(greatest(b, 0.5), 1.5)')} AS ry, {s6('2 + b * cos(c) * 0.6 + b * sin(c) * -0.8')} AS cx, {s6('3 + b * cos(c) * 0.8 + b * sin(c) * 0.6')} AS cy FROM an")
def safe_and_circles(spark, sf_dir):
    p = v.project_to_rect(v.columns("a", "b"), (1.0, 0.5), (2.0, 1.5))
    lit = lambda *x: tuple(map(F.lit, x))
    c = v.circle(F.col("b"), lit(2.0, 3.0), lit(0.6, 0.8), lit(-0.8, 0.6), F.col("c"))
    rows = angles(spark, sf_dir).select("i", v.safe_sqrt(F.col("b") - 1).alias("root"), v.safe_divide(F.col("b"), F.col("a")).alias("ratio"), p[0].alias("rx"), p[1].alias("ry"), c[0].alias("cx"), c[1].alias("cy"))
    return rounded(rows, "root", "ratio", "rx", "ry", "cx", "cy")


@query(f"WITH {ANG} SELECT i, {s6('b')} AS theta, {s6('c / 2')} AS alpha, {s6('0.1 + a / 4')} AS beta FROM an WHERE b < 3 AND c / 2 BETWEEN 0.1 AND 3")
def tilt_angles(spark, sf_dir):
    rows = angles(spark, sf_dir).where("b < 3 and c / 2 between 0.1 and 3")
    found = v.tilt_angles(v.tilt_matrix(F.col("b"), F.col("c") / 2, 0.1 + F.col("a") / 4))
    return rounded(rows.select("i", *(x.alias(n) for x, n in zip(found, ("theta", "alpha", "beta"), strict=True))), "theta", "alpha", "beta")


@query(f"WITH {HKL}, b AS (SELECT DISTINCT h, k, l FROM q WHERE sqrt(qx * qx + qy * qy + qz * qz) < 0.3), n AS (SELECT index, h, k, l, qx, qy, qz, sqrt(qx * qx + qy * qy + qz * qz) AS s FROM q JOIN b USING (h, k, l)) SELECT index::BIGINT AS index, h, k, l FROM n WHERE abs(acos(greatest(-1, least(1, -qz / s))) - acos(0.5 * s)) < 0.2")
def hkl_in_aperture(spark, sf_dir):
    xtals = crystals(spark)
    rlp = indexing.hkl_range(indexing.hkl_in_ball(spark, xtals, 0.3), xtals, [0, 1])
    return indexing.hkl_in_aperture(rlp, 0.2).select("index", "h", "k", "l")


WIDE = indexing.Lens((0.0, 0.0, -0.1), (-0.02, 0.02, -0.02, 0.02))
_EDGE = "0.02 / sqrt(0.0108)"
_SIDES = f"e(n, px, py, dx, dy) AS (SELECT n, px * {_EDGE}, py * {_EDGE}, dx * 2 * {_EDGE}, dy * 2 * {_EDGE} FROM (VALUES (0, -1, 1, 1, 0), (1, 1, 1, 0, -1), (2, 1, -1, -1, 0), (3, -1, -1, 0, 1)) s(n, px, py, dx, dy))"


@query(
    f"WITH {HKL}, {_SIDES}, p AS (SELECT DISTINCT h, k, l, qx, qy, qz, qx * qx + qy * qy + qz * qz AS s FROM q WHERE index = 0 AND sqrt(qx * qx + qy * qy + qz * qz) < 0.3), "
    "f AS (SELECT *, -s / 2 - qx * px - qy * py AS f1, qx * dx + qy * dy AS f2 FROM p, e), "
    "quad AS (SELECT *, f2 * f2 + qz * qz * (dx * dx + dy * dy) AS a, f1 * f2 - qz * qz * (px * dx + py * dy) AS b, f1 * f1 - qz * qz * (1 - px * px - py * py) AS c FROM f), "
    "r AS (SELECT *, unnest([0, 1]) AS side FROM quad), t AS (SELECT *, (b + (2 * side - 1) * sqrt(greatest(b * b - a * c, 0))) / CASE WHEN a = 0 THEN 1 ELSE a END AS t FROM r), "
    "w AS (SELECT *, px + t * dx AS kx, py + t * dy AS ky FROM t), z AS (SELECT *, sqrt(greatest(1 - kx * kx - ky * ky, 0)) AS kz FROM w), "
    "m AS (SELECT *, abs(kx * qx + ky * qy + kz * qz + s / 2) AS gap FROM z), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY h, k, l ORDER BY side, n) - 1 AS ends, count(*) OVER (PARTITION BY h, k, l) AS many FROM m WHERE t BETWEEN 0 AND 1 AND gap <= 2e-6) "
    f'SELECT 0::BIGINT AS index, h, k, l, {s6("qx")} AS qx, {s6("qy")} AS qy, {s6("qz")} AS qz, ends::INT AS "end", {s6("kx")} AS kx, {s6("ky")} AS ky, {s6("kz")} AS kz, {s6("kx + qx")} AS kout_x, {s6("ky + qy")} AS kout_y, {s6("kz + qz")} AS kout_z FROM o WHERE many >= 2 AND ends < 2'
)
def laue_source_lines(spark, sf_dir):
    xtals = crystals(spark).where("index = 0")
    rlp = indexing.hkl_range(indexing.hkl_in_ball(spark, xtals, 0.3), xtals, [0])
    return rounded(indexing.source_lines(rlp, WIDE), "qx", "qy", "qz", "kx", "ky", "kz", "kout_x", "kout_y", "kout_z")


@query(f"WITH {ANG}, k AS (SELECT i, (a - 3) / 20 AS x, (b - 1.5) / 20 AS y, 0.98 + c / 300 AS z FROM an), u AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM k), p AS (SELECT *, least(greatest(x / n, -{_EDGE}), {_EDGE}) AS px, least(greatest(y / n, -{_EDGE}), {_EDGE}) AS py FROM u) SELECT i AS streak_id, {s6('avg(abs(px - x) + abs(py - y) + abs(sqrt(1 - px * px - py * py) - z))')} AS loss FROM p GROUP BY i")
def pupil_losses(spark, sf_dir):
    kin = angles(spark, sf_dir).select(F.lit(0).alias("index"), F.col("i").alias("streak_id"), *(F.lit(1).alias(c) for c in "hkl"), ((F.col("a") - 3) / 20).alias("kin_x"), ((F.col("b") - 1.5) / 20).alias("kin_y"), (0.98 + F.col("c") / 300).alias("kin_z"))
    return rounded(indexing.pupil_loss(kin, WIDE).select("streak_id", "loss"), "loss")


@query(f"WITH {SEG} SELECT index, row * 1000000 + part AS streak_id, p AS point, {s6('x_0 + p / 3 * (x_1 - x_0)')} AS x, {s6('y_0 + p / 3 * (y_1 - y_0)')} AS y FROM seg, (SELECT unnest(range(0, 4))::INT AS p)")
def sample_points(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("streak_id", F.col("row") * 1000000 + F.col("part"))
    return rounded(indexing.sample_points(rows, 4), "x", "y")


@query(f"WITH {HKL}, m AS (SELECT p_partkey % 2 AS index, p_partkey // 6 AS streak_id, (p_size % 3)::INT AS h, (p_partkey % 3)::INT AS k, 1 AS l FROM part), j AS (SELECT m.*, sqrt(qx * qx + qy * qy + qz * qz) AS s FROM m JOIN q USING (index, h, k, l)), inside AS (SELECT index, streak_id FROM j GROUP BY ALL HAVING max(s) < 0.28) SELECT index, streak_id, h, k, l FROM m JOIN inside USING (index, streak_id)")
def keep_in_shell(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 2).alias("index"), F.expr("p_partkey div 6").alias("streak_id"), (F.col("p_size") % 3).cast("int").alias("h"), (F.col("p_partkey") % 3).cast("int").alias("k"), F.lit(1).alias("l"))
    return indexing.keep_in_shell(p, crystals(spark), 0.28).select("index", "streak_id", "h", "k", "l")


@query(f"SELECT z::INT AS z, y::INT AS y, x::INT AS x, {s6('z * 0.2::DOUBLE - 1')} AS pz, {s6('y * 0.2::DOUBLE - 1')} AS py, {s6('x * 0.2::DOUBLE - 1')} AS px FROM (SELECT unnest(range(0, 11)) AS z), (SELECT unnest(range(0, 11)) AS y), (SELECT unnest(range(0, 11)) AS x)")
def rotation_grid(spark, sf_dir):
    return rounded(indexing.rotogrid(spark, 11), "pz", "py", "px")


ROTO = (
    "WITH s AS (SELECT s_suppkey // 10 AS index, s_suppkey % 3 AS term, ((s_suppkey % 7) * 0.2 - 0.6 + 1) / 0.2 AS x_0, ((s_suppkey % 5) * 0.2 - 0.4 + 1) / 0.2 AS y_0, ((s_suppkey % 4) * 0.2 - 0.4 + 1) / 0.2 AS z_0, ((s_suppkey % 3) * 0.3 - 0.2 + 1) / 0.2 AS x_1, 1.3 / 0.2 AS y_1, ((s_suppkey % 2) * 0.4 + 1) / 0.2 AS z_1 FROM supplier), "
    "g AS (SELECT *, x_1 - x_0 AS ax, y_1 - y_0 AS ay, z_1 - z_0 AS az FROM s, (SELECT unnest(range(0, 11))::INT AS z), (SELECT unnest(range(0, 11))::INT AS y), (SELECT unnest(range(0, 11))::INT AS x)), "
    "t AS (SELECT *, CASE WHEN ax * ax + ay * ay + az * az > 0 THEN least(greatest(((x - x_0) * ax + (y - y_0) * ay + (z - z_0) * az) / (ax * ax + ay * ay + az * az), 0), 1) ELSE 0 END AS t FROM g), "
    "d AS (SELECT *, sqrt(power(x - x_0 - t * ax, 2) + power(y - y_0 - t * ay, 2) + power(z - z_0 - t * az, 2)) / 1.7 AS r FROM t), "
    "m AS (SELECT index, term, z, y, x, max(exp(-0.5 * power(3 * r, 2)) / sqrt(2 * pi())) AS value FROM d WHERE r <= 1 GROUP BY ALL) "
)


@query(ROTO + f"SELECT index, z, y, x, {s6('sum(value)')} AS value FROM m GROUP BY ALL")
def rotation_map(spark, sf_dir):
    k = F.col("s_suppkey")
    ends = {"x_0": (k % 7) * 0.2 - 0.6, "y_0": (k % 5) * 0.2 - 0.4, "z_0": (k % 4) * 0.2 - 0.4, "x_1": (k % 3) * 0.3 - 0.2, "y_1": F.lit(0.3), "z_1": (k % 2) * 0.4}
    curves = table(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 10").alias("index"), (k % 3).alias("streak_id"), *(x.alias(c) for c, x in ends.items()))
    return rounded(indexing.rotomap(curves, 11, 1.7), "value")


def _turned(i: int, row: str) -> str:
    """One component of a crystal's axis turned by t about the unit axis (nx, ny, nz)."""
    c = "xyz"[i]
    return s6(f"{row}{c} * cos(t) + n{c} * ({row}x * nx + {row}y * ny + {row}z * nz) * (1 - cos(t)) - (n{'xyz'[(i + 1) % 3]} * {row}{'xyz'[(i + 2) % 3]} - n{'xyz'[(i + 2) % 3]} * {row}{'xyz'[(i + 1) % 3]}) * sin(t)")


@query(
    f"WITH {X_SQL}, t AS (SELECT s_suppkey AS index, 0.01 * s_suppkey::DOUBLE AS t, 0.36::DOUBLE AS nx, 0.48::DOUBLE AS ny, 0.8::DOUBLE AS nz FROM supplier), o AS (SELECT * EXCLUDE (index) FROM x WHERE index = 0) SELECT index, 0 AS peak, "
    + ", ".join(f"{_turned(i, f'{a}_')} AS {a}_{c}" for a in "abc" for i, c in enumerate("xyz"))
    + " FROM t, o"
)
def solutions(spark, sf_dir):
    tilts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("index"), F.lit(0).alias("peak"), (0.01 * F.col("s_suppkey")).alias("theta"), F.lit(0.36).alias("ax"), F.lit(0.48).alias("ay"), F.lit(0.8).alias("az"))
    return rounded(indexing.solutions(tilts, crystals(spark).where("index = 0")), *AXES)


@query(f"WITH {ANG}, r AS (SELECT i, (a - 3) / 40 AS x, (b - 1.5) / 40 AS y FROM an), u AS (SELECT *, sqrt(1 - x * x - y * y) AS z FROM r) SELECT i, {s6('0.001 + x / z * 0.15')} AS sx, {s6('0.002 + y / z * 0.15')} AS sy, -0.05::DOUBLE AS sz, {s6('0.003')} AS zero_x, {s6('0.004')} AS zero_y FROM u")
def lens_rays(spark, sf_dir):
    lens = indexing.Lens((0.001, 0.002, -0.2), (0.002, 0.006, 0.001, 0.005), -0.05)
    k = v.kxy_to_k((F.col("a") - 3) / 40, (F.col("b") - 1.5) / 40)
    zero = lens.zero_order()
    rows = angles(spark, sf_dir).select("i", *(x.alias(c) for x, c in zip(lens.kin_to_sample(k), ("sx", "sy", "sz"), strict=True)), F.lit(zero[0]).alias("zero_x"), F.lit(zero[1]).alias("zero_y"))
    return rounded(rows, "sx", "sy", "sz", "zero_x", "zero_y")


# images and fields


@query(f"WITH {PX}, {FIELDS}, m AS (SELECT module, ss, fs, ss <> 3 AS mask FROM px GROUP BY ALL), w AS (SELECT wf, module, ss, fs, CASE WHEN mask THEN value ELSE 0 END AS value FROM wf JOIN m USING (module, ss, fs)) SELECT module, ss, fs, mask, CASE WHEN mask THEN 2.0 ELSE 0 END::DOUBLE AS std, {s6('avg(value)')} AS flatfield FROM w JOIN m USING (module, ss, fs) GROUP BY ALL")
def import_whitefields(spark, sf_dir):
    fields = label_fields(spark, sf_dir)
    meta = fields.select(*PIXEL).distinct().withColumns({"mask": F.col("ss") != 3, "std": F.lit(2.0), "flatfield": F.lit(None).cast("double")})
    return rounded(pixels.import_data(fields, meta)[1].select(*PIXEL, "mask", "std", "flatfield"), "flatfield")


SCALED = (
    f"WITH {PX}, {META}, {FIELDS}, f AS (SELECT wf, module, ss, fs, value AS w FROM wf WHERE wf IN (0, 2)), "
    "c AS (SELECT frame, wf, sum((value - flatfield) * w) / sum(w * w) AS c FROM px JOIN meta USING (module, ss, fs) JOIN f USING (module, ss, fs) GROUP BY ALL), "
    "b AS (SELECT frame, module, ss, fs, sum(c * w) AS b FROM c JOIN f USING (wf) GROUP BY ALL) "
    f"SELECT frame, module, ss, fs, {s6('(value - flatfield - b) / std')} AS value FROM px JOIN meta USING (module, ss, fs) JOIN b USING (frame, module, ss, fs)"
)


def good_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_fields(spark, sf_dir).withColumn("comp", F.col("wf").cast("int"))


@query(SCALED)
def scale_background(spark, sf_dir):
    px = frames(spark, sf_dir)
    return rounded(pipelines.signal(px, metadata(px), cfg.Scaling(method="lsq", good_fields=(0, 2)), 0.0, good_fields(spark, sf_dir)), "value")


@query(SCALED)
def scale_background_blocks(spark, sf_dir):
    """The same from frames in the block layout, whose pixels stay in arrays to the end."""
    made = pipelines.signal_blocks(blocks_of(spark, sf_dir), metadata(frames(spark, sf_dir)), cfg.Scaling(method="lsq", good_fields=(0, 2)), 0.0, good_fields(spark, sf_dir))
    return rounded(to_long(made), "value")


@query(f"{BASE} SELECT frame, module, ss, fs, {s6('value')} AS value FROM snr")
def snr_blocks(spark, sf_dir):
    made = pipelines.signal_blocks(blocks_of(spark, sf_dir), metadata(frames(spark, sf_dir)), cfg.Scaling(), 0.0)
    return rounded(to_long(made), "value")


@query(
    f"WITH {PX}, {FIELDS}, t AS (SELECT wf % 2 AS wf, module, ss, fs, avg(value) - 100 AS d FROM wf GROUP BY ALL), g AS (SELECT sum(p.d * p.d) AS a, sum(p.d * q.d) AS b, sum(q.d * q.d) AS c FROM t p JOIN t q USING (module, ss, fs) WHERE p.wf = 0 AND q.wf = 1), "
    "v AS (SELECT (a + c) / 2 AS m, sqrt(power((a - c) / 2, 2) + b * b) AS r FROM g) "
    f"SELECT 0 AS comp, {s6('(m - r) / (2 * m)')} AS ratio, {s6('m - r')} AS energy FROM v UNION ALL SELECT 1, {s6('(m + r) / (2 * m)')}, {s6('m + r')} FROM v"
)
def pca_of_two(spark, sf_dir):
    fields = label_fields(spark, sf_dir).withColumn("wf", F.col("wf") % 2).groupBy("wf", *PIXEL).agg(F.avg("value").alias("value"))
    eigen, ratios = stats.pca(fields, fields.groupBy(*PIXEL).agg(F.lit(100.0).alias("value")))
    energy = eigen.groupBy("comp").agg(F.sum(F.col("value") * F.col("value")).alias("energy"))
    return rounded(ratios.join(energy, "comp"), "ratio", "energy")


@query(f"WITH {PX}, w AS (SELECT frame // 25 AS wf, module, ss, fs, avg(value) AS value FROM px WHERE frame < (SELECT (max(frame) + 1) // 25 * 25 FROM px) GROUP BY ALL) SELECT module, ss, fs, {s6('avg(value)')} AS flatfield, {s6('sqrt(avg(value))')} AS std FROM w GROUP BY ALL")
def metalist_fields(spark, sf_dir):
    px = frames(spark, sf_dir)
    n = px.agg(F.max("frame")).first()[0] + 1
    merged, _, _, _ = pipelines.create_metalist(px, n, 25, 25, cfg.Metadata(background=cfg.Background("mean-poisson")))
    return rounded(merged.select(*PIXEL, "flatfield", "std"), "flatfield", "std")


# runs of files in the shared folder


def run_folder(spark: SparkSession, sf_dir: str, tag: str, keep: Column | None = None) -> str:
    """The frames as a run of parquet files in the order of their numbers."""
    folder = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    rows = blocks_of(spark, sf_dir).where(F.lit(True) if keep is None else keep).withColumnRenamed("frame", "row")
    bad = F.transform("pixels", lambda x, i: F.when((i == 5) & (F.col("row") % 3 == 0), F.lit(float("nan"))).otherwise(x))
    rows.withColumn("pixels", bad).repartitionByRange(4, "row").sortWithinPartitions("row").write.parquet(folder)
    return folder


_RUN = "100 * (1 + embedding[i]::DOUBLE)"


@query(f"SELECT vec_id AS frame, 0 AS module, ((i - 1) // 8)::INT AS ss, ((i - 1) % 8)::INT AS fs, CASE WHEN i = 6 AND vec_id % 3 = 0 THEN 0 ELSE {s6(_RUN)} END AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS i)")
def run_frames(spark, sf_dir):
    index = runs.build_index(spark, run_folder(spark, sf_dir, "run"))
    return rounded(to_long(runs.load(spark, index)), "value")


@query(f"SELECT vec_id AS frame, 0 AS module, ((i - 1) // 8 - 2)::INT AS ss, ((i - 1) % 8 - 1)::INT AS fs, CASE WHEN i = 6 AND vec_id % 3 = 0 THEN 0 ELSE {s6(_RUN)} END AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS i), (SELECT max(vec_id) AS last FROM embeddings) WHERE vec_id IN (1, 7, last) AND (i - 1) // 8 BETWEEN 2 AND 4 AND (i - 1) % 8 BETWEEN 1 AND 5")
def run_rectangle(spark, sf_dir):
    """Three frames, the last by a negative number, and a rectangle of their pixels."""
    index = runs.build_index(spark, run_folder(spark, sf_dir, "run"))
    return rounded(to_long(runs.load(spark, index, [1, 7, -1], (2, 5, 1, 6))), "value")


@query(f"SELECT vec_id // 2 AS frame, (vec_id % 2)::INT AS module, sum(CASE WHEN i = 6 AND vec_id % 3 = 0 THEN 0 ELSE {s6(_RUN)} END) AS total FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL")
def run_modules(spark, sf_dir):
    """A run with a folder of files for each module: even vectors are module 0, odd ones module 1."""
    folders = [run_folder(spark, sf_dir, f"module-{k}", F.col("frame") % 2 == k) for k in (0, 1)]
    pixels_ = to_long(runs.load_modules(spark, runs.zip_modules(spark, folders)))
    return pixels_.groupBy("frame", "module").agg(F.sum(r6("value")).alias("total"))


@query(f"WITH {PX}, {MAP}, lo AS (SELECT min(x) AS lx, min(y) AS ly FROM mp), i AS (SELECT ss, fs, (y - ly)::INT AS row, (x - lx)::INT AS col FROM mp, lo), z AS (SELECT frame, row, col, arg_max(value, ss * 8 + fs) AS value FROM px JOIN i USING (ss, fs) GROUP BY ALL), e AS (SELECT max(row) AS h, max(col) AS w FROM i) SELECT frame, 0 AS module, row AS ss, col AS fs, {s6('value')} AS value FROM z")
def full_images(spark, sf_dir):
    """Frames assembled from arrays at the scan; places without a pixel are 0 there and left out here, as in the SQL."""
    made = to_long(runs.assembled(blocks_of(spark, sf_dir), panels(spark)))
    return rounded(made.where("value <> 0"), "value")


@query("SELECT vec_id AS frame, count(*) AS n, sum(CASE WHEN vec_id % 10 = 0 THEN 1 ELSE 100 * (1 + embedding[1]::DOUBLE) END) AS first FROM embeddings GROUP BY ALL")
def run_insert(spark, sf_dir):
    """A table of frames of which one in ten is written anew."""
    path = f"{shared_root(spark)}/frames-{uuid.uuid4().hex}"
    block = blocks_of(spark, sf_dir)
    runs.save(block, path)
    runs.save(block.where("frame % 10 = 0").withColumn("pixels", F.transform("pixels", lambda x: F.lit(1.0))), path, "insert")
    return spark.read.parquet(path).groupBy("frame").agg(F.count("*").alias("n"), F.sum(F.get("pixels", F.lit(0))).alias("first"))


@query("SELECT l_orderkey AS index, l_linenumber AS row FROM lineitem")
def compile_tables(spark, sf_dir):
    """Streak tables of three chunks as one."""
    root = f"{shared_root(spark)}/chunks-{uuid.uuid4().hex}"
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("index"), F.col("l_linenumber").alias("row"))
    for k in range(3):
        li.where(F.col("index") % 3 == k).write.parquet(f"{root}/{k}")
    return runs.compile_tables(spark, [f"{root}/{k}" for k in range(3)], f"{root}/all")
