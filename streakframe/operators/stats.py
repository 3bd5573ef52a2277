"""Statistics of image stacks: per-pixel aggregates over frames, projections on fields, principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streakframe.kernels import stats as kernel
from streakframe.schema import PIXEL
from streakframe.session import ship


def median(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.median(value).alias("value"))


def robust_mean(df: DataFrame, by: list[str], value: str = "value", r0: float = 0.0, r1: float = 0.5, n_iter: int = 12, lm: float = 9.0, order: str = "frame") -> DataFrame:
    """(by, mean, std) without outliers: a group's values, in the order of a column, go to the kernel in Arrow batches.

    Groups are gathered by the JVM; a batch of groups of one length is reduced in one numpy call.
    """
    ship(df.sparkSession)
    rows = df.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("double")).alias("_x"))

    @F.pandas_udf("mean double, std double")
    def reduce(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            length = x.map(len)
            out = np.zeros((len(x), 2))
            for n in length.unique():
                at = np.flatnonzero(length == n)
                out[at] = np.stack(kernel.robust_mean(np.stack(x.iloc[at].tolist()), r0, r1, n_iter, lm), axis=1)
            yield pd.DataFrame(out, columns=["mean", "std"])

    return rows.withColumn("_r", reduce("_x")).select(*by, "_r.mean", "_r.std")


def robust_mean_sql(df: DataFrame, by: list[str], value: str = "value", r0: float = 0.0, r1: float = 0.5, n_iter: int = 2, lm: float = 9.0, order: str = "frame") -> DataFrame:
    """The same as windows, one sort for each step: for few steps and groups too large for one array."""
    group = Window.partitionBy(*by)
    mean: Column = F.median(value).over(group)
    rows = df.select(*by, F.col(order).alias("_o"), F.col(value).cast("double").alias("_x")).withColumn("_n", F.count("*").over(group))
    rows = rows.withColumn("_m", F.median("_x").over(group))
    low = F.floor(r0 * F.col("_n"))
    high = F.greatest(F.floor(r1 * F.col("_n")), low + 1)
    for _ in range(n_iter):
        rank = F.row_number().over(group.orderBy(F.pow(F.col("_x") - F.col("_m"), 2), "_o")) - 1
        rows = rows.withColumn("_k", rank)
        mean = F.avg(F.when((F.col("_k") >= low) & (F.col("_k") < high), F.col("_x"))).over(group)
        rows = rows.withColumn("_m", mean).drop("_k")
    rows = rows.withColumn("_e", F.pow(F.col("_x") - F.col("_m"), 2))
    ordered = group.orderBy("_e", "_o")
    rows = rows.withColumn("_k", F.row_number().over(ordered) - 1).withColumn("_s", F.sum("_e").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_cut", F.min(F.when(lm * F.col("_s") < F.col("_k") * F.col("_e"), F.col("_k"))).over(group))
    kept = F.col("_cut").isNull() | (F.col("_k") < F.col("_cut"))
    return rows.groupBy(*by).agg(F.coalesce(F.avg(F.when(kept, F.col("_x"))), F.lit(0.0)).alias("mean"), F.coalesce(F.sqrt(F.avg(F.when(kept, F.col("_e")))), F.lit(0.0)).alias("std"))


def whitefield(pixels: DataFrame, method: str = "median", **settings: float) -> DataFrame:
    """(module, ss, fs, value): background of each pixel over frames."""
    if method == "robust-mean":
        return robust_mean(pixels, list(PIXEL), **settings).select(*PIXEL, F.col("mean").alias("value"))
    how = {"median": F.median("value"), "mean": F.avg("value")}[method]
    return pixels.groupBy(*PIXEL).agg(how.alias("value"))


def deviation(pixels: DataFrame, whitefields: DataFrame, method: str = "poisson", **settings: float) -> DataFrame:
    """(module, ss, fs, std): square root of the mean whitefield, or the robust deviation of the values."""
    if method == "poisson":
        return whitefields.groupBy(*PIXEL).agg(F.sqrt(F.avg("value")).alias("std"))
    if method == "robust-scale":
        return robust_mean(pixels, list(PIXEL), **settings).select(*PIXEL, "std")
    raise ValueError(f"method can't be {method}")


def background(pixels: DataFrame, method: str, **settings: float) -> DataFrame:
    """(module, ss, fs, flatfield, std) by mean-poisson, median-poisson, robust-mean-scale or robust-mean-poisson."""
    if method == "robust-mean-scale":
        return robust_mean(pixels, list(PIXEL), **settings).select(*PIXEL, F.col("mean").alias("flatfield"), "std")
    centre, _, kind = method.rpartition("-")
    if kind != "poisson" or centre not in ("mean", "median", "robust-mean"):
        raise ValueError(f"method can't be {method}")
    return whitefield(pixels, centre, **settings).select(*PIXEL, F.col("value").alias("flatfield"), F.sqrt("value").alias("std"))


def accumulate(metas: DataFrame) -> DataFrame:
    """One pixel table from those of several chunks: good where all are, root of the mean variance."""
    return metas.groupBy(*PIXEL).agg(F.bool_and("mask").alias("mask"), F.sqrt(F.avg(F.col("std") * F.col("std"))).alias("std"))


def lsq(pixels: DataFrame, fields: DataFrame) -> DataFrame:
    """(frame, comp, coef): each field by itself, sum(v w) / sum(w w). fields: (comp, module, ss, fs, value)."""
    w = fields.select("comp", *PIXEL, F.col("value").alias("w"))
    sums = pixels.join(w, list(PIXEL)).groupBy("frame", "comp").agg(F.sum(F.col("value") * F.col("w")).alias("a"), F.sum(F.col("w") * F.col("w")).alias("b"))
    return sums.select("frame", "comp", F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0).alias("coef"))


def robust_lsq(pixels: DataFrame, fields: DataFrame, r0: float = 0.5, r1: float = 0.99, n_iter: int = 3, lm: float = 9.0) -> DataFrame:
    """(frame, comp, coef) without outlying pixels. A frame's values go to the kernel as one array, and those of its fields as another."""
    ship(pixels.sparkSession)
    w = fields.groupBy(*PIXEL).agg(F.sort_array(F.collect_list(F.struct("comp", "value"))).alias("w"))
    joined = pixels.join(w, list(PIXEL)).groupBy("frame").agg(F.sort_array(F.collect_list(F.struct(*PIXEL, F.col("value").cast("double").alias("value"), "w"))).alias("p"))
    names = F.transform(F.get("p", 0)["w"], lambda x: x["comp"].cast("int"))
    rows = joined.select("frame", F.transform("p", lambda p: p["value"]).alias("v"), F.flatten(F.transform("p", lambda p: F.transform(p["w"], lambda x: x["value"].cast("double")))).alias("w"), names.alias("c"))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for frame, value, features, comp in zip(b.frame, b.v, b.w, b.c, strict=True):
                coef = kernel.robust_lsq(features.reshape(len(value), -1).T, value[None], r0, r1, n_iter, lm)[0]
                yield pd.DataFrame({"frame": frame, "comp": comp, "coef": coef})

    return rows.mapInPandas(fitted, "frame long, comp int, coef double")


def _rest(whitefields: DataFrame, flatfield: DataFrame) -> DataFrame:
    base = flatfield.select(*PIXEL, F.col("value").alias("_b"))
    return whitefields.join(base, list(PIXEL)).select("wf", *PIXEL, (F.col("value") - F.col("_b")).alias("v"))


def _products(rows: DataFrame, by: list[str], item: str) -> DataFrame:
    """(i, j, g) for i <= j: the sums of v v' over groups. A group brings its items together in an array, so that pairs are made without a join."""
    first = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(item, "v"))).alias("f")).select("f", F.explode("f").alias("a"))
    pairs = first.select("a", F.explode("f").alias("b")).where(F.col("a")[item] <= F.col("b")[item])
    return pairs.groupBy(F.col("a")[item].alias("i"), F.col("b")[item].alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("g"))


def gram(whitefields: DataFrame, flatfield: DataFrame) -> DataFrame:
    """(i, j, g) for i <= j: products of whitefields less the flatfield. whitefields: (wf, module, ss, fs, value)."""
    return _products(_rest(whitefields, flatfield), list(PIXEL), "wf")


def _solved(products: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names in order, eigenvalues in ascending order and eigenvectors of a matrix of products."""
    rows = products.toArrow()
    i, j, g = (rows[c].to_numpy() for c in "ijg")
    names = np.unique(np.concatenate([i, j]))
    matrix = np.zeros((len(names), len(names)))
    i, j = np.searchsorted(names, i), np.searchsorted(names, j)
    matrix[i, j] = matrix[j, i] = g
    return names, *np.linalg.eigh(matrix)


def pca(whitefields: DataFrame, flatfield: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(comp, module, ss, fs, value) and (comp, ratio), in ascending order of eigenvalues.

    The matrix of products has a row for each whitefield or, if they are fewer, for each pixel: it grows with the lesser of the
    two (a few thousand at most) and is solved on the driver. A component's sign is such that its weight of largest magnitude
    is positive.
    """
    spark = whitefields.sparkSession
    n = whitefields.agg(F.count_distinct("wf")).first()[0]
    if n < 2:
        raise ValueError("principal components need two whitefields or more")
    if flatfield.count() < n:
        return _pca_by_pixels(whitefields, flatfield, n)
    names, values, vectors = _solved(gram(whitefields, flatfield))
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(names))])
    weights = spark.createDataFrame([(int(names[i]), int(j), float(vectors[i, j])) for i in range(len(names)) for j in range(len(names))], "wf long, comp int, w double")
    ratios = spark.createDataFrame([(int(j), float(v)) for j, v in enumerate(values / values.sum())], "comp int, ratio double")
    parts = _rest(whitefields, flatfield).join(F.broadcast(weights), "wf")
    fields = parts.groupBy("comp", *PIXEL).agg(F.sum(F.col("w") * F.col("v")).alias("value"))
    return fields, ratios


def _pca_by_pixels(whitefields: DataFrame, flatfield: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """pca of more whitefields than pixels: X'X has the eigenvalues of XX' that aren't 0, and a field is a vector of it times their root.

    The other components are 0 everywhere.
    """
    spark = whitefields.sparkSession
    ship(spark)
    pixels = sorted(tuple(r) for r in flatfield.select(*PIXEL).collect())
    kinds = ", ".join(f"{c} {flatfield.schema[c].dataType.simpleString()}" for c in PIXEL)
    place = F.broadcast(spark.createDataFrame([(*p, k) for k, p in enumerate(pixels)], f"{kinds}, at int"))
    rows = _rest(whitefields, flatfield).join(place, list(PIXEL)).select("wf", "at", F.col("v").cast("double").alias("v"))
    names, values, vectors = _solved(_products(rows, ["wf"], "at"))
    total, m = values.sum(), len(names)

    def largest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.zeros((len(b), m))
            for k, (at, v) in enumerate(zip(b["at"], b["v"], strict=True)):
                x[k, np.searchsorted(names, at)] = v
            weight = np.nan_to_num(x) @ vectors
            best = np.lexsort((np.broadcast_to(b["wf"].to_numpy()[:, None], weight.shape), -np.abs(weight)), axis=0)[0]
            yield pd.DataFrame({"comp": np.arange(m), "size": np.abs(weight).max(axis=0), "wf": b["wf"].to_numpy()[best], "sign": np.sign(weight[best, np.arange(m)])})

    arrays = rows.groupBy("wf").agg(F.collect_list(F.struct("at", "v")).alias("f")).select("wf", F.col("f.at").alias("at"), F.col("f.v").alias("v"))
    tops = arrays.mapInPandas(largest, "comp int, size double, wf long, sign double")
    signs = {r.comp: r.sign for r in tops.groupBy("comp").agg(F.max_by("sign", F.struct("size", -F.col("wf"))).alias("sign")).collect()}
    found = [(n - m + j, pixels[at], float(signs[j] * np.sqrt(max(values[j], 0)) * vectors[k, j])) for j in range(m) for k, at in enumerate(names)]
    fields = spark.createDataFrame([(comp, *p, value) for comp, p, value in found], f"comp int, {kinds}, value double")
    ratios = spark.createDataFrame([(n - m + j, float(v)) for j, v in enumerate(values / total)], "comp int, ratio double")
    zero = spark.range(n - m).select(F.col("id").cast("int").alias("comp"))
    there = place.where(F.col("at").isin(names.tolist())).select(*PIXEL)
    blank = zero.join(F.broadcast(there), how="cross").withColumn("value", F.lit(0.0))
    return fields.unionByName(blank), ratios.unionByName(zero.withColumn("ratio", F.lit(float(np.zeros(1)[0] / total))))


def project(coefficients: DataFrame, fields: DataFrame, flatfield: DataFrame) -> DataFrame:
    """(frame, module, ss, fs, value): the flatfield and the fields times their coefficients."""
    part = coefficients.join(fields.select("comp", *PIXEL, F.col("value").alias("w")), "comp")
    sums = part.groupBy("frame", *PIXEL).agg(F.sum(F.col("coef") * F.col("w")).alias("_s"))
    return sums.join(flatfield.select(*PIXEL, F.col("value").alias("_b")), list(PIXEL)).select("frame", *PIXEL, (F.col("_s") + F.col("_b")).alias("value"))


def scatter(df: DataFrame, target: list[str], how: str, value: str = "value", order: str = "row") -> DataFrame:
    """add, min, set (the last in order wins) or argmin (the row of the least value) of the values that go to a target."""
    agg = {
        "add": F.sum(value),
        "min": F.min(value),
        "set": F.max_by(value, order),
        "argmin": F.min_by(order, F.struct(value, order)),
    }[how]
    return df.groupBy(*target).agg(agg.alias("value"))
