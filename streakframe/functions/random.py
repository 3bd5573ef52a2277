"""Random tables for starting points and tests: the same for the same seed.

draws() makes its numbers on the executors: a row's number is a hash of the seed and the row, so that no task and no partition
decides it, and each distribution is the inverse of its distribution function or a sum or ratio of a few such numbers.
Small tables, and any other distribution of numpy's generator, are drawn on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakframe.schema import AXES

ROTATION = [f"R{a}{b}" for a in "xyz" for b in "xyz"]


_GRAIN = 1 << 52


def uniform(seed: int, *key: Column | str, stream: int = 0) -> Column:
    """A number in (0, 1) that the seed, the stream and the key decide."""
    return (F.pmod(F.xxhash64(*key, F.lit(seed), F.lit(stream)), F.lit(_GRAIN)) + 0.5) / _GRAIN


def _normal(u: Callable[[], Column]) -> Column:
    return F.sqrt(-2 * F.log(u())) * F.cos(2 * math.pi * u())


def _erlang(u: Callable[[], Column], shape: int) -> Column:
    total = F.log(u())
    for _ in range(int(shape) - 1):
        total = total + F.log(u())
    return -total


#: Each takes a source of uniform numbers and its parameters. Gamma, beta, chi-square, F and t take whole shapes.
DISTRIBUTIONS: dict[str, Callable[..., Column]] = {
    "uniform": lambda u, low=0.0, high=1.0: low + (high - low) * u(),
    "normal": lambda u, loc=0.0, scale=1.0: loc + scale * _normal(u),
    "lognormal": lambda u, mean=0.0, sigma=1.0: F.exp(mean + sigma * _normal(u)),
    "exponential": lambda u, scale=1.0: -scale * F.log(u()),
    "laplace": lambda u, loc=0.0, scale=1.0: loc + scale * (F.log(u()) - F.log(u())),
    "logistic": lambda u, loc=0.0, scale=1.0: loc + scale * (lambda x: F.log(x / (1 - x)))(u()),
    "gumbel": lambda u, loc=0.0, scale=1.0: loc - scale * F.log(-F.log(u())),
    "standard_cauchy": lambda u: F.tan(math.pi * (u() - 0.5)),
    "pareto": lambda u, a: F.pow(u(), F.lit(-1.0 / a)) - 1,
    "power": lambda u, a: F.pow(u(), F.lit(1.0 / a)),
    "rayleigh": lambda u, scale=1.0: scale * F.sqrt(-2 * F.log(u())),
    "weibull": lambda u, a: F.pow(-F.log(u()), F.lit(1.0 / a)),
    "triangular": lambda u, left, mode, right: (
        lambda x, c: F.when(x < c, left + F.sqrt(x * (right - left) * (mode - left))).otherwise(right - F.sqrt((1 - x) * (right - left) * (right - mode)))
    )(u(), (mode - left) / (right - left)),
    "gamma": lambda u, shape, scale=1.0: scale * _erlang(u, shape),
    "beta": lambda u, a, b: (lambda x, y: x / (x + y))(_erlang(u, a), _erlang(u, b)),
    "chisquare": lambda u, df: 2 * _erlang(u, df // 2) if df % 2 == 0 else 2 * _erlang(u, df // 2) + F.pow(_normal(u), 2) if df > 1 else F.pow(_normal(u), 2),
    "f": lambda u, dfnum, dfden: (DISTRIBUTIONS["chisquare"](u, dfnum) / dfnum) / (DISTRIBUTIONS["chisquare"](u, dfden) / dfden),
    "standard_t": lambda u, df: _normal(u) / F.sqrt(DISTRIBUTIONS["chisquare"](u, df) / df),
    "binomial": lambda u, n, p: sum(((u() < p).cast("double") for _ in range(int(n) - 1)), (u() < p).cast("double")),
    "geometric": lambda u, p: F.ceil(F.log(u()) / math.log1p(-p)).cast("double"),
    "integers": lambda u, low, high: F.floor(low + (high - low) * u()).cast("double"),
}


def draws(spark: SparkSession, rows: int, columns: list[str], seed: int, how: str = "uniform", **settings: float) -> DataFrame:
    """(i, columns) for any number of rows, drawn where they are needed."""
    out = spark.range(rows).select(F.col("id").alias("i"))
    made = {}
    for k, name in enumerate(columns):
        streams = iter(range(k << 20, (k + 1) << 20))
        # each use takes a stream of its own; a stream used twice in one expression would be one number
        made[name] = DISTRIBUTIONS[how](lambda s=streams: uniform(seed, "i", stream=next(s)), **settings)
    return out.withColumns(made)


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """The rows in an order that the seed and their key decide: adds `place`, unique if the key is."""
    return df.withColumn("place", F.xxhash64(*key, F.lit(seed)))


def arrays(spark: SparkSession, rows: int, columns: list[str], seed: int, how: str = "uniform", **settings: float) -> DataFrame:
    """(i, columns): numbers of any distribution of numpy's generator."""
    values = getattr(np.random.default_rng(seed), how)(size=(rows, len(columns)), **settings)
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(values)], "i long, " + ", ".join(f"{c} double" for c in columns))


def rotations(spark: SparkSession, rows: int, seed: int) -> DataFrame:
    """(i, Rxx to Rzz): uniform over all rotations, from unit quaternions."""
    q = np.random.default_rng(seed).normal(size=(rows, 4))
    w, x, y, z = (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    out = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], axis=1)
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(out)], "i long, " + ", ".join(f"{c} double" for c in ROTATION))


def orientations(spark: SparkSession, basis: list[list[float]], rows: int, seed: int) -> DataFrame:
    """xtals: one crystal in random orientations."""
    turned = [np.asarray(basis) @ np.array(r[1:]).reshape(3, 3) for r in rotations(spark, rows, seed).collect()]
    return spark.createDataFrame([(k, *map(float, m.ravel())) for k, m in enumerate(turned)], "index long, " + ", ".join(f"{c} double" for c in AXES))
