"""Steps of a long calculation that the optimizer keeps apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns (or replaces them) behind a generator of one row.

    Projections in a row are merged, and an expression that is used often is then written out each time; a generator between
    them keeps generated code small and each value computed once.
    """
    made = df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_step"))
    return made.select(*(c for c in df.columns if c not in columns), *(F.col(f"_step.{n}").alias(n) for n in columns))
