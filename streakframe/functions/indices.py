"""Whole-number coordinates and the linear numbers of points, as expressions. The last axis varies fastest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def modulo(a: Column, n: int) -> Column:
    """The remainder from 0 to n - 1, also of negative numbers."""
    return F.pmod(a, F.lit(n))


def linear(at: tuple[Column, ...], shape: tuple[int, ...]) -> Column:
    """The number of a point."""
    out = at[0].cast("long")
    for x, n in zip(at[1:], shape[1:], strict=True):
        out = out * n + x
    return out


def point(number: Column, shape: tuple[int, ...]) -> tuple[Column, ...]:
    """The point of a number."""
    out, left = [], number
    for n in reversed(shape[1:]):
        out.append(modulo(left, n))
        left = F.floor(left / n)
    return (left, *reversed(out))


def inside(at: tuple[Column, ...], shape: tuple[int, ...]) -> Column:
    """Whether a point lies within a shape."""
    out = F.lit(True)
    for x, n in zip(at, shape, strict=True):
        out = out & (x >= 0) & (x < n)
    return out
