"""Connected regions of an array, dilation, and what can be measured of a region."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from streakframe.kernels.structure import Structure, views


def dilate(image: np.ndarray, structure: Structure, iterations: int = 1, mask: np.ndarray | None = None) -> np.ndarray:
    """Set pixels and what they reach in so many rounds; with a mask only its pixels are added."""
    out = image.astype(bool)
    for _ in range(iterations):
        grown = out.copy()
        for shift in structure.neighbours:
            if pair := views(out.shape, shift):
                grown[pair[1]] |= out[pair[0]]
        if mask is not None:
            grown &= mask | out
        if (grown == out).all():
            break
        out = grown
    return out


def label(image: np.ndarray, structure: Structure, npts: int = 1) -> np.ndarray:
    """0 or the number of the region, from 1 in the order of the smallest pixel id.

    A region is what hangs together over the structure's shifts with one non-zero value; smaller ones than npts go.
    """
    if structure.rank != image.ndim:
        raise ValueError(f"a structure of rank {structure.rank} on an array of rank {image.ndim}")
    size, on = image.size, image != 0
    root = np.where(on, np.arange(size).reshape(image.shape), size)
    pairs = [p for d in structure.neighbours if (p := views(image.shape, d))]
    links = [(a, b, (image[a] == image[b]) & on[a]) for a, b in pairs]
    while True:
        before = root.copy()
        for here, there, same in links:
            least = np.minimum(root[here], root[there])
            root[there] = np.where(same, least, root[there])
        # each pixel takes over what its root has found meanwhile
        flat = np.append(root.ravel(), size)
        root = flat[flat[:-1]].reshape(image.shape)
        if (root == before).all():
            break
    names, number, count = np.unique(root, return_inverse=True, return_counts=True)
    kept = (names < size) & (count >= npts)
    return np.where(kept, np.cumsum(kept), 0)[number].reshape(image.shape)


def moments(coordinates: np.ndarray, values: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mass, centroid and covariance of points, negative values counting as 0. Without mass: the first point, no spread."""
    w = np.maximum(values, 0.0)
    mass = float(w.sum())
    if mass <= 0:
        return 0.0, coordinates[0].astype(float), np.zeros((coordinates.shape[1],) * 2)
    origin = coordinates[0].astype(float)
    away = coordinates - origin
    mean = w @ away / mass
    return mass, origin + mean, (away * w[:, None]).T @ away / mass - np.outer(mean, mean)


def line_fit(coordinates: np.ndarray, values: np.ndarray) -> np.ndarray:
    """End points (2, rank) of the major axis, the far end along the axis first. Axes are as given; x is the last, y before.

    The axis lies in the plane of x and y; other coordinates stay at the centroid.
    """
    _, centre, spread = moments(coordinates, values)
    xx, yy, xy = spread[-1, -1], spread[-2, -2], spread[-1, -2]
    angle = 0.5 * math.atan2(2 * xy, xx - yy)
    root = math.sqrt(4 * xy * xy + (xx - yy) ** 2)
    half = math.sqrt(max(0.0, 2 * math.log(2) * (xx + yy + root)))
    step = np.zeros(len(centre))
    step[-1], step[-2] = half * math.cos(angle), half * math.sin(angle)
    return np.stack([centre + step, centre - step])


def distance(points: np.ndarray, ends: np.ndarray, clamped: bool = True) -> np.ndarray:
    """Of points to the segment between two ends, or to its line."""
    along = ends[1] - ends[0]
    square = float(along @ along)
    if square == 0:
        return np.linalg.norm(points - ends[0], axis=1)
    t = (points - ends[0]) @ along / square
    if clamped:
        t = np.clip(t, 0, 1)
    return np.linalg.norm(points - ends[0] - t[:, None] * along, axis=1)


@lru_cache(100_000)
def log_binomial_tail(n: int, k: int, p: float) -> float:
    """log of the chance of k or more hits among n, each with chance p."""
    if k <= 0 or p >= 1:
        return 0.0
    if k > n or p <= 0:
        return -math.inf
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    top = max(terms)
    return top + math.log(math.fsum(math.exp(t - top) for t in terms))


def log_binomial_tails(n: np.ndarray, k: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log_binomial_tail of many rows in one pass: the terms of all rows end to end, and sums over each row's own."""
    out = np.where((k <= 0) | (p >= 1), 0.0, -np.inf)
    some = np.flatnonzero((k > 0) & (k <= n) & (p > 0) & (p < 1))
    if not len(some):
        return out
    n, k, p = n[some].astype(np.int64), k[some].astype(np.int64), p[some].astype(float)
    factorial = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n.max() + 1)))))
    count = n - k + 1
    first = np.cumsum(count) - count
    row = np.repeat(np.arange(len(n)), count)
    i = np.arange(count.sum()) - first[row] + k[row]
    term = (factorial[n] + n * np.log1p(-p))[row] - factorial[i] - factorial[n[row] - i] + i * (np.log(p) - np.log1p(-p))[row]
    top = np.maximum.reduceat(term, first)
    out[some] = top + np.log(np.add.reduceat(np.exp(term - top[row]), first))
    return out


def p_value(coordinates: np.ndarray, values: np.ndarray, ends: np.ndarray, p0: float, vmin: float, xtol: float) -> float:
    """log chance that so many of a region's pixels near the segment would reach vmin by accident."""
    near = distance(coordinates, ends) < xtol
    return log_binomial_tail(int(near.sum()), int((near & (values >= vmin)).sum()), p0)
