"""Thick lines as pixels, many segments at once: boxes are laid out as rows and runs of pixels, a bounded number at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Pixels of boxes that are looked at together.
AT_ONCE = 1 << 17

KERNELS = {
    "rectangular": np.ones_like,
    "gaussian": lambda x: np.exp(-0.5 * (3 * x) ** 2) / math.sqrt(2 * math.pi),
    "triangular": lambda x: 1 - x,
    "parabolic": lambda x: 0.75 * (1 - x * x),
    "biweight": lambda x: 15 / 16 * (1 - x * x) ** 2,
}


def _spread(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers low to low + n - 1 of each row, end to end, and their rows."""
    rows = np.repeat(np.arange(len(n)), n)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n - low, n)


def _pieces(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows that hold `most` together, or a single row."""
    ends, start = np.cumsum(n), 0
    while start < len(n):
        end = max(int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), "right")), start + 1)
        yield slice(start, end)
        start = end


def touched(start: np.ndarray, end: np.ndarray, width: np.ndarray, shape: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(segment, pixel, x): linear pixels within a segment's width, and their distance over it. start, end: (axes, segments).

    A segment that isn't finite or has no width touches nothing.
    """
    good = np.flatnonzero(np.isfinite(start).all(axis=0) & np.isfinite(end).all(axis=0) & (width > 0))
    start, along, width = start[:, good], end[:, good] - start[:, good], width[good]
    top = np.array(shape)[:, None] - 1
    low = np.clip(np.ceil(np.minimum(start, end[:, good]) - width), 0, top + 1).astype(int)
    n = np.maximum(np.clip(np.floor(np.maximum(start, end[:, good]) + width), -1, top).astype(int) - low + 1, 0)
    square = along[0] * along[0]
    for a in along[1:]:
        square = square + a * a
    for some in _pieces(n[:-1].prod(axis=0), AT_ONCE):
        at, pixel, dot, away = np.arange(some.start, some.stop), 0, 0.0, []
        for axis in range(len(shape) - 1):
            rows, place = _spread(low[axis, at], n[axis, at])
            at, away = at[rows], [x[rows] for x in away]
            away.append(place - start[axis, at])
            dot = along[axis, at] * away[-1] if axis == 0 else dot[rows] + along[axis, at] * away[-1]
            pixel = place if axis == 0 else pixel[rows] * shape[axis] + place
        for run in _pieces(n[-1, at], AT_ONCE):
            of, place = _spread(low[-1, at[run]], n[-1, at[run]])
            own = at[run][of]
            last = place - start[-1, own]
            long, side = square[own], along[:, own]
            t = np.where(long > 0, (dot[run][of] + side[-1] * last) / np.where(long > 0, long, 1), 0).clip(0, 1)
            gap = (away[0][run][of] - t * side[0]) ** 2
            for axis in range(1, len(shape) - 1):
                gap += (away[axis][run][of] - t * side[axis]) ** 2
            gap += (last - t * side[-1]) ** 2
            x = np.sqrt(gap) / width[own]
            near = np.flatnonzero(x <= 1)
            yield good[own[near]], (pixel[run][of] * shape[-1] + place)[near], x[near]


class Overlap:
    """Sums or maxima by group and pixel. Groups are numbers that come in ascending order; only the last one is kept."""

    def __init__(self, how: str, size: int) -> None:
        self.how, self.size, self.group = how, size, None
        self.pixel, self.value = np.zeros(0, int), np.zeros(0)

    def add(self, group: np.ndarray, pixel: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The groups that are complete: (group, pixel, value), in their order."""
        if not len(group):
            return group, pixel, value
        first, last = int(group[0] if self.group is None else self.group), int(group[-1])
        key = np.concatenate([self.pixel, (group - first) * self.size + pixel])
        value = np.concatenate([self.value, value])
        n = (last - first + 1) * self.size
        if n <= 4 * len(key):
            found = np.flatnonzero(np.bincount(key, minlength=n))
            if self.how == "sum":
                made = np.bincount(key, value, n)[found]
            else:
                made = np.full(n, -np.inf)
                np.maximum.at(made, key, value)
                made = made[found]
        else:
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            found, made = key[starts], (np.add if self.how == "sum" else np.maximum).reduceat(value, starts)
        cut = np.searchsorted(found, (last - first) * self.size)
        self.group, self.pixel, self.value = last, found[cut:] - (last - first) * self.size, made[cut:]
        return found[:cut] // self.size + first, found[:cut] % self.size, made[:cut]

    def rest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.full(len(self.pixel), self.group or 0), self.pixel, self.value
