"""Streaks of one frame: peaks in bins, a linelet at each peak, growth of linelets into streaks.

Arrays have the axes (module, ss, fs); points have the same order, so x is the last coordinate. Bins are squares of
`radius` pixels in the plane of a module. A structure reaches along all three axes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from streakframe.kernels.regions import distance, label, line_fit, log_binomial_tail, p_value
from streakframe.kernels.structure import Structure, views

BAD = -1


@dataclass
class Peaks:
    """labels: for each bin BAD, 0 (usable) or a label from 1 on; at[l - 1]: the linear pixel id of label l's peak."""

    labels: np.ndarray
    at: list[int]
    n_seeds: int
    radius: int
    bin_of: dict[int, tuple[int, ...]] = field(default_factory=dict)

    def keep_best(self, quantile: float) -> Peaks:
        """Fewer seeds: the brightest share."""
        return Peaks(self.labels, self.at, int(self.n_seeds * quantile), self.radius, dict(self.bin_of))


def binned_shape(shape: tuple[int, ...], radius: int) -> tuple[int, ...]:
    return (*shape[:-2], -(-shape[-2] // radius), -(-shape[-1] // radius))


def detect_peaks(data: np.ndarray, labeled: np.ndarray, radius: int, vmin: float) -> np.ndarray:
    """For each bin BAD without a labeled pixel; else the id of its brightest local maximum over vmin, else data.size.

    A local maximum is no less than its four neighbours in the plane, all of which exist. Of equals the first by column,
    then row, counts.
    """
    top = data > vmin
    top[..., [0, -1], :] = False
    top[..., [0, -1]] = False
    for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)):
        here, there = views(data.shape, (*(0,) * (data.ndim - 2), dy, dx)) or (None, None)
        if here is not None:
            top[here] &= data[here] >= data[there]
    shape = binned_shape(data.shape, radius)

    def bins(where: np.ndarray) -> tuple[np.ndarray, ...]:
        at = np.nonzero(where)
        return at, np.ravel_multi_index((*at[:-2], at[-2] // radius, at[-1] // radius), shape)

    out = np.full(math.prod(shape), BAD, np.int64)
    out[bins(labeled)[1]] = data.size
    at, owner = bins(top)
    usable = out[owner] != BAD
    at, owner = tuple(a[usable] for a in at), owner[usable]
    order = np.lexsort((at[-2], at[-1], -data[at], owner))
    first = order[np.unique(owner[order], return_index=True)[1]]
    out[owner[first]] = np.ravel_multi_index(tuple(a[first] for a in at), data.shape)
    return out.reshape(shape)


def peak_labels(found: np.ndarray, data: np.ndarray, radius: int) -> Peaks:
    """Labels in descending order of the peaks' values."""
    flat, bright = found.ravel(), data.ravel()
    bins = np.flatnonzero((flat != BAD) & (flat < data.size))
    order = bins[np.argsort(-bright[flat[bins]], kind="stable")]
    labels = np.where(flat == BAD, BAD, 0)
    labels[order] = np.arange(1, len(order) + 1)
    places = {k: np.unravel_index(b, found.shape) for k, b in enumerate(order.tolist(), 1)}
    return Peaks(labels.reshape(found.shape), flat[order].tolist(), len(order), radius, places)


class Finder:
    """The growth of linelets and streaks over the peaks of one frame."""

    def __init__(self, data: np.ndarray, peaks: Peaks, structure: Structure, vmin: float) -> None:
        self.data, self.peaks, self.structure, self.vmin = data, peaks, structure, vmin
        self.linelets: dict[int, np.ndarray] = {}

    def footprint(self, pixel: int) -> np.ndarray:
        """Coordinates of the structure about a pixel, in bounds."""
        at = np.array(np.unravel_index(pixel, self.data.shape)) + np.array(self.structure.shifts)
        return at[((at >= 0) & (at < self.data.shape)).all(axis=1)]

    def linelet(self, pixel: int) -> np.ndarray:
        at = self.footprint(pixel)
        # moments are taken about the peak
        at = at[np.argsort((at != np.unravel_index(pixel, self.data.shape)).any(axis=1), kind="stable")]
        return line_fit(at, self.data[tuple(at.T)])

    def bin(self, at: np.ndarray) -> tuple[int, ...]:
        r = self.peaks.radius
        return (*(int(x) for x in at[:-2]), int(at[-2]) // r, int(at[-1]) // r)

    def step(self, pixel: int, along: np.ndarray) -> np.ndarray:
        """The pixel reached from a peak along a direction, half a pixel beyond the nearest border of its bin."""
        r, at = self.peaks.radius, np.array(np.unravel_index(pixel, self.data.shape))
        length = math.hypot(along[-1], along[-2])
        if length == 0:
            return at
        unit = along[-2:] / length
        reach = float(r)
        for x, u in zip(at[-2:], unit, strict=True):
            if u:
                low = int(x) // r * r - 0.5
                reach = min(reach, ((low + r if u > 0 else low) - x) / u)
        new = at.copy()
        moved = np.rint(at[-2:] + (reach + 0.5) * unit).astype(int)
        new[-2:] = np.clip(moved, 0, np.array(self.data.shape[-2:]) - 1)
        return new

    def _candidate(self, name: int, sign: int) -> tuple[tuple[int, ...], int] | None:
        ends = self.linelets[name]
        pixel = self.peaks.at[name - 1]
        new = self.step(pixel, sign * (ends[1] - ends[0]))
        own, target = self.bin(np.array(np.unravel_index(pixel, self.data.shape))), self.bin(new)
        if target == own:
            return None
        if self.peaks.labels[target] == BAD or self.data[tuple(new)] < self.vmin:
            around = new + np.array(self.structure.neighbours)
            around = around[((around >= 0) & (around < self.data.shape)).all(axis=1)]
            for at in around:
                other = self.bin(at)
                if self.data[tuple(at)] >= self.vmin and other != own and self.peaks.labels[other] != BAD:
                    return other, int(np.ravel_multi_index(tuple(at), self.data.shape))
            return None
        return target, int(np.ravel_multi_index(tuple(new), self.data.shape))

    def fit_linelets(self) -> None:
        """A linelet for each peak, then new peaks ahead of and behind each until a round finds none."""
        peaks = self.peaks
        for name, pixel in enumerate(peaks.at, 1):
            self.linelets[name] = self.linelet(pixel)
        frontier = [(place, sign) for place in sorted(peaks.bin_of.values()) for sign in (-1, 1)]
        seen = set(frontier)
        while frontier:
            found = []
            for place, sign in frontier:
                if candidate := self._candidate(int(peaks.labels[place]), sign):
                    found.append((*candidate, sign))
            following, added = [], False
            for place, pixel, sign in found:
                ends = self.linelet(pixel)
                if not np.any(ends[0] != ends[1]):
                    continue
                name = int(peaks.labels[place])
                if name == 0:
                    peaks.at.append(pixel)
                    name = len(peaks.at)
                    peaks.labels[place], peaks.bin_of[name], self.linelets[name], added = name, place, ends, True
                elif self.data.flat[pixel] > self.data.flat[peaks.at[name - 1]]:
                    peaks.at[name - 1], self.linelets[name] = pixel, ends
                if (place, sign) not in seen:
                    seen.add((place, sign))
                    following.append((place, sign))
            frontier = sorted(following) if added else []

    def _grown(self, ends: np.ndarray, linelet: np.ndarray) -> np.ndarray | None:
        """The segment with its start or end moved out to the linelet's, if that is beyond it."""
        along = ends[1] - ends[0]
        square, t = float(along @ along), (linelet - ends[0]) @ along
        new = ends.copy()
        if t.min() < 0:
            new[0] = linelet[t.argmin()]
        if t.max() > square:
            new[1] = linelet[t.argmax()]
        return new if t.min() < 0 or t.max() > square else None

    def detect(self, xtol: float, nfa: int) -> list[list[int]]:
        """Streaks as lists of labels in order from one end to the other, one from each seed."""
        out = []
        for seed in range(1, self.peaks.n_seeds + 1):
            members, ends, open_ = [seed], self.linelets[seed].copy(), {1: True, -1: True}
            while any(open_.values()):
                for sign in (1, -1):
                    if not open_[sign]:
                        continue
                    last = members[-1] if sign > 0 else members[0]
                    place = self.bin(self.step(self.peaks.at[last - 1], sign * (ends[1] - ends[0])))
                    name = int(self.peaks.labels[place])
                    new = self._grown(ends, self.linelets[name]) if name > 0 and name not in members else None
                    if new is not None:
                        points = np.concatenate([self.linelets[name], *(self.linelets[m] for m in members)])
                        if int((distance(points, new) > xtol).sum()) <= nfa:
                            ends = new
                            members.insert(len(members) if sign > 0 else 0, name)
                            continue
                    open_[sign] = False
            out.append(members)
        return out

    def line(self, members: list[int]) -> np.ndarray:
        """The two ends of all members' linelets that are farthest apart along the seed-to-end direction."""
        points = np.concatenate([self.linelets[m] for m in members])
        along = self.linelets[members[-1]].mean(axis=0) - self.linelets[members[0]].mean(axis=0)
        if not along.any():
            along = points[1] - points[0]
        t = points @ along
        return np.stack([points[t.argmin()], points[t.argmax()]])

    def pixels(self, members: list[int]) -> np.ndarray:
        """Distinct linear ids of the members' footprints."""
        at = np.concatenate([self.footprint(self.peaks.at[m - 1]) for m in members])
        return np.unique(np.ravel_multi_index(tuple(at.T), self.data.shape))

    def n_signal(self, members: list[int]) -> int:
        return int((self.data.flat[self.pixels(members)] >= self.vmin).sum())


    def p_value(self, members: list[int], xtol: float, p0: float) -> float:
        """log chance of a streak's own footprint: its line, fitted to the footprint alone, against what is near it by accident."""
        at = np.stack(np.unravel_index(self.pixels(members), self.data.shape), axis=1)
        values = self.data[tuple(at.T)]
        return p_value(at, values, line_fit(at, values), p0, self.vmin, xtol)


def ranking(n_signal: list[int]) -> np.ndarray:
    """Rank of each streak from 0: more signal first, then the earlier."""
    order = np.lexsort((np.arange(len(n_signal)), -np.asarray(n_signal)))
    out = np.zeros(len(n_signal), int)
    out[order] = np.arange(len(n_signal))
    return out


def paint(finder: Finder, streaks: list[list[int]], ranks: np.ndarray) -> np.ndarray:
    """Each pixel has the least rank + 1 of the streaks that cover it; 0: none."""
    out = np.zeros(finder.data.size, np.int64)
    for k in np.argsort(-ranks):
        out[finder.pixels(streaks[k])] = ranks[k] + 1
    return out.reshape(finder.data.shape)


def find(data: np.ndarray, structure: Structure, vmin: float, npts: int, xtol: float, nfa: int, min_size: float, region_structure: Structure) -> np.ndarray:
    """Streaks of a frame, rows of (module, x_0, y_0, x_1, y_1, log_p, min_support)."""
    labeled = label(data >= vmin, region_structure, npts) > 0
    radius = max(1, structure.connectivity)
    peaks = peak_labels(detect_peaks(data, labeled, radius, vmin), data, radius)
    finder = Finder(data, peaks, structure, vmin)
    finder.fit_linelets()
    streaks = finder.detect(xtol, nfa)
    p0 = float((data >= vmin).mean())
    if not streaks or not 0 < p0 < 1:
        return np.zeros((0, 7))
    painted = paint(finder, streaks, ranking([finder.n_signal(s) for s in streaks]))
    regions = label(painted, Structure((0,) * (data.ndim - 2) + (1, 1), 1), 1)
    rows = []
    at = np.argwhere(regions > 0)
    owner = regions[tuple(at.T)]
    order = np.argsort(owner, kind="stable")
    for own in np.split(at[order], np.flatnonzero(np.diff(owner[order])) + 1):
        values = data[tuple(own.T)]
        ends = line_fit(own, values)
        near = distance(own, ends) < xtol
        log_p = log_binomial_tail(int(near.sum()), int((near & (values >= vmin)).sum()), p0)
        support = log_p / math.log(p0)
        if support >= min_size:
            rows.append((round(float(own[:, 0].mean())), ends[0, -1], ends[0, -2], ends[1, -1], ends[1, -2], log_p, support))
    return np.array(rows).reshape(-1, 7)
