"""Neighbourhoods on a grid, and how to walk an array along one of their shifts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product

import numpy as np


@dataclass(frozen=True)
class Structure:
    """All shifts d with |d_n| <= radii[n] on every axis and a sum of |d_n| of at most connectivity; the origin is one."""

    radii: tuple[int, ...]
    connectivity: int

    def __post_init__(self) -> None:
        object.__setattr__(self, "radii", tuple(int(r) for r in self.radii))

    @cached_property
    def shifts(self) -> list[tuple[int, ...]]:
        """In row-major order, the origin included."""
        spans = (range(-r, r + 1) for r in self.radii)
        return [d for d in product(*spans) if sum(map(abs, d)) <= self.connectivity]

    @property
    def neighbours(self) -> list[tuple[int, ...]]:
        return [d for d in self.shifts if any(d)]

    @property
    def rank(self) -> int:
        return len(self.radii)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(2 * r + 1 for r in self.radii)

    def __len__(self) -> int:
        return len(self.shifts)

    def __iter__(self) -> Iterator[tuple[int, ...]]:
        return iter(self.shifts)

    def expand_dims(self, rank: int) -> Structure:
        """The same in an array of higher rank: no reach along the leading axes."""
        if rank < self.rank:
            raise ValueError("a structure can't lose axes by expanding")
        return Structure((0,) * (rank - self.rank) + self.radii, self.connectivity)

    def squeeze(self) -> Structure:
        """Without leading axes of no reach."""
        radii = self.radii
        while len(radii) > 1 and radii[0] == 0:
            radii = radii[1:]
        return Structure(radii, self.connectivity)

    def to_array(self) -> np.ndarray:
        out = np.zeros(self.shape, bool)
        for d in self.shifts:
            out[tuple(x + r for x, r in zip(d, self.radii, strict=True))] = True
        return out


def views(shape: tuple[int, ...], shift: tuple[int, ...]) -> tuple[tuple[slice, ...], tuple[slice, ...]] | None:
    """Slices (here, there) such that there is here moved by shift, both in bounds; None if nothing stays in bounds."""
    if any(abs(d) >= n for d, n in zip(shift, shape, strict=True)):
        return None
    here = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(shift, shape, strict=True))
    there = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(shift, shape, strict=True))
    return here, there
