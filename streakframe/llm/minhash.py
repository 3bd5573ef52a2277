"""One-permutation MinHash in the JVM, with settings that make a wanted collision likely.

A set's hashes fall into bins by their size as numbers, and each bin keeps its least hash: a band of one row. A short set
that lies in a long one meets it in a band unless every hash the two share has a lesser neighbour in its bin. With r bins
for each hash of the long set one hash stays with chance r (1 - exp(-1/r)), so m shared ones are all lost with chance
(1 - r (1 - exp(-1/r)))^m: the more is shared, the fewer bins do, and the smaller is the share of hashes that is kept.
Short sets are therefore partitioned by size (powers of two), and each partition has its own number of bins. Numbers of bins
differ by powers of two, so that each partition's bands are a part of those of the next smaller one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from streakframe.llm.common import let

#: From this share on bands aren't worth their cost: all hashes are looked up.
WHOLE = 0.9


def kept_share(bins: float) -> float:
    """The share of a set's hashes that is least in its bin, with so many bins for each hash."""
    return bins * -math.expm1(-1 / bins)


def miss(shared: int, bins: float) -> float:
    """How likely no band holds any of so many shared hashes, with so many bins for each hash of the longer set."""
    return (1 - kept_share(bins)) ** shared


def bins_for(shared: int, chance: float) -> float:
    """The fewest bins for each hash of the longer set with which a collision is missed with no more than this chance."""
    low, high = 1e-6, 1e6
    for _ in range(100):
        middle = math.sqrt(low * high)
        low, high = (low, middle) if miss(shared, middle) <= chance else (middle, high)
    return high


@dataclass(frozen=True)
class SizeClass:
    """Short sets of low < hashes <= high, and the bins for each hash of a longer set; None: all hashes are looked up."""

    low: int
    high: int
    bins: float | None


def size_classes(sizes: list[int], share: float, chance: float) -> list[SizeClass]:
    """Partitions by powers of two for sets of these sizes, smallest first. A match shares at least `share` of the short set."""
    tops = sorted({1 << max(0, n - 1).bit_length() for n in sizes if n > 0})
    wanted = {top: bins_for(math.ceil(share * (top // 2 + 1) - 1e-9), chance) for top in tops}
    whole = [top for top in tops if kept_share(wanted[top]) > WHOLE]
    banded = [top for top in tops if top not in whole]
    least = wanted[banded[-1]] if banded else 1.0
    classes = [SizeClass(top // 2, top, None) for top in whole]
    return classes + [SizeClass(top // 2, top, least * 2 ** math.ceil(math.log2(wanted[top] / least) - 1e-9)) for top in banded]


def bins_of(size: Column, bins: float, least: float) -> Column:
    """Bins for a set of this size: documents are partitioned by size, four partitions to a power of two.

    bins is `least` times a power of two, and so is the result a partition's own number times that power.
    """
    top = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(size, F.lit(1)).cast("double")) * 4) / 4)
    return (F.ceil(top * least).cast("long") * F.lit(round(bins / least)).cast("long")).cast("long")


def bin_of(h: Column, bins: Column) -> Column:
    """Which of the bins a hash falls into; ascending with the hash."""
    return F.shiftright((F.shiftright(h, 32) + F.lit(1 << 31)) * bins, 32)


def signature(hashes: Column, bins: Column) -> Column:
    """The least hash of each bin that has one, ascending, of hashes in ascending order."""
    first = lambda z: F.filter(z["all"], lambda h, i: (i == 0) | (bin_of(h, z["bins"]) != bin_of(F.get(z["all"], i - 1), z["bins"])))
    return let(F.struct(hashes.alias("all"), bins.alias("bins")), first)


def nested_signatures(hashes: Column, size: Column, classes: list[SizeClass], least: float | None = None) -> Column:
    """A struct of c0, c1, ...: for each class that has bands its signature of a set of so many hashes, given in ascending order.

    The first class is that of the smallest sets, which has most bins; each signature is made from the one before. least: the
    bins of the last class of all, where `classes` are some of them.
    """
    banded = [c for c in classes if c.bins is not None]
    least = least or (banded[-1].bins if banded else None)

    def nest(done: list[Column], left: list[SizeClass]) -> Column:
        if not left:
            return F.struct(*(c.alias(f"c{k}") for k, c in enumerate(done))) if done else F.struct(F.lit(0).alias("none"))
        found = signature(done[-1] if done else hashes, bins_of(size, left[0].bins, least))
        return let(found, lambda x: nest([*done, x], left[1:]))

    return nest([], banded)


def finest(classes: list[SizeClass]) -> list[SizeClass]:
    """The classes without bands, and of the others the one of the smallest sets, of whose bands those of the rest are a part."""
    banded = [c for c in classes if c.bins is not None]
    return [c for c in classes if c.bins is None] + banded[:1]


def meeting(classes: list[SizeClass], by_class: dict[SizeClass, set[int]], whole: str = "s", sig: str = "sig") -> Column:
    """The hashes by which a set meets the short sets: of `whole` for classes without bands, of the signatures for the others."""
    parts, k = [], 0
    for c in classes:
        source, k = (whole, k) if c.bins is None else (f"{sig}.c{k}", k + 1)
        if by_class.get(c):
            parts.append(f"filter({source}, h -> h in ({','.join(f'{h}L' for h in sorted(by_class[c]))}))")
    return F.expr(f"array_distinct(concat({', '.join(parts)}))") if parts else F.array().cast("array<long>")


def signature_of(hashes: list[int], bins: int) -> list[int]:
    """The same as signature() for a few hashes on the driver."""
    least: dict[int, int] = {}
    for h in sorted(hashes):
        least.setdefault(((h >> 32) + (1 << 31)) * bins >> 32, h)
    return sorted(least.values())
