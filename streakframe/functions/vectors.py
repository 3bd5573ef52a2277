"""Vectors, matrices and segments as tuples of columns; every function here is an expression that Catalyst compiles.

Vec: three columns. Matrix: three rows of three columns. Segment: x_0, y_0, x_1, y_1.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, ...]
Matrix = tuple[Vec, Vec, Vec]


def columns(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def matrix(prefix: str = "", names: list[str] | None = None) -> Matrix:
    """From nine flat columns: given names, or prefix + xx, xy ... zz."""
    names = names or [f"{prefix}{a}{b}" for a in "xyz" for b in "xyz"]
    c = columns(*names)
    return c[0:3], c[3:6], c[6:9]


def flat(m: Matrix, prefix: str = "R") -> list[Column]:
    return [m[i][j].alias(f"{prefix}{a}{b}") for i, a in enumerate("xyz") for j, b in enumerate("xyz")]


def dot(a: Vec, b: Vec) -> Column:
    return reduce(Column.__add__, [x * y for x, y in zip(a, b, strict=True)])


def cross(a: Vec, b: Vec) -> Vec:
    return tuple(a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1)))


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def subtract(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(k: Column | float, a: Vec) -> Vec:
    return tuple(x * k for x in a)


def unit(a: Vec) -> Vec:
    return tuple(safe_divide(x, norm(a)) for x in a)


def matmul(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(dot(row, tuple(r[j] for r in b)) for j in range(3)) for row in a)


def row_times(v: Vec, m: Matrix) -> Vec:
    return tuple(dot(v, tuple(r[j] for r in m)) for j in range(3))


def inverse(m: Matrix) -> Matrix:
    """By cofactors: columns of the inverse are cross products of rows."""
    rows = [cross(m[1], m[2]), cross(m[2], m[0]), cross(m[0], m[1])]
    det = dot(m[0], rows[0])
    return tuple(tuple(rows[j][i] / det for j in range(3)) for i in range(3))


def safe_sqrt(x: Column) -> Column:
    return F.when(x > 0, F.sqrt(x)).otherwise(0.0)


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(x, lit(low)), lit(high))


def project_to_rect(p: Vec, low: Vec, high: Vec) -> Vec:
    return tuple(clip(x, a, b) for x, a, b in zip(p, low, high, strict=True))


def circle(radius: Column, centre: Vec, one: Vec, two: Vec, angle: Column) -> Vec:
    return add(add(scale(radius * F.cos(angle), one), scale(radius * F.sin(angle), two)), centre)


def kxy_to_k(x: Column, y: Column) -> Vec:
    return x, y, safe_sqrt(1 - x * x - y * y)


# rotations


def about_x(angle: Column) -> Matrix:
    """Passive rotation of the frame about x."""
    zero, one, c, s = F.lit(0.0), F.lit(1.0), F.cos(angle), F.sin(angle)
    return (one, zero, zero), (zero, c, s), (zero, -s, c)


def about_z(angle: Column) -> Matrix:
    zero, one, c, s = F.lit(0.0), F.lit(1.0), F.cos(angle), F.sin(angle)
    return (c, s, zero), (-s, c, zero), (zero, zero, one)


def euler_matrix(phi1: Column, phi: Column, phi2: Column) -> Matrix:
    """Bunge convention: about z by phi1, about the new x by phi, about the new z by phi2."""
    return matmul(matmul(about_z(phi2), about_x(phi)), about_z(phi1))


def euler_angles(m: Matrix) -> Vec:
    """Bunge angles; where phi is 0 or pi, phi2 is 0. phi1 and phi2 are in [0, 2 pi)."""
    phi = F.acos(clip(m[2][2], -1.0, 1.0))
    zero, straight = phi < 1e-8, F.abs(phi - math.pi) <= 1e-8 + 1e-5 * math.pi
    first = F.when(zero, F.atan2(-m[1][0], m[0][0])).when(straight, F.atan2(m[1][0], m[0][0])).otherwise(F.atan2(m[2][0], -m[2][1]))
    second = F.when(zero | straight, 0.0).otherwise(F.atan2(m[0][2], m[1][2]))
    turn = lambda a: F.when(a < 0, a + 2 * math.pi).otherwise(a)
    return turn(first), phi, turn(second)


def axis_of(alpha: Column, beta: Column) -> Vec:
    """Unit vector at polar angle alpha from z and azimuth beta."""
    return F.sin(alpha) * F.cos(beta), F.sin(alpha) * F.sin(beta), F.cos(alpha)


def rotation(theta: Column, axis: Vec) -> Matrix:
    """Rotation by theta about a unit vector (Rodrigues)."""
    c, s = F.cos(theta), F.sin(theta)
    zero = F.lit(0.0)
    turn = ((zero, -axis[2], axis[1]), (axis[2], zero, -axis[0]), (-axis[1], axis[0], zero))
    return tuple(tuple((c if i == j else zero) + axis[i] * axis[j] * (1 - c) + s * turn[i][j] for j in range(3)) for i in range(3))


def tilt_matrix(theta: Column, alpha: Column, beta: Column) -> Matrix:
    return rotation(theta, axis_of(alpha, beta))


def tilt_angles(m: Matrix) -> Vec:
    """Angle and axis (alpha, beta) of a proper rotation. Symmetric matrices too: a half turn's axis is the largest column of m + 1."""
    v = (m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1])
    size, trace = norm(v), m[0][0] + m[1][1] + m[2][2]
    theta = F.atan2(size, trace - 1)
    # a half turn has m + 1 = 2 n n^T
    diagonal = F.array(*(m[i][i] for i in range(3)))
    largest = F.array_position(diagonal, F.array_max(diagonal)) - 1
    half = [F.get(F.array(*(m[i][j] + (1.0 if i == j else 0.0) for j in range(3))), largest.cast("int")) for i in range(3)]
    symmetric = size < 1e-12
    axis = tuple(F.when(symmetric, h).otherwise(x) for h, x in zip(half, v, strict=True))
    return theta, F.acos(clip(safe_divide(axis[2], norm(axis)), -1.0, 1.0)), F.atan2(axis[1], axis[0])


def tilt_from_point(p: Vec) -> tuple[Column, Vec]:
    """Angle and axis of a point of the rotation cube."""
    size = norm(p)
    return 4 * F.tan(size), unit(p)


def tilt_to_point(theta: Column, axis: Vec) -> Vec:
    return scale(theta, axis)


# detector and wave-vectors


def det_to_k(x: Column, y: Column, source: Vec) -> Vec:
    """Unit wave-vector from a source point (its z is negative upstream) to a point of the detector plane."""
    return unit((x - source[0], y - source[1], -source[2]))


def k_to_det(k: Vec, source: Vec) -> tuple[Column, Column]:
    at = lambda i: F.when(k[2] != 0, source[i] - k[i] / k[2] * source[2]).otherwise(0.0)
    return at(0), at(1)


def k_to_smp(k: Vec, z: Column, source: Vec) -> Vec:
    at = lambda i: source[i] + safe_divide(k[i], k[2]) * (z - source[2])
    return at(0), at(1), z


# segments


def length(s: Vec) -> Column:
    return F.hypot(s[2] - s[0], s[3] - s[1])


def intersection(a: Vec, b: Vec) -> tuple[Column, Column]:
    """Where the lines of two segments meet; null for parallel ones."""
    ax, ay, bx, by = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    below = ax * by - ay * bx
    t = F.when(below != 0, ((b[0] - a[0]) * by - (b[1] - a[1]) * bx) / below)
    return a[0] + t * ax, a[1] + t * ay


def project(s: Vec, x: Column, y: Column, clamped: bool = True) -> tuple[Column, Column]:
    """The point of a segment (or of its line) nearest to x, y."""
    ax, ay = s[2] - s[0], s[3] - s[1]
    t = safe_divide((x - s[0]) * ax + (y - s[1]) * ay, ax * ax + ay * ay)
    t = clip(t, 0.0, 1.0) if clamped else t
    return s[0] + t * ax, s[1] + t * ay


def distance(s: Vec, x: Column, y: Column, clamped: bool = True) -> Column:
    px, py = project(s, x, y, clamped)
    return F.hypot(x - px, y - py)


def concentric(s: Vec, x: Column, y: Column, threshold: float = 0.33) -> Column:
    """True for segments that lie about across the direction to a centre.

    The vector from the centre to the mid-point loses its part along the segment's normal; what is left must be a small share.
    """
    nx, ny = s[3] - s[1], s[0] - s[2]
    rx, ry = 0.5 * (s[0] + s[2]) - x, 0.5 * (s[1] + s[3]) - y
    k = safe_divide(nx * rx + ny * ry, nx * nx + ny * ny)
    return safe_divide(F.hypot(rx - k * nx, ry - k * ny), F.hypot(rx, ry)) < threshold


def sample(s: Vec, t: Column | float) -> tuple[Column, Column]:
    """The point at share t of a segment."""
    return s[0] + t * (s[2] - s[0]), s[1] + t * (s[3] - s[1])


# crystals


def unit_cell(m: Matrix) -> tuple[Vec, Vec]:
    """Lengths of the three axes, and the angles between b c, c a and a b."""
    sizes = tuple(norm(r) for r in m)
    angle = lambda i, j: F.acos(clip(dot(m[i], m[j]) / (sizes[i] * sizes[j]), -1.0, 1.0))
    return sizes, (angle(1, 2), angle(2, 0), angle(0, 1))


def cell_to_basis(lengths: Vec, angles: Vec) -> Matrix:
    """Axes of a cell: the first along x, the second in the plane of x and y. Angles in radians."""
    a, b, c = lengths
    ca, cb, cg = (F.cos(x) for x in angles)
    sg, zero = F.sin(angles[2]), F.lit(0.0)
    y = (ca - cb * cg) / sg
    return (a, zero, zero), (b * cg, b * sg, zero), (c * cb, c * y, c * safe_sqrt(1 - cb * cb - y * y))


def reciprocate(m: Matrix) -> Matrix:
    """Rows of the reciprocal basis: r_i . m_j is 1 where i = j, else 0."""
    inv = inverse(m)
    return tuple(tuple(inv[j][i] for j in range(3)) for i in range(3))


def to_spherical(v: Vec) -> Vec:
    """Length, polar angle from z, azimuth."""
    size = norm(v)
    return size, F.acos(clip(safe_divide(v[2], size), -1.0, 1.0)), F.atan2(v[1], v[0])


def from_spherical(size: Column, theta: Column, phi: Column) -> Vec:
    return scale(size, axis_of(theta, phi))


LOSSES = {"l1": F.abs, "l2": lambda x: x * x, "log_cosh": lambda x: F.log(F.cosh(x))}
