"""Column expressions for rigid motions, boxes, planes and weights: all stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
ROT = [[f"r{i}{j}" for j in range(3)] for i in range(3)]


def vec(prefix: str = "", names: Sequence[str] = ("x", "y", "z")) -> Vec:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def minus(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    n = norm(a)
    return tuple(F.when(n > 0, c / n).otherwise(F.lit(0.0)) for c in a)


def sq_dist(a: Vec, b: Vec) -> Column:
    d = minus(a, b)
    return dot(d, d)


def matrix(prefix: str = "") -> list[list[Column]]:
    return [[F.col(prefix + n) for n in row] for row in ROT]


def apply(m: list[list[Column]], v: Vec) -> Vec:
    return tuple(dot(tuple(row), v) for row in m)


def transposed(m: list[list[Column]]) -> list[list[Column]]:
    return [[m[j][i] for j in range(3)] for i in range(3)]


def forward(v: Vec, m: list[list[Column]] | None = None, t: Vec | None = None) -> Vec:
    """R v + t with the pose columns r00..r22, tx, ty, tz."""
    t = t or vec("t")
    return tuple(c + s for c, s in zip(apply(m or matrix(), v), t, strict=True))


def inverse(v: Vec, m: list[list[Column]] | None = None, t: Vec | None = None) -> Vec:
    """R'(v - t): rotations are orthogonal."""
    return apply(transposed(m or matrix()), minus(v, t or vec("t")))


def yaw_matrix(a: Column) -> list[list[Column]]:
    z, o = F.lit(0.0), F.lit(1.0)
    return [[F.cos(a), -F.sin(a), z], [F.sin(a), F.cos(a), z], [z, z, o]]


def roll_pitch_yaw(r: Column, p: Column, y: Column) -> list[list[Column]]:
    """Rz(y) Ry(p) Rx(r)."""
    cr, sr, cp, sp, cy, sy = F.cos(r), F.sin(r), F.cos(p), F.sin(p), F.cos(y), F.sin(y)
    return [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]


def axes_matrix(first: Vec, up: Vec) -> list[list[Column]]:
    """Rows: the first axis made orthogonal to ``up``, their cross product, ``up``."""
    z = unit(up)
    along = dot(first, z)
    x = unit(tuple(c - along * u for c, u in zip(first, z, strict=True)))
    return [list(x), list(cross(z, x)), list(z)]


def plane_distance(v: Vec, plane: Vec, d: Column) -> Column:
    return F.abs(dot(plane, v) + d)


def in_rectangle(p: tuple[Column, Column], corners: Sequence[tuple[Column, Column]]) -> Column:
    """Whether a point lies in a rectangle of four corners in turn: the same side of all edges."""
    side = []
    for i in range(4):
        (ax, ay), (bx, by) = corners[i], corners[(i + 1) % 4]
        side.append((bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax))
    left, right = F.lit(True), F.lit(True)
    for s in side:
        left, right = left & (s >= 0), right & (s <= 0)
    return left | right


def in_box_frame(v: Vec) -> Vec:
    """A point in the axes of a box (cx, cy, cz, yaw)."""
    return apply(transposed(yaw_matrix(F.col("yaw"))), minus(v, vec("c")))


def box_inside(local: Vec, half: Vec) -> Column:
    return (F.abs(local[0]) < half[0]) & (F.abs(local[1]) < half[1]) & (F.abs(local[2]) < half[2])


def box_outside(local: Vec, half: Vec) -> Column:
    return (F.abs(local[0]) > half[0]) | (F.abs(local[1]) > half[1]) | (F.abs(local[2]) > half[2])


def beyond(v: Column, o: Column, h: Column) -> Column:
    return F.greatest(F.lit(0.0), F.abs(v - o) - h)


def plate_sq_dist(local: Vec, centre: Vec, half: Vec) -> Column:
    parts = [beyond(v, o, h) for v, o, h in zip(local, centre, half, strict=True)]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def box_sq_dist(local: Vec, half: Vec) -> Column:
    """Squared distance to a solid box."""
    zero = F.lit(0.0)
    return plate_sq_dist(local, (zero, zero, zero), half)


def open_cube_sq_dist(local: Vec, half: Vec) -> Column:
    """Least squared distance to the five plates of a box without its bottom."""
    zero = F.lit(0.0)
    plates = []
    for axis, signs in ((0, (1, -1)), (1, (1, -1)), (2, (1,))):
        for sign in signs:
            centre, size = [zero] * 3, list(half)
            centre[axis], size[axis] = sign * half[axis], zero
            plates.append(plate_sq_dist(local, tuple(centre), tuple(size)))
    return F.least(*plates)


def radial(d: Column, th: float) -> Column:
    return 1 / (1 + d / F.lit(th))


def gaussian(sq: Column, scale: Column | float) -> Column:
    return F.exp(-sq / scale)


def trunc_exp(x: Column, top: float = math.log(1.7976931348623157e308)) -> Column:
    return F.exp(F.least(x, F.lit(top)))


def trunc_log(x: Column, least: float = 2.2250738585072014e-308) -> Column:
    return F.log(F.greatest(x, F.lit(least)))


def angle(c: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def convexity(ni: Vec, nj: Vec, edge: Vec, slack: float = 100 * 2.220446049250313e-16) -> Column:
    """1 for a convex pair, 0 for a concave one, linear between, by the normals' angles with the edge."""
    e = unit(edge)
    theta = angle(dot(ni, e)) - angle(dot(nj, e))
    return F.when(theta < -slack, F.lit(0.0)).when(theta > slack, F.lit(1.0)).otherwise(0.5 * theta / slack + 0.5)


def bump(k: Column, centre: Column, width: float) -> Column:
    """A raised cosine around ``centre``, 0 beyond ``width``."""
    d = F.abs(k - centre)
    return F.when(d < width, 0.5 * (1 + F.cos(math.pi * d / width))).otherwise(F.lit(0.0))


def circular_shift(k: Column, by: Column | int, n: Column | int) -> Column:
    return F.pmod(k + by, F.lit(n) if isinstance(n, int) else n)
