"""Colour conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the conversion's XYZ matrix, row by row, and white point
XYZ = ((0.412453, 0.212671, 0.019224), (0.212671, 0.715160, 0.119193), (0.019334, 0.072169, 0.950227))
STANDARD = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE_X, WHITE_Z = 0.950456, 1.088754
EDGE = 0.008856


def root(t: Column) -> Column:
    return F.when(t > EDGE, F.pow(t, F.lit(1.0 / 3.0))).otherwise(7.787 * t + 16.0 / 116.0)


def rgb_to_lab(r: Column, g: Column, b: Column, matrix: str = "column") -> tuple[Column, Column, Column]:
    """RGB of 0 to 255 to L, a, b; ``matrix`` is ``column`` or ``standard``."""
    rgb = [c.cast("double") / 255.0 for c in (r, g, b)]
    x, y, z = (m[0] * rgb[0] + m[1] * rgb[1] + m[2] * rgb[2] for m in (XYZ if matrix == "column" else STANDARD))
    x, z = x / WHITE_X, z / WHITE_Z
    fx, fy, fz = root(x), root(y), root(z)
    light = F.when(y > EDGE, 116.0 * F.pow(y, F.lit(1.0 / 3.0)) - 16.0).otherwise(903.3 * y)
    return light, 500.0 * (fx - fy), 200.0 * (fy - fz)


def lab_to_rgb(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """The inverse for the standard matrix, clamped to 0 to 255."""
    fy = (light + 16.0) / 116.0
    fx, fz = fy + a / 500.0, fy - b / 200.0
    solve = lambda f: F.when(f > 0.206893, f * f * f).otherwise((f - 16.0 / 116.0) / 7.787)
    x, y, z = solve(fx) * WHITE_X, solve(fy), solve(fz) * WHITE_Z
    rows = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875992, 0.041556), (0.055648, -0.204043, 1.057311))
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), 255.0 * v))
    return tuple(clamp(m[0] * x + m[1] * y + m[2] * z) for m in rows)


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value of 0 to 1; channels cut to whole numbers of 0 to 255."""
    sector = F.floor(h / 60.0).cast("int") % 6
    f = h / 60.0 - F.floor(h / 60.0)
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    order = ((v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q))
    out = []
    for c in range(3):
        e = F.when(sector == 0, order[0][c])
        for k in range(1, 6):
            e = e.when(sector == k, order[k][c])
        out.append(F.floor(255.0 * e).cast("int"))
    return tuple(out)


def value_to_hue(v: Column, low: Column, high: Column, turn: float = 240.0) -> Column:
    """Blue for the least value, red for the greatest."""
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return turn * (1 - (v - low) / span)


def index_to_hue(i: Column, n: Column | int) -> Column:
    return 360.0 * i / (F.lit(n) if isinstance(n, int) else n)


def palette(label: Column, seed: int = 58) -> tuple[Column, Column, Column]:
    """A colour for a label, the same in each run."""
    h = F.xxhash64(label, F.lit(seed))
    return tuple(F.pmod(F.shiftright(h, k), F.lit(256)).cast("int") for k in (0, 16, 32))
