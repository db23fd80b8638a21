"""Planar geometry as column expressions, evaluated inside whole-stage codegen.

Points are pairs of double columns in a projected system (metres). Divisions are guarded, since
division by zero raises in ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(squared_distance(ax, ay, bx, by))


def point_segment_squared(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance of a point to a segment; a segment without length is a point."""
    dx, dy = x2 - x1, y2 - y1
    along = ((px - x1) * dx + (py - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    return squared_distance(px, py, x1 + t * dx, y1 + t * dy)


def _side(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segment_segment_squared(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Squared distance of two segments ``(x1, y1, x2, y2)``: 0 where they cross, else between an end and the other."""
    apart = F.least(
        point_segment_squared(a[0], a[1], *b), point_segment_squared(a[2], a[3], *b),
        point_segment_squared(b[0], b[1], *a), point_segment_squared(b[2], b[3], *a),
    )
    crossing = (_side(*a, b[0], b[1]) * _side(*a, b[2], b[3]) < 0) & (_side(*b, a[0], a[1]) * _side(*b, a[2], a[3]) < 0)
    return F.when(crossing, F.lit(0.0)).otherwise(apart)


def abs_cosine(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Absolute cosine of the angle between two segments; null if either has no length."""
    ax, ay, bx, by = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    size = F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by))
    return F.abs(ax * bx + ay * by) / F.nullif(size, F.lit(0.0))


def along(x1: Column, y1: Column, x2: Column, y2: Column, t: Column) -> tuple[Column, Column]:
    """The point a share ``t`` along a segment."""
    return x1 + t * (x2 - x1), y1 + t * (y2 - y1)


def sound(*cols: Column) -> Column:
    """True where all coordinates are numbers."""
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing (WGS 84, metres) of degrees, by the transverse-Mercator series to sixth order."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    n = F.lit(a) / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    t, c, x = F.tan(phi) * F.tan(phi), ep2 * F.cos(phi) * F.cos(phi), lam * F.cos(phi)
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    x3, x4 = x * x * x, x * x * x * x
    east = 500000.0 + k0 * n * (x + (1 - t + c) * x3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * x4 * x / 120)
    north = k0 * (m + n * F.tan(phi) * (x * x / 2 + (5 - t + 9 * c + 4 * c * c) * x4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * x4 * x * x / 720))
    return east, north + (10000000.0 if south else 0.0)
