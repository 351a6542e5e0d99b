"""Plane geometry as column expressions. Points are pairs of columns, angles are in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the eight compass points, clockwise from north.
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to the nearest place of a segment; a segment of no length is a point."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    along = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, square), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def apply_affine(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """``m`` is [a, b, c, d, e, f]: x' = a x + b y + e, y' = c x + d y + f."""
    return m[0] * x + m[1] * y + m[4], m[2] * x + m[3] * y + m[5]


def invert_affine(m: Column, least: float = 1e-12) -> Column:
    """The inverse, or null where the matrix is singular."""
    det = m[0] * m[3] - m[1] * m[2]
    a, b, c, d = m[3] / det, -m[1] / det, -m[2] / det, m[0] / det
    return F.when(F.abs(det) > least, F.array(a, b, c, d, -(a * m[4] + b * m[5]), -(c * m[4] + d * m[5])))


def orientation(dx: Column, dy: Column) -> Column:
    """Direction of an undirected line, from 0 up to 180."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def angle_delta(a: Column, b: Column) -> Column:
    """Least angle between two undirected lines."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def bearing(dx: Column, dy: Column) -> Column:
    """Clockwise from north, from 0 up to 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def compass(degrees: Column) -> Column:
    names = F.array(*[F.lit(n) for n in COMPASS])
    return F.get(names, F.pmod(F.floor((degrees + 22.5) / 45).cast("int"), F.lit(8)))


def line_intersection(a: tuple[Column, ...], b: tuple[Column, ...], least: float = 1e-9) -> tuple[Column, Column]:
    """Where two lines through (x0, y0, x1, y1) meet; null where they are parallel."""
    ax, ay, bx, by = a
    cx, cy, dx, dy = b
    denom = (ax - bx) * (cy - dy) - (ay - by) * (cx - dx)
    p, q = ax * by - ay * bx, cx * dy - cy * dx
    meets = F.abs(denom) >= least
    return F.when(meets, (p * (cx - dx) - (ax - bx) * q) / denom), F.when(meets, (p * (cy - dy) - (ay - by) * q) / denom)


def inside_box(x: Column, y: Column, box: Column, pad: float = 0.0) -> Column:
    """``box`` is [x0, y0, x1, y1]; its edges are inside."""
    return (x >= box[0] - pad) & (x <= box[2] + pad) & (y >= box[1] - pad) & (y <= box[3] + pad)
