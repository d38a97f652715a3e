"""Expressions on points, which are structs of x and y, in the plane."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column | float, y: Column | float) -> Column:
    part = lambda v: v.cast("double") if isinstance(v, Column) else F.lit(float(v))
    return F.struct(part(x).alias("x"), part(y).alias("y"))


def distance(p: Column, x: float, y: float) -> Column:
    """Euclidean distance in the units of the coordinates."""
    dx, dy = p["x"] - F.lit(float(x)), p["y"] - F.lit(float(y))
    return F.sqrt(dx * dx + dy * dy)


def in_box(p: Column, x: float, y: float, radius: float) -> Column:
    """A box a little wider than the circle, so that rounding drops no point on the edge.  Its four comparisons reach the Parquet reader."""
    slack = radius * 1e-9
    sx, sy = radius + slack + 1e-9 * max(1.0, abs(x)), radius + slack + 1e-9 * max(1.0, abs(y))
    return p["x"].between(x - sx, x + sx) & p["y"].between(y - sy, y + sy)


def within(p: Column, x: float, y: float, radius: float) -> Column:
    """Points at most ``radius`` away: the box for pruning, the exact distance for the answer."""
    return in_box(p, x, y, radius) & (distance(p, x, y) <= F.lit(float(radius)))


def cell(p: Column, bits: int = 16) -> Column:
    """Place on a Z-shaped curve over a grid, by which points near each other are stored near each other."""

    def spread(v: Column) -> Column:
        # Sixteen leading bits of a monotone image of the double.
        unit = F.atan(v) / F.lit(3.141592653589794) + F.lit(0.5)
        return F.floor(unit * F.lit(float(2**bits))).cast("long")

    gx, gy = spread(p["x"]), spread(p["y"])
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(gx, k).bitwiseAND(F.lit(1)), 2 * k)).bitwiseOR(F.shiftleft(F.shiftright(gy, k).bitwiseAND(F.lit(1)), 2 * k + 1))
    return out


def minimum_distance(x: float, y: float, low_x: Column, low_y: Column, high_x: Column, high_y: Column) -> Column:
    """Distance from a place to the nearest point of a box."""
    dx = F.greatest(low_x - F.lit(float(x)), F.lit(0.0), F.lit(float(x)) - high_x)
    dy = F.greatest(low_y - F.lit(float(y)), F.lit(0.0), F.lit(float(y)) - high_y)
    return F.sqrt(dx * dx + dy * dy)
