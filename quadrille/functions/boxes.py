"""Boxes in the plane: structs of low_x, low_y, high_x, high_y, edges included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.points import minimum_distance


def box(low_x, low_y, high_x, high_y) -> Column:
    part = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(part(low_x).alias("low_x"), part(low_y).alias("low_y"), part(high_x).alias("high_x"), part(high_y).alias("high_y"))


def box_around(p: Column) -> Column:
    """The box of a point."""
    return box(p["x"], p["y"], p["x"], p["y"])


def area(b: Column) -> Column:
    return (b["high_x"] - b["low_x"]) * (b["high_y"] - b["low_y"])


def merged(a: Column, b: Column) -> Column:
    return box(F.least(a["low_x"], b["low_x"]), F.least(a["low_y"], b["low_y"]), F.greatest(a["high_x"], b["high_x"]), F.greatest(a["high_y"], b["high_y"]))


def enlargement(a: Column, b: Column) -> Column:
    """How much area a box gains by taking in another."""
    return area(merged(a, b)) - area(a)


def intersects(a: Column, b: Column) -> Column:
    return (a["low_x"] <= b["high_x"]) & (b["low_x"] <= a["high_x"]) & (a["low_y"] <= b["high_y"]) & (b["low_y"] <= a["high_y"])


def contains(a: Column, b: Column) -> Column:
    return (a["low_x"] <= b["low_x"]) & (b["high_x"] <= a["high_x"]) & (a["low_y"] <= b["low_y"]) & (b["high_y"] <= a["high_y"])


def meets_circle(b: Column, x: float, y: float, radius: float) -> Column:
    return minimum_distance(x, y, b["low_x"], b["low_y"], b["high_x"], b["high_y"]) <= F.lit(float(radius))


def bounds(df: DataFrame, name: str) -> DataFrame:
    """One row, box: the smallest one around all points of a column; null for no points."""
    x, y = F.col(f"`{name}`")["x"], F.col(f"`{name}`")["y"]
    return df.agg(F.min(x).alias("a"), F.min(y).alias("b"), F.max(x).alias("c"), F.max(y).alias("d")).select(F.when(F.col("a").isNotNull(), box(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).alias("box"))
