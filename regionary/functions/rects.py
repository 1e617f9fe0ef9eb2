"""Rectangles as struct<x0,y0,x1,y1> columns, y growing downward (SC20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def area(r: Column) -> Column:
    return F.greatest(F.lit(0.0), r["x1"] - r["x0"]) * F.greatest(F.lit(0.0), r["y1"] - r["y0"])


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def intersection(a: Column, b: Column) -> Column:
    return rect(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def overlap_area(a: Column, b: Column) -> Column:
    return area(intersection(a, b))


def contains(outer: Column, inner: Column, slack: float = 0.0) -> Column:
    return (outer["x0"] - slack <= inner["x0"]) & (outer["y0"] - slack <= inner["y0"]) & (inner["x1"] <= outer["x1"] + slack) & (inner["y1"] <= outer["y1"] + slack)


def has_point(r: Column, x: Column, y: Column) -> Column:
    return x.between(r["x0"], r["x1"]) & y.between(r["y0"], r["y1"])


def grown(r: Column, by: float) -> Column:
    return rect(r["x0"] - by, r["y0"] - by, r["x1"] + by, r["y1"] + by)


def union_all(r: Column) -> Column:
    """AG1: the box of a group."""
    return rect(F.min(r["x0"]), F.min(r["y0"]), F.max(r["x1"]), F.max(r["y1"]))


def unpack_colour(c: Column) -> Column:
    """SC21: packed RGB to its parts."""
    return F.struct(F.shiftright(c, 16).bitwiseAND(255).alias("r"), F.shiftright(c, 8).bitwiseAND(255).alias("g"), c.bitwiseAND(255).alias("b"))
