"""Boxes (x0, y0, x1, y1 as shares of the page) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    return both / (area(a) + area(b) - both)


def vertical_overlap(a: Box, b: Box) -> Column:
    """Shared height as a share of the shorter one."""
    shared = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return shared / F.least(a[3] - a[1], b[3] - b[1])


def contains_point(b: Box, x: Column, y: Column) -> Column:
    return (b[0] <= x) & (x <= b[2]) & (b[1] <= y) & (y <= b[3])
