"""Boxes: struct<x0, y0, x1, y1> by corners or struct<x, y, w, h>, in percent of a page or pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Corners as percent of the page, to 2 decimals, y first as the line tables hold it."""
    return F.struct(F.round(y0 / height * 100, 2).alias("y0"), F.round(x0 / width * 100, 2).alias("x0"), F.round(y1 / height * 100, 2).alias("y1"), F.round(x1 / width * 100, 2).alias("x1"))


def corners_to_size(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of corner boxes; 0 for disjoint or empty ones."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    both = w * h
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def pixel_ranges(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Pixel bounds of a percent box, truncated."""
    part = lambda v, size: (v / 100 * size).cast("int")
    return F.struct(part(y, height).alias("top"), part(y + h, height).alias("bottom"), part(x, width).alias("left"), part(x + w, width).alias("right"))
