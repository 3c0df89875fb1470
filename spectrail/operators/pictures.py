"""Boxes of detected pictures: whole pixels, overlaps, a detector's square; pixels of a picture: resizing to a square, masking.

The detector itself is a model behind ``extraction.apply_model``; what stands around it is arithmetic.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrail.operators.matching import by_group

LEAST, OVERLAP, MOST = 0.25, 0.45, 1000


def letterbox(width: int, height: int, size: int = 640) -> list[Column]:
    """The corners x0, y0, x1, y1 of a page's boxes in a square of size, into which the page is fitted in proportion and centred."""
    scale = size / max(width, height)
    dx, dy = (size - width * scale) / 2, (size - height * scale) / 2
    return [(F.col(c) * F.lit(scale) + F.lit(d)).alias(c) for c, d in (("x0", dx), ("y0", dy), ("x1", dx), ("y1", dy))]


def whole_boxes(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Corners cut to whole pixels inside the page; boxes without an area, or without a corner, are dropped."""
    inside = [F.greatest(F.lit(0), F.least(F.lit(most), F.col(c).cast("int"))).alias(c) for c, most in (("x0", width), ("y0", height), ("x1", width), ("y1", height))]
    rest = [c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")]
    return boxes.filter("x0 is not null and y0 is not null and x1 is not null and y1 is not null").select(*rest, *inside).filter("x1 > x0 and y1 > y0")


def suppressed(boxes: DataFrame, keys: list[str], tie: str, least: float = LEAST, overlap: float = OVERLAP, most: int = MOST) -> DataFrame:
    """The boxes of a page that a surer one, which itself stays, doesn't overlap by more than overlap of their union; of boxes of at least the
    least confidence, and the surest most of a page, a detector's limit. Equals count in order of tie. Needs confidence, x0, y0, x1, y1."""

    def solve(rows: list[tuple]) -> list[tuple]:
        n = len(keys)
        kept: list[tuple] = []
        for r in rows:
            _, t, x0, y0, x1, y1 = r[n:]
            if len(kept) == most:
                break
            for q in kept:
                w = min(x1, q[n + 4]) - max(x0, q[n + 2])
                h = min(y1, q[n + 5]) - max(y0, q[n + 3])
                if w > 0 and h > 0 and w * h > overlap * ((x1 - x0) * (y1 - y0) + (q[n + 4] - q[n + 2]) * (q[n + 5] - q[n + 3]) - w * h):
                    break
            else:
                kept.append(r)
        return [(*r[:n], r[n + 1]) for r in kept]

    table = boxes.filter(F.col("confidence") >= least).select(*keys, (-F.col("confidence")).alias("__c"), tie, "x0", "y0", "x1", "y1")
    return by_group(table, keys, ["__c", tie], solve, T.StructType([table.schema[k] for k in (*keys, tie)]))


def square(pixels: np.ndarray, size: int = 224) -> np.ndarray:
    """A grey picture fitted in proportion into a white square of size, centred; every pixel is the mean of those it covers."""
    h, w = pixels.shape
    out = np.full((size, size), 255, np.uint8)
    if not h or not w:
        return out
    scale = size / max(h, w)
    hh, ww = max(1, round(h * scale)), max(1, round(w * scale))
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = pixels.astype(np.float64).cumsum(0).cumsum(1)

    def edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        a = np.arange(m) * n // m
        return a, np.maximum((np.arange(1, m + 1) * n + m - 1) // m, a + 1)

    (a, b), (c, d) = edges(h, hh), edges(w, ww)
    area = (b - a)[:, None] * (d - c)[None, :]
    mean = (total[b][:, d] - total[a][:, d] - total[b][:, c] + total[a][:, c]) / area
    top, left = (size - hh) // 2, (size - ww) // 2
    out[top : top + hh, left : left + ww] = np.round(mean).astype(np.uint8)
    return out


def masked(pixels: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The picture with white outside the mask, cropped to the mask; an empty mask leaves the picture as it is."""
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(rows):
        return pixels
    whole = np.where(mask, pixels, 255).astype(np.uint8)
    return whole[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]


def cropped(pixels: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    return pixels[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)]
