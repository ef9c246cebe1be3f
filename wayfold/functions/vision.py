"""Pinhole, quaternion, box and vector arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import is_finite


def backproject(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    """Camera-space point of a pixel and a depth; null without a finite positive depth."""
    point = F.struct(((u - cx) / fx * depth).alias("x"), ((v - cy) / fy * depth).alias("y"), depth.alias("z"))
    return F.when(is_finite(depth) & (depth > 0), point)


def rotate(q: tuple[Column, Column, Column, Column], v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """v turned by the unit quaternion (x, y, z, w)."""
    (x, y, z, w), (a, b, c) = q, v
    tx, ty, tz = 2 * (y * c - z * b), 2 * (z * a - x * c), 2 * (x * b - y * a)
    return a + w * tx + y * tz - z * ty, b + w * ty + z * tx - x * tz, c + w * tz + x * ty - y * tx


def angle_deg(p: list[Column], q: list[Column]) -> Column:
    """Smallest angle between two orientations, unit quaternions, in degrees; q and -q are the same."""
    dot_ = sum((a * b for a, b in zip(p, q, strict=True)), F.lit(0.0))
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(dot_))))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of box structs, in 32-bit floats; 0 for an empty union."""
    f = lambda s, n: s[n].cast("float")
    width = F.greatest(F.lit(0.0).cast("float"), F.least(f(a, "right_px"), f(b, "right_px")) - F.greatest(f(a, "left_px"), f(b, "left_px")))
    height = F.greatest(F.lit(0.0).cast("float"), F.least(f(a, "bottom_px"), f(b, "bottom_px")) - F.greatest(f(a, "top_px"), f(b, "top_px")))
    area = lambda s: (f(s, "right_px") - f(s, "left_px")) * (f(s, "bottom_px") - f(s, "top_px"))
    union = area(a) + area(b) - width * height
    return F.when(union <= 0, F.lit(0.0).cast("float")).otherwise(width * height / union)


def dot(a: Column, b: Column) -> Column:
    """Products in 32-bit floats, summed in 64-bit."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale).cast("float")


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: (x.cast("double") / n).cast("float")))
