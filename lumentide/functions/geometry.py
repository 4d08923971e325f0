"""Rectangles, landmarks and 2 x 3 affine matrices as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LANDMARKS, MOUTH, OUTER_LIPS, FIRST_EYE, SECOND_EYE = 68, (48, 68), (48, 60), (36, 42), (42, 48)


def rect_valid(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Whether a rectangle of positive size lies within the image."""
    return (w > 0) & (h > 0) & (x >= 0) & (y >= 0) & (x + w <= width) & (y + h <= height)


def rect_clamp(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The part of a rectangle within the image, as (x, y, w, h); sizes are never negative."""
    left, top = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    right, bottom = F.least(x + w, width), F.least(y + h, height)
    return F.struct(left.alias("x"), top.alias("y"), F.greatest(right - left, F.lit(0)).alias("w"), F.greatest(bottom - top, F.lit(0)).alias("h"))


def mouth_points(points: Column) -> Column:
    """The last twenty of 68 points; none if there are fewer."""
    return F.when(F.size(points) >= LANDMARKS, F.slice(points, MOUTH[0] + 1, MOUTH[1] - MOUTH[0])).otherwise(F.slice(points, 1, 0))


def apply_affine(points: Column, m: Sequence[Column]) -> Column:
    """Points (x, y) through a matrix of six columns, row by row."""
    move = lambda p, a, b, c: (a * p["x"] + b * p["y"] + c)
    return F.transform(points, lambda p: F.struct(move(p, *m[:3]).alias("x"), move(p, *m[3:]).alias("y")))


def invert_affine(m: Sequence[Column]) -> list[Column]:
    a, b, c, d, e, f = m
    det = a * e - b * d
    return [e / det, -b / det, (b * f - e * c) / det, -d / det, a / det, (d * c - a * f) / det]


def centroid(points: Column) -> Column:
    n = F.size(points)
    total = F.aggregate(points, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")))
    return F.struct((total["x"] / n).alias("x"), (total["y"] / n).alias("y"))


def eye_matrix(a: Column, b: Column, size: int = 96, distance: float = 0.40, center: tuple[float, float] = (0.50, 0.40)) -> Column:
    """Rotation, scale and shift that put the eyes a, b (in either order) level at their target; null where they coincide."""
    swap = a["x"] < b["x"]
    lx, ly, rx, ry = F.when(swap, a["x"]).otherwise(b["x"]), F.when(swap, a["y"]).otherwise(b["y"]), F.when(swap, b["x"]).otherwise(a["x"]), F.when(swap, b["y"]).otherwise(a["y"])
    dx, dy, cx, cy = rx - lx, ry - ly, (lx + rx) / 2, (ly + ry) / 2
    length = F.sqrt(dx * dx + dy * dy)
    # scale * cos(angle) = size * distance * dx / length**2, and sin alike: no angle is needed
    cos, sin = size * distance * dx / (length * length), size * distance * dy / (length * length)
    values = (cos, sin, (1 - cos) * cx - sin * cy + size * center[0] - cx, -sin, cos, sin * cx + (1 - cos) * cy + size * center[1] - cy)
    return F.when(length >= 1e-6, F.struct(*[v.alias(f"m{k}") for k, v in enumerate(values)]))


def padded_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pads: tuple[int, int, int, int] = (0, 10, 0, 0)) -> Column:
    """The face with (top, bottom, left, right) padding within the image, as (x, y, w, h); null where nothing is left."""
    top, bottom, left, right = pads
    l, t = F.greatest(F.lit(0), x - left), F.greatest(F.lit(0), y - top)
    r, b = F.least(width, x + w + right), F.least(height, y + h + bottom)
    return F.when((w > 0) & (h > 0) & (r > l) & (b > t), F.struct(l.alias("x"), t.alias("y"), (r - l).alias("w"), (b - t).alias("h")))


def crop_matrix(crop: Column, size: int = 96) -> Column:
    """From the source to the resized crop, pixel centres on pixel centres."""
    sx, sy = F.lit(float(size)) / crop["w"], F.lit(float(size)) / crop["h"]
    values = (sx, F.lit(0.0), -crop["x"] * sx + (sx - 1) * 0.5, F.lit(0.0), sy, -crop["y"] * sy + (sy - 1) * 0.5)
    return F.when(crop.isNotNull(), F.struct(*[v.alias(f"m{k}") for k, v in enumerate(values)]))


def quality_score(w: Column, h: Column, points: Column, width: Column, height: Column, least: int = 64) -> Column:
    inside = F.forall(points, lambda p: (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] < width) & (p["y"] < height))
    return F.when(w >= least, 0.3).otherwise(0.0) + F.when(h >= least, 0.3).otherwise(0.0) + F.when(inside, 0.4).otherwise(0.0)


def kernel_size(n: Column) -> Column:
    """Odd and at least one."""
    return F.when(n < 1, 1).when(n % 2 == 0, n + 1).otherwise(n)
