"""Scalar column functions: missing values, rounding, names, angles, affine maps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# How recordings are named; a fixed value of the data format.
NAME = r"^session-(\d+)_cuttle-(\d+)$"


def present(c: Column) -> Column:
    """NaN becomes null. Spark orders NaN above every number, so predicates would take it for valid."""
    return F.when(~F.isnan(c), c)


def all_present(cols: Sequence[Column]) -> Column:
    """True where no value is null or NaN."""
    return reduce(lambda a, b: a & b, [present(c).isNotNull() for c in cols])


def trusted(likelihoods: Sequence[Column], threshold: float = 0.9) -> Column:
    """True where every likelihood reaches the threshold; missing ones do not."""
    return F.coalesce(reduce(lambda a, b: a & b, [present(c) >= threshold for c in likelihoods]), F.lit(False))


def stem(path: Column) -> Column:
    """File name without directory and last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")


def name_part(stem_: Column, group: int) -> Column:
    """Session (1) or individual (2) number of a recording's stem, null if it is named otherwise."""
    return F.when(stem_.rlike(NAME), F.regexp_extract(stem_, NAME, group).cast("long"))


def sibling(stem_: Column, suffix: str) -> Column:
    return F.concat(stem_, F.lit(suffix))


def half_even(c: Column) -> Column:
    """Round half to even, as long."""
    return F.bround(c, 0).cast("long")


def toward_zero(c: Column) -> Column:
    return c.cast("long")


def is_background(gray: Column, threshold: int = 0) -> Column:
    return gray <= threshold


def gray(b: Column, g: Column, r: Column) -> Column:
    """Luma of 8-bit blue, green, red, in fixed point of 14 bits."""
    return F.shiftright(b * 1868 + g * 9617 + r * 4899 + 8192, 14)


def signed_orientation(tail_x: Column, tail_y: Column, neck_x: Column, neck_y: Column) -> tuple[Column, Column, Column]:
    """Midpoint and the angle in degrees from tail to neck."""
    return (tail_x + neck_x) / 2, (tail_y + neck_y) / 2, F.degrees(F.atan2(neck_y - tail_y, neck_x - tail_x))


def axis_angle(var_x: Column, var_y: Column, cov: Column) -> Column:
    """Major axis in (-90, 90] degrees from second moments; 0 for a round blob."""
    return F.degrees(F.atan2(2 * cov, var_x - var_y)) / 2


def canvas_side(height: Column, width: Column) -> Column:
    """Side of a square that holds the frame at any angle."""
    return F.ceil(F.hypot(height, width))


def upright(x: Column, y: Column, cx: Column, cy: Column, angle: Column, side: Column) -> tuple[Column, Column]:
    """Where a frame point lands when ``angle`` is turned to horizontal about the canvas centre."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return c * (x - cx) + s * (y - cy) + side / 2, c * (y - cy) - s * (x - cx) + side / 2


def from_upright(u: Column, v: Column, cx: Column, cy: Column, angle: Column, side: Column) -> tuple[Column, Column]:
    """Inverse of ``upright``."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    du, dv = u - side / 2, v - side / 2
    return c * du - s * dv + cx, s * du + c * dv + cy


def crop_source(u: Column, v: Column, width: int, height: int, tl: tuple[Column, Column], tr: tuple[Column, Column], bl: tuple[Column, Column]) -> tuple[Column, Column]:
    """Frame point that a crop pixel is taken from: affine in three corners."""
    return tuple(a + u / width * (b - a) + v / height * (c - a) for a, b, c in zip(tl, tr, bl))


def crop_width(aspect: Column, height: Column) -> Column:
    return half_even(aspect * height)
