"""Masks as runs: one row per frame with an array of ``(y, x0, x1)``, x1 not included.

What is asked of a mask, its area, moments, sums over boxes, is a closed sum over its runs,
so a frame stays one row: no row per pixel, no exchange, and no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import axis_angle

RUNS = "array<struct<y:bigint,x0:bigint,x1:bigint>>"


def of_frames(frames: DataFrame, threshold: int = 0) -> DataFrame:
    """``video, frame_idx, width, height, runs`` of gray frames: where the gray value is above ``threshold``.

    Bytes become a string of 0 and 1, cut into rows and each row where it changes. Frames of
    several channels fail the job; a frame without such pixels has no runs.
    """
    every = "".join(map(chr, range(256)))
    marks = "0" * (threshold + 1) + "1" * (255 - threshold)
    one_channel = F.when(F.col("channels") == 1, F.col("pixels")).otherwise(F.raise_error(F.lit("runs are made of gray frames")).cast("binary"))
    # a byte and the character of its number are the same in this encoding
    bits = F.translate(F.decode(one_channel, "ISO-8859-1"), every, marks)
    width = F.col("width").cast("int")
    rows = F.transform(F.sequence(F.lit(0), F.col("height").cast("int") - 1), lambda y: F.struct(y.cast("long").alias("y"), F.substring(F.col("_bits"), y * width + 1, width).alias("bits")))

    def line(row: Column) -> Column:
        nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(RUNS).alias("runs"))
        pieces = F.split(row["bits"], "(?<=0)(?=1)|(?<=1)(?=0)")

        def grow(held: Column, piece: Column) -> Column:
            end = held["at"] + F.length(piece)
            run = F.struct(row["y"].alias("y"), held["at"].alias("x0"), end.alias("x1"))
            return F.struct(end.alias("at"), F.when(piece.startswith("1"), F.concat(held["runs"], F.array(run))).otherwise(held["runs"]).alias("runs"))

        return F.aggregate(pieces, nothing, grow)["runs"]

    return frames.withColumn("_bits", bits).select("video", "frame_idx", "width", "height", F.flatten(F.transform(rows, line)).alias("runs"))


def _total(of: Callable[[Column], Column], runs: str | Column = "runs") -> Column:
    """The sum of a whole number over runs."""
    return F.aggregate(F.col(runs) if isinstance(runs, str) else runs, F.lit(0).cast("long"), lambda s, r: s + of(r).cast("long"))


def _n(r: Column) -> Column:
    return r["x1"] - r["x0"]


def _sum_x(r: Column) -> Column:
    """Sum of x over a run."""
    return F.shiftright((r["x0"] + r["x1"] - 1) * _n(r), 1)


def _squares_below(x: Column) -> Column:
    """Sum of the squares of 0, 1, ... x - 1; a whole number."""
    return F.call_function("div", (x - 1) * x * (2 * x - 1), F.lit(6).cast("long"))


def area() -> Column:
    """Pixels of ``runs``."""
    return _total(_n)


def moments(masks: DataFrame) -> DataFrame:
    """``masks`` with centroid ``cx, cy`` and major axis ``angle`` of their pixels; null without a pixel, no angle for one."""
    squares = lambda r: _squares_below(r["x1"]) - _squares_below(r["x0"])
    sums = {
        "_n": area(), "_sx": _total(_sum_x), "_sy": _total(lambda r: r["y"] * _n(r)), "_sxx": _total(squares),
        "_syy": _total(lambda r: r["y"] * r["y"] * _n(r)), "_sxy": _total(lambda r: r["y"] * _sum_x(r)),
    }
    told = masks.withColumns(sums)
    n = F.when(F.col("_n") > 0, F.col("_n"))
    # n times a sum of squares less a square: whole numbers, so nothing cancels before the division
    spread = lambda ab, a, b: (n * F.col(ab) - F.col(a) * F.col(b)) / (n * F.when(n > 1, n - 1))
    angle = axis_angle(spread("_sxx", "_sx", "_sx"), spread("_syy", "_sy", "_sy"), spread("_sxy", "_sx", "_sy"))
    return told.withColumns({"cx": F.col("_sx") / n, "cy": F.col("_sy") / n, "angle": angle}).drop(*sums)


def covered(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Pixels of ``runs`` in the box from (x0, y0) up to before (x1, y1)."""
    return _total(lambda r: F.when((r["y"] >= y0) & (r["y"] < y1), F.greatest(F.least(r["x1"], x1) - F.greatest(r["x0"], x0), F.lit(0))).otherwise(0))


def integral_at(x: Column, y: Column) -> Column:
    """Pixels of ``runs`` from the origin to (x, y), both included."""
    return covered(F.lit(0), F.lit(0), x + 1, y + 1)


def is_inside(x0: Column, y0: Column, w: Column, h: Column) -> Column:
    """Whether a box lies wholly on ``runs``; one without area does."""
    return covered(x0, y0, x0 + w, y0 + h) >= w * h
