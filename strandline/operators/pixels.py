"""Image geometry on pixel tables ``f, y, x`` and a value: exact and checkable in SQL.

Meant for moderate frames and for checking the kernels; the kernels do the bulk work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import axis_angle, canvas_side, from_upright, half_even, is_background
from ..plans.storage import settle
from . import graph, kernels


def background_mask(pixels: DataFrame, threshold: int = 0) -> DataFrame:
    """``m``: 255 where the gray value ``g`` may be background, else 0."""
    return pixels.withColumn("m", F.when(is_background(F.col("g"), threshold), 255).otherwise(0))


def cut_at(pixels: DataFrame, at: str) -> DataFrame:
    """Clear columns at or past the rounded ``at``; a negative one clears all."""
    return pixels.withColumn("m", F.when(F.col("x") >= half_even(F.col(at)), 0).otherwise(F.col("m")))


def integral(pixels: DataFrame) -> DataFrame:
    """``s``: sum of ``m`` over the rectangle from the origin to the pixel, both included."""
    row = W.partitionBy("f", "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    column = W.partitionBy("f", "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    return pixels.withColumn("_r", F.sum("m").over(row)).withColumn("s", F.sum("_r").over(column)).drop("_r")


def boxes_inside(sums: DataFrame, boxes: DataFrame) -> DataFrame:
    """``boxes`` (``f, box, x0, y0, w, h``) with ``inside``: every pixel is foreground, from four sums.

    A box without area is inside.
    """
    corners = boxes.select(
        "f", "box", F.explode(F.array(*[
            F.struct((F.col("x0") + dx * F.col("w") - 1).alias("x"), (F.col("y0") + dy * F.col("h") - 1).alias("y"), F.lit(sign).alias("sign"))
            for dx, dy, sign in ((1, 1, 1), (0, 1, -1), (1, 0, -1), (0, 0, 1))
        ])).alias("c")
    ).select("f", "box", "c.x", "c.y", "c.sign")
    totals = corners.join(sums.select("f", "x", "y", "s"), ["f", "x", "y"]).groupBy("f", "box").agg(F.sum(F.col("sign") * F.col("s")).alias("total"))
    return boxes.join(totals, ["f", "box"], "left").withColumn("inside", F.coalesce("total", F.lit(0)) >= 255 * F.col("w") * F.col("h")).drop("total")


#: Side of the squares that frames are cut into.
TILE = 64


def components(pixels: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """8-connected components of the pixels with ``m > 0``: ``f, y, x, label``.

    A label is the smallest ``y * width + x`` of its component. Frames are cut into squares of
    ``tile`` pixels a side, which are labelled each on its own; pixels that touch across a
    seam make two labels equal, and those equalities are solved as a graph of labels, which
    is far smaller than the frame. Frames without seams need no round of that.
    """
    at = [(F.col(c) / tile).cast("int").alias(f"_{c}") for c in ("y", "x")]
    here = pixels.where("m > 0").select("f", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    kind = here.schema["f"].dataType.simpleString()

    def label(own: pa.Table) -> pa.Table:
        ys, xs = own["y"].to_numpy(), own["x"].to_numpy()
        y0, x0 = int(ys.min()), int(xs.min())
        on = np.zeros((int(ys.max()) - y0 + 1, int(xs.max()) - x0 + 1), bool)
        on[ys - y0, xs - x0] = True
        found = kernels.label_runs(on)[0][ys - y0, xs - x0]
        first = np.full(found.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, found, ys * width + xs)
        return pa.table({"f": own["f"], "y": own["y"], "x": own["x"], "label": first[found]})

    tiles = settle(here.withColumns({"_y": at[0], "_x": at[1]}).groupBy("f", "_y", "_x").applyInArrow(label, f"f {kind}, y long, x long, label long"))
    steps = F.when(F.col("x") % tile == 0, F.array(*[_step(dy, -1) for dy in (-1, 0, 1)])).otherwise(F.array().cast("array<struct<dy:int,dx:int>>"))
    steps = F.concat(steps, F.when(F.col("y") % tile == 0, F.array(*[_step(-1, dx) for dx in (-1, 0, 1)])).otherwise(F.array().cast("array<struct<dy:int,dx:int>>")))
    said = tiles.where((F.col("x") % tile == 0) | (F.col("y") % tile == 0)).select("f", "label", "y", "x", F.explode(steps).alias("d"))
    seams = tiles.where((F.col("x") % tile).isin(0, tile - 1) | (F.col("y") % tile).isin(0, tile - 1)).select("f", "y", "x", F.col("label").alias("v"))
    edges = said.select("f", F.col("label").alias("u"), (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x")).join(seams, ["f", "y", "x"])
    roots = graph.components(edges.select("f", "u", "v").distinct()).withColumnRenamed("node", "label")
    return tiles.join(roots, ["f", "label"], "left").select("f", "y", "x", F.coalesce("root", "label").alias("label"))


def _step(dy: int, dx: int):
    return F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))


def areas(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("f", "label").agg(F.count("*").alias("area"))


def largest(labelled: DataFrame) -> DataFrame:
    """``f, label, area`` of each frame's largest component; of equal ones the first in row order."""
    w = W.partitionBy("f").orderBy(F.col("area").desc(), F.col("label"))
    return areas(labelled).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def orientation(pixels: DataFrame, key: str = "f") -> DataFrame:
    """Centroid and major axis of the pixels with ``m > 0`` per frame; null angle for one pixel."""
    return (
        pixels.where("m > 0").groupBy(key)
        .agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_samp("x").alias("_vx"), F.var_samp("y").alias("_vy"), F.covar_samp("x", "y").alias("_c"))
        .select(key, "cx", "cy", axis_angle(F.col("_vx"), F.col("_vy"), F.col("_c")).alias("angle"))
    )


def recover_mask(pixels: DataFrame, width: int, threshold: int = 0) -> DataFrame:
    """``m``: 255 on the body. The largest dark component is background, the largest of the rest the body."""
    dark = components(background_mask(pixels, threshold), width)
    ground = dark.join(largest(dark).select("f", "label"), ["f", "label"], "left_semi").select("f", "y", "x", F.lit(0).alias("_ground"))
    rest = pixels.join(ground, ["f", "y", "x"], "left").withColumn("m", F.when(F.col("_ground").isNull(), 255).otherwise(0)).drop("_ground")
    found = components(rest, width)
    body = found.join(largest(found).select("f", "label"), ["f", "label"], "left_semi").select("f", "y", "x", F.lit(255).alias("_body"))
    return rest.drop("m").join(body, ["f", "y", "x"], "left").withColumn("m", F.coalesce("_body", F.lit(0))).drop("_body")


def rotate_upright(pixels: DataFrame, axes: DataFrame, height: int, width: int) -> DataFrame:
    """``f, v, u, m``: masks turned upright by ``axes`` (``f, cx, cy, angle``) on a canvas that holds the frame.

    Each canvas pixel takes the nearest frame pixel, zero outside.
    """
    side = canvas_side(F.lit(float(height)), F.lit(float(width))).cast("long")
    line = F.sequence(F.lit(0).cast("long"), side - 1)
    canvas = axes.withColumn("v", F.explode(line)).withColumn("u", F.explode(line))
    x, y = from_upright(F.col("u"), F.col("v"), F.col("cx"), F.col("cy"), F.col("angle"), side)
    source = canvas.select("f", "v", "u", half_even(x).alias("x"), half_even(y).alias("y"))
    return source.join(pixels.select("f", "x", "y", "m"), ["f", "x", "y"], "left").select("f", "v", "u", F.coalesce("m", F.lit(0)).alias("m"))
