"""Kernels over frame tables, in Arrow batches, and over recordings by ranges of frames.

The forms by ranges (``crop_ranges``, ``draw_ranges``, ``inscribe_ranges``) are those for
recordings in files: what is known about frames joins to ranges, and pixels are decoded in
the task that uses them. The forms over frame tables join rows to frames that are there
already, pixels and all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import present
from ..schema import CORNERS, FRAMES, RECT
from ..sources.frames import FrameSource
from ..sources.ranges import Make, dealt, made, make_frames, with_rows
from . import kernels
from .timeseries import at_positions

POINTS = ("tail_x", "tail_y", "neck_x", "neck_y")
INTERPOLATED_COLOR = (0, 165, 255)
DETECTED_COLOR = (0, 255, 0)

RECT_NAMES = [f.name for f in RECT]


def to_array(height: int, width: int, channels: int, pixels: bytes) -> np.ndarray:
    shape = (height, width) if channels == 1 else (height, width, channels)
    return np.frombuffer(pixels, np.uint8).reshape(shape)


def mask_frames(frames: DataFrame, threshold: int = kernels.THRESHOLD) -> DataFrame:
    """The body mask of every frame, as a frame table of one channel."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [kernels.body_mask(to_array(h, w, c, p), threshold).tobytes() for h, w, c, p in zip(b.height, b.width, b.channels, b.pixels)]
            yield pd.DataFrame({"video": b.video, "frame_idx": b.frame_idx, "height": b.height, "width": b.width, "channels": 1, "pixels": out})

    return frames.mapInPandas(run, FRAMES)


def seed_frames(frames: DataFrame, threshold: int = kernels.THRESHOLD) -> DataFrame:
    """``video, frame_idx, x, y``: where the body is widest, null without a body."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            masks = [kernels.body_mask(to_array(h, w, c, p), threshold) for h, w, c, p in zip(b.height, b.width, b.channels, b.pixels)]
            seeds = [kernels.seed_point(m) if m.any() else (None, None) for m in masks]
            yield pd.DataFrame({"video": b.video, "frame_idx": b.frame_idx, "x": pd.array([s[0] for s in seeds], "Int64"), "y": pd.array([s[1] for s in seeds], "Int64")})

    return frames.mapInPandas(run, "video string, frame_idx long, x long, y long")


def unpack(frames: DataFrame) -> DataFrame:
    """``video, frame_idx, y, x, channel, value``: a row per byte, for checks in SQL."""
    data = F.transform(F.sequence(F.lit(0), F.length("pixels") - 1), lambda i: F.conv(F.hex(F.substring(F.col("pixels"), i + 1, 1)), 16, 10).cast("long"))
    rows = frames.select("video", "frame_idx", "width", "channels", F.posexplode(data).alias("at", "value"))
    pixel = F.floor(F.col("at") / F.col("channels"))
    return rows.select("video", "frame_idx", F.floor(pixel / F.col("width")).cast("long").alias("y"), (pixel % F.col("width")).cast("long").alias("x"), (F.col("at") % F.col("channels")).cast("long").alias("channel"), "value")


def _rectangle(frame: np.ndarray, pose: list, threshold: int, aspect: float) -> list[float | None]:
    """The rectangle of a frame as a row of RECT, nulls without a body; along ``pose`` if it is complete."""
    tail, neck = (pose[:2], pose[2:]) if len(pose) == 4 and not any(p is None or p != p for p in pose) else (None, None)
    got = kernels.inscribe(frame, threshold, aspect, tail, neck)
    return [None] * len(RECT_NAMES) if got is None else [*got.corners.ravel().tolist(), *got.center, got.angle, got.width, got.height]


_RECTANGLES = T.StructType([T.StructField("video", T.StringType()), T.StructField("frame_idx", T.LongType()), *RECT])


def inscribe_frames(frames: DataFrame, threshold: int = kernels.THRESHOLD, aspect: float = kernels.ASPECT) -> DataFrame:
    """``video, frame_idx`` and the rectangle of every frame, nulls where there is no body.

    Frames may carry ``tail_x, tail_y, neck_x, neck_y``; rows that have all four use them.
    """
    points = [c for c in POINTS if c in frames.columns]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.video, r.frame_idx, *_rectangle(to_array(r.height, r.width, r.channels, r.pixels), [getattr(r, c) for c in points], threshold, aspect)) for r in b.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=_RECTANGLES.names).astype({n: "float64" for n in RECT_NAMES})

    out = frames.select("video", "frame_idx", "height", "width", "channels", "pixels", *points).mapInPandas(run, _RECTANGLES)
    return out.withColumns({n: present(F.col(n)) for n in RECT_NAMES})


def inscribe_ranges(ranges: DataFrame, pose: DataFrame | None = None, threshold: int = kernels.THRESHOLD, aspect: float = kernels.ASPECT) -> DataFrame:
    """``inscribe_frames`` of recordings by ranges; ``pose`` has ``video, frame_idx`` and the four coordinates."""
    decoders = dict(FrameSource.decoders)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for video, path, first, last, own in zip(*(c.to_pylist() for c in b.columns)):
                at = {r["frame_idx"]: [r[c] for c in POINTS] for r in own or ()}
                rows = [(video, k, *_rectangle(frame, at.get(k, []), threshold, aspect)) for k, frame in made(path, first, last, None, decoders, lambda k, frame, row: frame)]
                yield pa.RecordBatch.from_pylist([dict(zip(_RECTANGLES.names, r)) for r in rows], pa.schema([("video", pa.string()), ("frame_idx", pa.int64()), *((n, pa.float64()) for n in RECT_NAMES)]))

    if pose is None:
        told = ranges.withColumn("rows", F.lit(None).cast("array<struct<frame_idx:bigint>>"))
    else:
        told = with_rows(ranges, pose, POINTS)
    return dealt(ranges, told.select("video", "path", "first", "last", "rows")).mapInArrow(run, _RECTANGLES)


def cropping(size: tuple[int, int]) -> Make:
    """Crops by rows with corners; frames without one have none."""

    def crop(k: int, frame: np.ndarray, row: dict | None) -> np.ndarray | None:
        return None if row is None else kernels.crop(frame, np.array([row[c] for c in CORNERS], float).reshape(4, 2), size)

    return crop


def drawing() -> Make:
    """Frames with the rectangle of their row drawn; frames without a row are left out."""

    def draw(k: int, frame: np.ndarray, row: dict | None) -> np.ndarray | None:
        color = None if row is None else INTERPOLATED_COLOR if row["is_interpolated"] else DETECTED_COLOR
        return None if row is None else kernels.draw_polygon(frame, np.array([row[c] for c in CORNERS], float).reshape(4, 2), color)

    return draw


def crop_ranges(ranges: DataFrame, geometry: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Canonical crops of recordings by ranges, as a frame table."""
    return make_frames(ranges, geometry, CORNERS, cropping(size))


def draw_ranges(ranges: DataFrame, geometry: DataFrame) -> DataFrame:
    """Frames of recordings by ranges with their rectangle drawn, orange where it was interpolated, else green."""
    return make_frames(ranges, geometry, [*CORNERS, "is_interpolated"], drawing())


def crop_frames(frames: DataFrame, geometry: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Canonical crops as a frame table: frames joined to their corners, one warp per row."""
    joined = at_positions(frames, geometry.select("video", "frame_idx", *CORNERS), ["video"], "frame_idx")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [kernels.crop(to_array(h, w, c, p), np.array(q, float).reshape(4, 2), size).tobytes() for h, w, c, p, q in zip(b.height, b.width, b.channels, b.pixels, b[list(CORNERS)].itertuples(index=False))]
            yield pd.DataFrame({"video": b.video, "frame_idx": b.frame_idx, "height": size[1], "width": size[0], "channels": b.channels, "pixels": out})

    return joined.mapInPandas(run, FRAMES)


def draw_frames(frames: DataFrame, geometry: DataFrame) -> DataFrame:
    """Frames with their rectangle drawn, orange where it was interpolated, else green."""
    color = F.when(F.col("is_interpolated"), F.array(*map(F.lit, INTERPOLATED_COLOR))).otherwise(F.array(*map(F.lit, DETECTED_COLOR)))
    joined = at_positions(frames, geometry.select("video", "frame_idx", *CORNERS, color.alias("color")), ["video"], "frame_idx")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [
                kernels.draw_polygon(to_array(h, w, c, p), np.array(q, float).reshape(4, 2), tuple(int(v) for v in k)).tobytes()
                for h, w, c, p, k, q in zip(b.height, b.width, b.channels, b.pixels, b.color, b[list(CORNERS)].itertuples(index=False))
            ]
            yield pd.DataFrame({"video": b.video, "frame_idx": b.frame_idx, "height": b.height, "width": b.width, "channels": b.channels, "pixels": out})

    return joined.mapInPandas(run, FRAMES)
