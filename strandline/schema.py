"""Explicit schemas of every table, always nullable where a value can be missing."""

from __future__ import annotations

from pyspark.sql import types as T

CORNERS = tuple(f"corner_{c}_{a}" for c in ("tl", "tr", "br", "bl") for a in ("x", "y"))
KEYPOINTS = tuple(f"{p}_{a}" for p in ("tail", "neck") for a in ("x", "y", "likelihood"))

MANIFEST = T.StructType([
    T.StructField("session_id", T.LongType()),
    T.StructField("fish_id", T.LongType()),
    T.StructField("video_path", T.StringType()),
    T.StructField("blank_frames_path", T.StringType()),
    T.StructField("n_frames", T.LongType()),
    T.StructField("n_blank_frames", T.LongType()),
    T.StructField("fps", T.DoubleType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
])

FRAMES = T.StructType([
    T.StructField("video", T.StringType()),
    T.StructField("frame_idx", T.LongType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("channels", T.IntegerType()),
    T.StructField("pixels", T.BinaryType()),
])

POSE = T.StructType([
    T.StructField("video", T.StringType()),
    T.StructField("frame_idx", T.LongType()),
    *[T.StructField(k, T.DoubleType()) for k in KEYPOINTS],
])

GEOMETRY = T.StructType([
    T.StructField("frame_idx", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in CORNERS],
    T.StructField("is_interpolated", T.BooleanType()),
])

RECT = T.StructType([
    *[T.StructField(c, T.DoubleType()) for c in CORNERS],
    *[T.StructField(n, T.DoubleType()) for n in ("center_x", "center_y", "angle", "rect_width", "rect_height")],
])
