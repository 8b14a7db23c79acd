"""The three whole pipelines: manifest, aligned geometry and crops, overlays."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import frames as frame_ops
from ..operators import inventory as inv
from ..operators import kernels
from ..operators import timeseries as ts
from ..schema import CORNERS
from ..sources import encoders, tables, videos

MANIFEST_PATH = Path("manifests") / "ingest.parquet"
CROP_HEIGHT = 100


@dataclass(frozen=True)
class Settings:
    """What geometry depends on beside its files; ``mark`` names it, so that stale results aren't reused."""

    threshold: int = kernels.THRESHOLD
    aspect: float = kernels.ASPECT
    height: int = CROP_HEIGHT
    window: int | None = None
    sigma: float | None = None

    def __post_init__(self):
        if self.window is not None and self.sigma is not None:
            raise ValueError("window and sigma are mutually exclusive")

    @property
    def mark(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]

    @property
    def crop_size(self) -> tuple[int, int]:
        return round(self.aspect * self.height), self.height


def build_manifest(spark: SparkSession, folders: videos.Folders) -> tuple[DataFrame, DataFrame]:
    """(manifest, warnings) of the recordings in ``folders``; empty ones give an empty table of the same schema.

    Each of the two opens every recording once.
    """
    named = inv.parse_names(videos.find_videos(spark, folders))
    good = named.where("session_id is not null")
    lists = videos.blank_files(spark, folders)
    counts = inv.count_per_key(videos.blank_indices(spark, lists), "stem", "frame_idx")
    full = inv.with_companions(good, lists, counts).join(videos.video_info(good), "path")
    manifest = inv.as_manifest(full.withColumns({"video_path": F.col("path"), "blank_frames_path": F.col("companion")})).orderBy("video_path")
    return manifest, inv.unexpected_names(named).union(inv.companion_warnings(full))


def _points(pose: DataFrame, on_empty: str) -> DataFrame:
    """Filled poses, and per recording how many rows there are and whether they are of frames 0, 1, 2, ... each once."""
    whole, line = W.partitionBy("video"), W.partitionBy("video").orderBy("frame_idx")
    at = F.col("frame_idx")
    filled = ts.fill_pose(pose, ["video"], "frame_idx", on_empty=on_empty, flag="_pose_filled")
    placed = filled.withColumn("_astray", at != F.row_number().over(line) - 1)
    return placed.select("video", "frame_idx", *frame_ops.POINTS, "_pose_filled", F.count("*").over(whole).alias("_n_pose"), F.bool_or("_astray").over(whole).alias("_astray"))


def _filled(found: DataFrame, points: DataFrame | None, settings: Settings, on_empty: str) -> DataFrame:
    """Rectangles found frame by frame as a smooth trajectory; ``points`` (from ``_points``) must fit the frames."""
    if points is not None:
        # one row per recording tells of all its poses, and one per frame whether its own was filled
        told = points.groupBy("video").agg(F.first("_n_pose").alias("_n_pose"), F.first("_astray").alias("_astray"))
        flags = points.where(~F.col("_astray")).select("video", "frame_idx", "_pose_filled")
        found = ts.at_positions(found, flags, ["video"], "frame_idx", "left").join(told, "video", "left")
    filled = ts.fill_gaps(found, ["video"], "frame_idx", list(CORNERS), on_empty=on_empty)
    if points is not None:
        # counted in the windows that are there anyway
        n_frames = F.count("*").over(W.partitionBy("video"))
        few = F.raise_error(F.format_string("%s has %d frames and %d pose rows", "video", n_frames, "_n_pose")).cast("boolean")
        astray = F.raise_error(F.format_string("%s has pose rows that repeat or skip frames", "video")).cast("boolean")
        flag = ts.either(F.col("is_interpolated"), F.col("_pose_filled"))
        checked = F.when(n_frames != F.col("_n_pose"), few).when(F.col("_astray"), astray).otherwise(flag)
        filled = filled.withColumn("is_interpolated", checked).drop("_pose_filled", "_n_pose", "_astray")
    return _smoothed(filled, settings)


def geometry(frames: DataFrame, pose: DataFrame | None = None, settings: Settings = Settings(), on_empty: str = "raise") -> DataFrame:
    """``video, frame_idx``, smoothed corners and ``is_interpolated`` of every frame.

    Rectangles are found frame by frame without a shuffle and pixels are dropped at once;
    filling and smoothing are one exchange by video. Videos without pose rows fall back to
    the body's own axis. Pose rows must be of the video's frames, each once: another number
    of rows, or rows that repeat or skip frames, fail the job.
    """
    points = None if pose is None else _points(pose, on_empty)
    if points is not None:
        frames = ts.at_positions(frames, points.where(~F.col("_astray")).select("video", "frame_idx", *frame_ops.POINTS), ["video"], "frame_idx", "left")
    found = frame_ops.inscribe_frames(frames, settings.threshold, settings.aspect).select("video", "frame_idx", *CORNERS)
    return _filled(found, points, settings, on_empty)


def geometry_of(ranges: DataFrame, pose: DataFrame | None = None, settings: Settings = Settings(), on_empty: str = "raise") -> DataFrame:
    """``geometry`` of recordings by ranges of frames: poses go to where frames are decoded, so no pixels are exchanged."""
    points = None if pose is None else _points(pose, on_empty)
    found = frame_ops.inscribe_ranges(ranges, points, settings.threshold, settings.aspect).select("video", "frame_idx", *CORNERS)
    return _filled(found, points, settings, on_empty)


def _smoothed(filled: DataFrame, settings: Settings) -> DataFrame:
    smoothed = ts.smooth(filled, ["video"], "frame_idx", list(CORNERS), settings.window, settings.sigma)
    return smoothed.select("video", "frame_idx", *CORNERS, "is_interpolated")


def trajectory(found: DataFrame, settings: Settings = Settings(), on_empty: str = "raise") -> DataFrame:
    """Rectangles found frame by frame as a trajectory: gaps filled, corners smoothed."""
    return _smoothed(ts.fill_gaps(found, ["video"], "frame_idx", list(CORNERS), on_empty=on_empty), settings)


def crops(frames: DataFrame, found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return frame_ops.crop_frames(frames, found, settings.crop_size)


def overlay(frames: DataFrame, found: DataFrame) -> DataFrame:
    return frame_ops.draw_frames(frames, found)


def write_crops(ranges: DataFrame, found: DataFrame, settings: Settings, folder: str | Path, encoder: encoders.Encoder) -> DataFrame:
    """One aligned video per recording: decoded, cropped and encoded in one task each."""
    return encoders.write_made(ranges, found, CORNERS, frame_ops.cropping(settings.crop_size), folder, encoder=encoder)


def write_overlays(ranges: DataFrame, found: DataFrame, folder: str | Path, encoder: encoders.Encoder) -> DataFrame:
    """One video per recording with its rectangles drawn."""
    return encoders.write_made(ranges, found, [*CORNERS, "is_interpolated"], frame_ops.drawing(), folder, "_overlay", encoder=encoder)


def read_pose_for(spark: SparkSession, names: list[str], folder: str | Path | None) -> tuple[DataFrame | None, list[str]]:
    """Pose rows of the named videos that have a file in ``folder`` (of any file system that Spark knows), and the names that have none."""
    try:
        listed = videos.listing(spark, folder, "*.csv") if folder else []
    except FileNotFoundError:
        listed = []
    there = {Path(p).stem: p for p in listed}
    found = [there[n] for n in names if n in there]
    return (tables.read_pose(spark, *found) if found else None), [n for n in names if n not in there]
