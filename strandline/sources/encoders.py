"""Video sinks: the frames of each video, in order, through an encoder on an executor."""

from __future__ import annotations

import importlib.util
import os
import shutil
import subprocess
import uuid
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import videos
from .files import make_folder
from .frames import FrameSource
from .ranges import Make, dealt, made, with_rows
from .sinks import stack_head

CRF = 28
#: Frames a second where nothing says how many.
FPS = 24.0

#: (path, width, height, channels, frames per second, frames as bytes) to the path that was written.
Encoder = Callable[[str, int, int, int, float, Iterator[bytes]], str]


def encode_npy(path: str, width: int, height: int, channels: int, fps: float, frames: Iterator[bytes]) -> str:
    """A stack of frames in an .npy file, written as frames come; the head is completed at the end."""
    path = str(Path(path).with_suffix(".npy"))
    shape = (height, width) if channels == 1 else (height, width, channels)
    with open(path, "wb") as f:
        head, n = stack_head((10**9, *shape)), 0
        f.write(head)
        for frame in frames:
            f.write(frame)
            n += 1
        f.seek(0)
        f.write(stack_head((n, *shape), len(head)))
    return path


def ffmpeg_encoder(crf: int = CRF) -> Encoder:
    """H.264 through the ffmpeg program; fails where there is none."""

    def encode(path: str, width: int, height: int, channels: int, fps: float, frames: Iterator[bytes]) -> str:
        program = shutil.which("ffmpeg")
        if program is None:
            raise OSError(f"cannot encode {Path(path).name}: this machine has no ffmpeg")
        kind = "gray" if channels == 1 else "bgr24"
        args = ["-y", "-v", "error", "-f", "rawvideo", "-pix_fmt", kind, "-s", f"{width}x{height}", "-r", str(fps), "-i", "pipe:0"]
        args += ["-c:v", "libx264", "-preset", "medium", "-crf", str(crf), "-pix_fmt", "yuv420p", path]
        with subprocess.Popen([program, *args], stdin=subprocess.PIPE) as run:
            for frame in frames:
                run.stdin.write(frame)
            run.stdin.close()
            if run.wait():
                raise RuntimeError(f"ffmpeg ended with code {run.returncode} writing {path}")
        return path

    return encode


def encode_opencv(path: str, width: int, height: int, channels: int, fps: float, frames: Iterator[bytes]) -> str:
    """MPEG-4 part 2 (mp4v) through OpenCV; fails where it is not installed."""
    try:
        import cv2
    except ImportError as e:
        raise OSError(f"cannot encode {Path(path).name}: OpenCV is not installed") from e
    out = cv2.VideoWriter(path, cv2.VideoWriter_fourcc(*"mp4v"), fps, (width, height), channels != 1)
    try:
        for frame in frames:
            out.write(np.frombuffer(frame, np.uint8).reshape((height, width) if channels == 1 else (height, width, channels)))
    finally:
        out.release()
    return path


def best_encoder(crf: int | None = None) -> Encoder:
    """What this machine has: ffmpeg if a quality is asked for, else OpenCV's mp4v, else a stack of frames."""
    if crf is not None and shutil.which("ffmpeg"):
        return ffmpeg_encoder(crf)
    return encode_opencv if importlib.util.find_spec("cv2") else encode_npy


def _encode(encoder: Encoder, folder: str, name: str, fps: float, frames: Iterator[tuple[tuple[int, int, int], bytes]]) -> tuple[str, int]:
    """Encode frames, (height, width, channels) and bytes each, as ``name`` in a folder: path and number of frames.

    The draft has a name of its own and becomes the final file when it is complete; nothing
    of it stays if the encoder fails.
    """
    (height, width, channels), pixels = next(frames)
    n = 0

    def counted() -> Iterator[bytes]:
        nonlocal n
        data = pixels
        while data is not None:
            n += 1
            yield data
            _, data = next(frames, (None, None))

    draft = Path(folder) / f".{uuid.uuid4().hex}.mp4"
    try:
        written = Path(encoder(str(draft), width, height, channels, fps, counted()))
        path = Path(folder) / f"{name}{written.suffix}"
        os.replace(written, path)
    finally:
        for left in Path(folder).glob(f"{draft.stem}*"):
            left.unlink()
    return str(path), n


WRITTEN = "video string, path string, n_frames long"


def write_videos(frames: DataFrame, folder: str | Path, suffix: str = "", fps: float = FPS, encoder: Encoder = encode_npy) -> DataFrame:
    """Write ``{video}{suffix}`` per video and return ``video, path, n_frames``.

    Frames are dealt by video and sorted; a task streams them and never holds a video.
    This moves pixels, as a codec needs the frames of a video in one place; what is made of
    recordings in files is better written by ``write_made``. ``folder`` is a path that
    executors share.
    """
    target = make_folder(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.itertuples(index=False))
        held = next(rows, None)
        while held is not None:
            first = held

            def own() -> Iterator[tuple[tuple[int, int, int], bytes]]:
                nonlocal held
                while held is not None and held.video == first.video:
                    yield (int(held.height), int(held.width), int(held.channels)), bytes(held.pixels)
                    held = next(rows, None)

            path, n = _encode(encoder, target, f"{first.video}{suffix}", fps, own())
            yield pd.DataFrame({"video": [first.video], "path": [path], "n_frames": [n]})

    ordered = frames.where(F.col("pixels").isNotNull()).repartition("video").sortWithinPartitions("video", "frame_idx")
    return ordered.mapInPandas(run, WRITTEN)


def write_made(ranges: DataFrame, rows: DataFrame, columns: Sequence[str], make: Make, folder: str | Path, suffix: str = "", fps: float | None = None, encoder: Encoder = encode_npy) -> DataFrame:
    """Write what ``make`` makes of every recording's frames and rows, ``{video}{suffix}`` each: ``video, path, n_frames``.

    A recording's ranges and rows come together in one task, which decodes, makes and
    encodes frame by frame; no pixels are exchanged. Recordings without a row are left out.
    Without ``fps`` a file keeps its recording's rate, or has FPS where no probe knows that.
    """
    target, decoders, probes = make_folder(folder), dict(FrameSource.decoders), videos.probes()

    def rate(path: str) -> float:
        probe = probes.get(Path(path).suffix)
        return fps or (probe(path)[1] if probe else 0) or FPS

    told = with_rows(ranges, rows, columns, "inner")
    whole = told.groupBy("video").agg(F.sort_array(F.collect_list(F.struct("first", "last", "path", "rows"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for video, parts in zip(*b.columns):
                name = video.as_py()
                frames = (f for p in parts for _, f in made(p["path"].as_py(), p["first"].as_py(), p["last"].as_py(), p["rows"].as_py(), decoders, make))
                path, n = _encode(encoder, target, f"{name}{suffix}", rate(parts[0]["path"].as_py()), (((*f.shape, 1)[:3], f.tobytes()) for f in frames))
                yield pa.RecordBatch.from_pylist([{"video": name, "path": path, "n_frames": n}])

    return dealt(ranges, whole).mapInArrow(run, WRITTEN)
