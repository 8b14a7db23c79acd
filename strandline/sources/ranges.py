"""Recordings as ranges of frames: one small row each, decoded where its frames are used.

What is known about frames (poses, corners) joins to ranges as a list per range, so a join
moves numbers only; pixels come into being inside the function that needs them and never
cross an exchange. Ranges begin where a decoder can, at keyframes for instance, and have
about RANGE_FRAMES frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import settle
from ..schema import FRAMES
from . import videos
from .frames import BATCH_BYTES, PARTITION_BYTES, Decoder, FrameSource, Range, cuts, decode_opencv

RANGE_FRAMES = 256
RANGES = "video string, path string, part long, first long, last long, bytes long"

#: (frame number, frame, its row or None) to the frame that comes of it, or None.
Make = Callable[[int, np.ndarray, dict | None], np.ndarray | None]


def _count(path: str, decoder: Decoder, probes: dict) -> tuple[int, int]:
    """Frames, and bytes of one, of a recording whose decoder can't tell."""
    probe = probes.get(Path(path).suffix)
    if probe:
        n, _, width, height = probe(path)
        return n, 3 * width * height
    sizes = [f.nbytes for f in decoder(path)]
    return len(sizes), max(sizes, default=0)


def frame_ranges(spark: SparkSession, paths: Iterable[str | Path], frames: int = RANGE_FRAMES) -> DataFrame:
    """``video, path, part, first, last, bytes`` of the recordings (settled): ``first`` up to before ``last``.

    Files are opened on the executors, to read how long they are. A recording whose
    decoder can only start at its beginning is one range; an empty one has none.
    """
    decoders, probes = dict(FrameSource.decoders), videos.probes()
    listed = spark.createDataFrame([(str(p),) for p in paths], "path string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                decoder = decoders.get(Path(path).suffix, decode_opencv)
                if isinstance(decoder, Range):
                    n, size = decoder.shape(path)
                    at = cuts(decoder, path, n, frames)
                else:
                    n, size = _count(path, decoder, probes)
                    at = [0, n]
                rows += [{"video": Path(path).stem, "path": path, "part": k, "first": s, "last": e, "bytes": size * (e - s)} for k, (s, e) in enumerate(zip(at, at[1:])) if e > s]
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return settle(listed.mapInArrow(run, RANGES))


def with_rows(ranges: DataFrame, rows: DataFrame, columns: Sequence[str], how: str = "left", frames: int = RANGE_FRAMES) -> DataFrame:
    """``ranges`` with ``rows``: the list of ``frame_idx`` and ``columns`` of what ``rows`` has for their frames.

    Both sides meet on the stretch of ``frames`` frames that a frame is in, so no key has
    more rows than a stretch; a row outside all ranges is left out.
    """
    stretch = lambda c: F.floor(F.col(c) / frames).cast("long")
    spans = ranges.select("video", "part", "first", "last").withColumn("_at", F.explode(F.sequence(stretch("first"), F.floor((F.col("last") - 1) / frames).cast("long"))))
    named = rows.select("video", stretch("frame_idx").alias("_at"), F.struct("frame_idx", *columns).alias("_row"))
    inside = named.join(spans, ["video", "_at"]).where((F.col("_row.frame_idx") >= F.col("first")) & (F.col("_row.frame_idx") < F.col("last")))
    lists = inside.groupBy("video", "part").agg(F.collect_list("_row").alias("rows"))
    return ranges.join(lists, ["video", "part"], how)


def dealt(ranges: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows``, one for each of ``ranges`` or fewer, in as many partitions as their decoded bytes ask for."""
    n = ranges.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(n["n"], max(cores, -(-(n["bytes"] or 0) // PARTITION_BYTES)))))


def decoded(path: str, first: int, last: int, decoders: dict[str, Decoder | Range]) -> Iterator[tuple[int, np.ndarray]]:
    """Number and frame of a range's frames; ``OSError`` if the recording ends before it does."""
    decoder = decoders.get(Path(path).suffix, decode_opencv)
    k = first
    for k, frame in enumerate(decoder.read(path, first, last) if isinstance(decoder, Range) else decoder(path), first):
        if k >= last:
            break
        yield k, frame
    else:
        if k + 1 < last:
            raise OSError(f"{path} ends after {k + 1} of {last} frames")


def made(path: str, first: int, last: int, rows: Iterable[dict] | None, decoders: dict[str, Decoder | Range], make: Make) -> Iterator[tuple[int, np.ndarray]]:
    """What ``make`` makes of a range's frames and their rows."""
    at = {r["frame_idx"]: r for r in rows or ()}
    for k, frame in decoded(path, first, last, decoders):
        out = make(k, frame, at.get(k))
        if out is not None:
            yield k, out


def packed(video: str, frames: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Frames as rows of a frame table, in batches of bounded bytes."""
    held: list[tuple[int, np.ndarray]] = []
    filled = 0

    def batch() -> pa.RecordBatch:
        sizes = [(*f.shape, 1)[:3] for _, f in held]
        columns = [pa.array([video] * len(held), pa.string()), pa.array([k for k, _ in held], pa.int64()), *(pa.array([s[j] for s in sizes], pa.int32()) for j in range(3))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([np.ascontiguousarray(f).tobytes() for _, f in held], pa.binary())], FRAMES.names)

    for k, frame in frames:
        held.append((k, frame))
        filled += frame.nbytes
        if filled >= BATCH_BYTES:
            yield batch()
            held, filled = [], 0
    if held:
        yield batch()


def make_frames(ranges: DataFrame, rows: DataFrame, columns: Sequence[str], make: Make, how: str = "inner") -> DataFrame:
    """A frame table of what ``make`` makes of the frames of ``ranges`` (from ``frame_ranges``) and ``rows``.

    Decoding happens in the task that makes; with ``how`` "inner" ranges that ``rows`` has
    nothing for aren't decoded.
    """
    decoders = dict(FrameSource.decoders)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for video, path, first, last, own in zip(*b.columns):
                yield from packed(video.as_py(), made(path.as_py(), first.as_py(), last.as_py(), own.as_py(), decoders, make))

    return dealt(ranges, with_rows(ranges, rows, columns, how).select("video", "path", "first", "last", "rows")).mapInArrow(run, FRAMES)
