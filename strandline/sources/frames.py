"""The ``frames`` data source: one row per frame, a recording cut into ranges of frames.

Decoding is a plug-in by suffix. Built in is ``.npy`` (a stack of frames), which is read
by range; OpenCV is used for video files where it is installed, from their beginning, so
those are one partition each. Batches of frames are handed over as Arrow tables. Spark's
reader interface doesn't tell a Python source which columns are wanted, so
``metadata_only`` leaves pixels out. Filters aren't pushed down: Spark 4.1 keeps what one
query pushed for the next query on the same table, which then lacks rows. ``only`` names
the recordings to read instead.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import FRAMES
from .files import opened

#: Bytes of pixels that a batch holds and that a partition is cut at.
BATCH_BYTES = 8 << 20
PARTITION_BYTES = 128 << 20

Decoder = Callable[[str], Iterator[np.ndarray]]


@dataclass(frozen=True)
class Range:
    """A decoder that can start anywhere: ``shape(path)`` is (frames, bytes of one), ``read(path, start, stop)`` gives frames.

    ``starts(path)`` are the frames, in order and from 0, where starting costs nothing extra; without it all are.
    """

    shape: Callable[[str], tuple[int, int]]
    read: Callable[[str, int, int], Iterator[np.ndarray]]
    starts: Callable[[str], np.ndarray] | None = None


def cuts(decoder: Range, path: str, n: int, step: int) -> list[int]:
    """Where to cut a recording of ``n`` frames into ranges of about ``step``: at starts, and at its end."""
    at = np.arange(0, n, step)
    if decoder.starts is not None and n:
        starts = np.asarray(decoder.starts(path))
        at = np.unique(starts[np.searchsorted(starts, at, side="right") - 1])
    return [*at.tolist(), n]


def _npy_head(f) -> tuple[tuple[int, ...], np.dtype, int]:
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran or kind != np.uint8 or len(shape) not in (3, 4):
        raise OSError("frames must be a C-ordered uint8 array of three or four axes")
    return shape, kind, f.tell()


def _npy_shape(path: str) -> tuple[int, int]:
    with opened(path) as f:
        shape, _, _ = _npy_head(f)
    return shape[0], int(np.prod(shape[1:]))


def _npy_read(path: str, start: int, stop: int) -> Iterator[np.ndarray]:
    with opened(path) as f:
        shape, kind, at = _npy_head(f)
        size = int(np.prod(shape[1:]))
        f.seek(at + start * size)
        for _ in range(start, min(stop, shape[0])):
            data = f.read(size)
            if len(data) != size:
                raise OSError(f"{path} ends within a frame")
            yield np.frombuffer(data, kind).reshape(shape[1:])


decode_npy = Range(_npy_shape, _npy_read)


def decode_opencv(path: str) -> Iterator[np.ndarray]:
    """Frames through OpenCV, where it is installed; it opens plain paths only."""
    try:
        import cv2
    except ImportError as e:
        raise OSError(f"no decoder for {path}: OpenCV is not installed") from e
    source = cv2.VideoCapture(path)
    try:
        if not source.isOpened():
            raise OSError(f"{path} is no video that OpenCV can read")
        got, frame = source.read()
        while got:
            yield frame
            got, frame = source.read()
    finally:
        source.release()


@dataclass
class Part(InputPartition):
    path: str
    start: int = 0
    stop: int | None = None


def _name(path: str) -> str:
    return Path(path).stem


class FrameReader(DataSourceReader):
    def __init__(self, paths: list[str], decoders: dict[str, Decoder | Range], pixels: bool, partition_bytes: int = PARTITION_BYTES):
        self.paths, self.decoders, self.pixels, self.partition_bytes = paths, decoders, pixels, partition_bytes

    def _decoder(self, path: str) -> Decoder | Range:
        return self.decoders.get(Path(path).suffix, decode_opencv)

    def partitions(self):
        parts = []
        for p in self.paths:
            decoder = self._decoder(p)
            if not isinstance(decoder, Range):
                parts.append(Part(p))
                continue
            n, size = decoder.shape(p)
            at = cuts(decoder, p, n, max(1, self.partition_bytes // max(1, size)))
            parts += [Part(p, a, b) for a, b in zip(at, at[1:]) if b > a]
        return parts or [Part("")]

    def read(self, partition):
        path = partition.path
        if not path:
            return
        decoder = self._decoder(path)
        frames = decoder.read(path, partition.start, partition.stop) if isinstance(decoder, Range) else decoder(path)
        held, filled, first = [], 0, partition.start

        def batch() -> pa.RecordBatch:
            n, shapes = len(held), [f.shape for f in held]
            pixels = [np.ascontiguousarray(f).tobytes() for f in held] if self.pixels else [None] * n
            columns = [pa.array([_name(path)] * n, pa.string()), pa.array(range(first, first + n), pa.int64())]
            columns += [pa.array([s[k] if k < len(s) else 1 for s in shapes], pa.int32()) for k in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(pixels, pa.binary())], FRAMES.names)

        for frame in frames:
            held.append(frame)
            filled += frame.nbytes
            if filled >= BATCH_BYTES:
                yield batch()
                first += len(held)
                held, filled = [], 0
        if held:
            yield batch()


class FrameSource(DataSource):
    """Options: ``paths`` (newline-separated), ``metadata_only``, ``partition_bytes``."""

    decoders: dict[str, Decoder | Range] = {".npy": decode_npy}

    @classmethod
    def name(cls):
        return "frames"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        paths = [p for p in self.options.get("paths", "").split("\n") if p]
        pixels = self.options.get("metadata_only", "false").lower() != "true"
        return FrameReader(paths, dict(self.decoders), pixels, int(self.options.get("partition_bytes", PARTITION_BYTES)))


def register_decoder(suffix: str, decoder: Decoder | Range) -> None:
    """``decoder`` for files of a suffix: a function from a path to its frames, or a ``Range``."""
    FrameSource.decoders[suffix] = decoder


def read_frames(spark: SparkSession, paths: list[str | Path], metadata_only: bool = False, only: Collection[str] | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Frames of the recordings in ``paths``, or of those of them that ``only`` names (file names without suffix)."""

    class Named(FrameSource):
        """The source with the decoders that are registered here; the workers' own class wouldn't know them."""

        decoders = dict(FrameSource.decoders)

    spark.dataSource.register(Named)
    wanted = [str(p) for p in paths if only is None or _name(str(p)) in only]
    options = {"paths": "\n".join(wanted), "metadata_only": str(metadata_only).lower(), "partition_bytes": str(partition_bytes)}
    return spark.read.format("frames").options(**options).load()
