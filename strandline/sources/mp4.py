"""Sample tables of MP4 files: where every frame's bytes are, without decoding any.

A video track lists its samples in runs: how many ticks each lasts (``stts``), how far
showing is behind decoding (``ctts``), sizes (``stsz``), how many samples a chunk has
(``stsc``), where chunks begin (``stco`` or ``co64``) and which samples can be decoded
without others (``stss``; all of them where there is none). Expanded, that is a row per
frame, so a reader can begin at the keyframe before any frame and fetch only what it needs.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .files import dealt, opened
from .frames import Range

INDEX = "path string, frame_idx long, offset long, size long, ticks long, shown long, keyframe boolean"
#: Rows of an index that are handed over at once.
BATCH_ROWS = 16_384


@dataclass(frozen=True)
class Samples:
    """A track's samples in the order of decoding; times in ticks of ``scale`` a second."""

    scale: int
    lasts: int
    width: int
    height: int
    offset: np.ndarray
    size: np.ndarray
    ticks: np.ndarray
    shown: np.ndarray
    keyframe: np.ndarray

    def __len__(self) -> int:
        return len(self.size)

    @property
    def rate(self) -> float:
        """Frames a second: as many as there are over the time that they last."""
        return len(self) * self.scale / self.lasts if self.lasts else 0.0

    @property
    def starts(self) -> np.ndarray:
        """Samples that decoding can begin at; the first one always counts."""
        return np.flatnonzero(self.keyframe | (np.arange(len(self)) == 0))


def boxes(f, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, begin and end of the content of every box between two places of a file."""
    at = start
    while at + 8 <= stop:
        f.seek(at)
        size, kind = struct.unpack(">I4s", f.read(8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", f.read(8))[0], 16
        elif size == 0:
            size = stop - at
        if size < head:
            return
        yield kind, at + head, min(at + size, stop)
        at += size


#: Boxes that hold others, down to the sample tables.
_HOLDERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


def video_track(f) -> dict[bytes, bytes] | None:
    """The content of the first video track's boxes, by kind; None if there is no such track."""
    f.seek(0, 2)
    for kind, a, b in boxes(f, 0, f.tell()):
        for track, s, e in boxes(f, a, b) if kind == b"moov" else ():
            if track == b"trak":
                found, todo = {}, [(s, e)]
                while todo:
                    for inner, x, y in boxes(f, *todo.pop()):
                        if inner in _HOLDERS:
                            todo.append((x, y))
                        else:
                            f.seek(x)
                            found[inner] = f.read(y - x)
                if found.get(b"hdlr", b"")[8:12] == b"vide" and {b"tkhd", b"mdhd"} <= found.keys():
                    return found
    return None


def _table(box: bytes | None, columns: int, at: int = 4, kind: str = ">u4") -> np.ndarray:
    """The rows of a table whose length stands before it."""
    if box is None:
        return np.zeros((0, columns), np.int64)
    n = struct.unpack_from(">I", box, at)[0]
    return np.frombuffer(box, kind, n * columns, at + 4).astype(np.int64).reshape(n, columns)


def _runs(table: np.ndarray, n: int) -> np.ndarray:
    """Values of (count, value) runs written out to ``n``; the last goes on, none is 0."""
    values = np.repeat(table[:, 1], table[:, 0])[:n]
    return np.concatenate([values, np.full(n - len(values), values[-1] if len(values) else 0)])


def _track(path: str) -> tuple[dict[bytes, bytes], int, int, int]:
    """The boxes of a file's first video track, its scale, width and height; ``OSError`` if it has none."""
    with opened(path) as f:
        found = video_track(f)
    if found is None:
        raise OSError(f"{path} holds no video track")
    head = found[b"mdhd"]
    scale = struct.unpack_from(">I", head, 20 if head[0] == 1 else 12)[0]
    width, height = (v >> 16 for v in struct.unpack(">II", found[b"tkhd"][-8:]))
    return found, scale, width, height


def _uneven(path: str, n: int, places: int) -> OSError:
    return OSError(f"{path} has {n} samples and places for {places}")


def outline(path: str) -> tuple[int, float, int, int]:
    """(samples, samples a second, width, height) of a file's first video track, as ``samples`` has them, without a row per sample."""
    found, scale, width, height = _track(path)
    runs = _table(found.get(b"stts"), 2)
    n = struct.unpack_from(">I", found[b"stsz"], 8)[0] if b"stsz" in found else int(runs[:, 0].sum())
    wide = b"co64" in found
    chunks = _table(found.get(b"co64" if wide else b"stco"), 1, kind=">u8" if wide else ">u4")
    if n and len(chunks):
        per = _table(found.get(b"stsc"), 3)
        places = int((per[:, 1] * np.diff(np.append(per[:, 0], len(chunks) + 1))).sum())
        if places < n:
            raise _uneven(path, n, places)
    # runs are cut at n samples, and the last one goes on up to it
    ends = np.minimum(runs[:, 0].cumsum(), n)
    lasts = int((np.diff(ends, prepend=0) * runs[:, 1]).sum()) + ((n - int(ends[-1])) * int(runs[-1, 1]) if len(runs) else 0)
    return n, n * scale / lasts if lasts else 0.0, width, height


def samples(path: str) -> Samples:
    """The samples of a file's first video track; ``OSError`` if it has none or its tables don't agree."""
    found, scale, width, height = _track(path)
    runs = _table(found.get(b"stts"), 2)
    each, n = struct.unpack_from(">II", found[b"stsz"], 4) if b"stsz" in found else (0, int(runs[:, 0].sum()))
    size = np.full(n, each, np.int64) if each or b"stsz" not in found else _table(found[b"stsz"], 1, 8)[:, 0]
    wide = b"co64" in found
    chunks = _table(found.get(b"co64" if wide else b"stco"), 1, kind=">u8" if wide else ">u4")[:, 0]
    offset = np.zeros(n, np.int64)
    if n and len(chunks):
        # (first chunk, samples per chunk, description), each until the next one's first chunk
        per = _table(found.get(b"stsc"), 3)
        counts = np.repeat(per[:, 1], np.diff(np.append(per[:, 0], len(chunks) + 1)))
        if counts.sum() < n:
            raise _uneven(path, n, counts.sum())
        chunk = np.repeat(np.arange(len(chunks)), counts)[:n]
        before = size.cumsum() - size
        first = np.searchsorted(chunk, np.arange(len(chunks)))
        offset = chunks[chunk] + before - before[np.minimum(first, n - 1)][chunk]
    delta = _runs(runs, n)
    ticks = delta.cumsum() - delta
    behind = found.get(b"ctts")
    shown = ticks + _runs(_table(behind, 2, kind=">i4" if behind and behind[0] else ">u4"), n)
    keyframe = np.ones(n, bool)
    if b"stss" in found:
        keyframe[:] = False
        keyframe[_table(found[b"stss"], 1)[:, 0] - 1] = True
    return Samples(scale, int(delta.sum()), width, height, offset, size, ticks, shown, keyframe)


def sample_index(files: DataFrame) -> DataFrame:
    """A row per frame of every file in ``files`` (``path``): where its bytes are and when it is decoded and shown.

    Tables are read on the executors, in batches: a long recording is many, short ones share one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        paths, held = [], []

        def batch_of() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            which = np.repeat(np.arange(len(paths)), [len(h[0]) for h in held])
            made = pa.RecordBatch.from_arrays([pa.array(paths).take(pa.array(which)), *(pa.array(c) for c in columns)], names)
            paths.clear()
            held.clear()
            return made

        rows = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                got = samples(path)
                for a in range(0, len(got), BATCH_ROWS):
                    part = slice(a, min(a + BATCH_ROWS, len(got)))
                    if rows + part.stop - a > BATCH_ROWS:
                        yield batch_of()
                        rows = 0
                    paths.append(path)
                    held.append([np.arange(a, part.stop), *(v[part] for v in (got.offset, got.size, got.ticks, got.shown, got.keyframe))])
                    rows += part.stop - a
        if rows:
            yield batch_of()

    return dealt(files.select("path")).mapInArrow(run, INDEX)


#: Frames of samples, in order: each sample's bytes in, an array out.
SampleDecoder = Callable[[Iterator[bytes]], Iterator[np.ndarray]]


def seeking(decode: SampleDecoder, frame_bytes: Callable[[Samples], int] = lambda s: s.width * s.height * 3) -> Range:
    """A decoder of MP4 files by ranges: from the keyframe before a range on, and only that far.

    ``decode`` gets the bytes of samples one by one; frames before the range are dropped.
    """

    def read(path: str, start: int, stop: int) -> Iterator[np.ndarray]:
        got = samples(path)
        starts = got.starts
        key = int(starts[np.searchsorted(starts, start, side="right") - 1]) if len(starts) else 0
        stop = min(stop, len(got))

        def fetched() -> Iterator[bytes]:
            with opened(path) as f:
                for at, n in zip(got.offset[key:stop].tolist(), got.size[key:stop].tolist()):
                    f.seek(at)
                    data = f.read(n)
                    if len(data) != n:
                        raise OSError(f"{path} ends within a frame")
                    yield data

        for k, frame in enumerate(decode(fetched()), key):
            if k >= start:
                yield frame

    def shape(path: str) -> tuple[int, int]:
        got = samples(path)
        return len(got), frame_bytes(got)

    return Range(shape, read, lambda path: samples(path).starts)
