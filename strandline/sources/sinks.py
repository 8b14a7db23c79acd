"""The ``video_files`` data source: one file per video, committed when all are written.

Tasks write drafts into a folder of the job's own beside the final files. When every task
is done the drafts of the attempts that count are moved to their places; if any task fails
for good, the folder is removed and what was there before is untouched. A retried or
speculative attempt writes drafts of its own, which nobody moves.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import files

#: Writes the batches of one video to an open file.
Form = Callable[[object, Iterator[pa.RecordBatch]], None]


def csv_form(head: str, columns: list[str]) -> Form:
    """Lines of ``columns`` below a head; missing values are empty cells."""

    def write(f, batches: Iterator[pa.RecordBatch]) -> None:
        f.write(head.encode())
        for b in batches:
            f.write(b.to_pandas()[columns].to_csv(index=False, header=False).encode())

    return write


def stack_head(shape: tuple[int, ...], room: int | None = None) -> bytes:
    """The head of an ``.npy`` file of bytes, padded to ``room`` if that is given."""
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": "|u1", "fortran_order": False, "shape": shape})
    head = out.getvalue()
    if room is None or len(head) == room:
        return head
    text = head[10:].rstrip(b" \n").ljust(room - 11) + b"\n"
    return head[:8] + len(text).to_bytes(2, "little") + text


def stack_form(f, batches: Iterator[pa.RecordBatch]) -> None:
    """Frames (``height, width, channels, pixels``) as an ``.npy`` stack; the head is completed at the end."""
    n, room, shape = 0, 0, ()
    for b in batches:
        for height, width, channels, pixels in zip(*(b.column(c).to_pylist() for c in ("height", "width", "channels", "pixels"))):
            if not n:
                shape = (height, width) if channels == 1 else (height, width, channels)
                head = stack_head((10**9, *shape))
                room = len(head)
                f.write(head)
            if len(pixels) != int(np.prod(shape)):
                raise ValueError("frames of one video differ in size")
            f.write(pixels)
            n += 1
    f.seek(0)
    f.write(stack_head((n, *shape), room))


@dataclass
class Written(WriterCommitMessage):
    """Drafts of one task and where they go."""

    moves: list[tuple[str, str]] = field(default_factory=list)


class VideoFilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, suffix: str, form: Form):
        self.folder, self.suffix, self.form = files.make_folder(folder), suffix, form
        self.drafts = f"{self.folder}/.drafts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files.make_folder(self.drafts, everywhere=True)
        out = Written()
        for video, own in groupby(_by_video(iterator), key=lambda p: p[0]):
            if video is None:
                raise ValueError("a row without a video")
            final = f"{self.folder}/{video}{self.suffix}"
            if out.moves and final in {to for _, to in out.moves}:
                raise ValueError(f"rows of {video} aren't in one place; deal and sort them by video first")
            draft = f"{self.drafts}/{uuid.uuid4().hex}"
            with files.created(draft) as f:
                self.form(f, (b for _, b in own))
            out.moves.append((draft, final))
        return out

    def commit(self, messages: list[Written | None]) -> None:
        moves = [m for message in messages if message for m in message.moves]
        finals = [to for _, to in moves]
        if len(set(finals)) < len(finals):
            raise ValueError(f"two tasks wrote {next(t for t in finals if finals.count(t) > 1)}; deal rows by video first")
        for draft, final in moves:
            files.move(draft, final)
        files.remove_folder(self.drafts)

    def abort(self, messages: list[Written | None]) -> None:
        files.remove_folder(self.drafts)


def _by_video(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, pa.RecordBatch]]:
    """Batches cut where the video changes."""
    for b in batches:
        names = b.column("video").to_pylist()
        at = 0
        for video, run in groupby(names):
            n = len(list(run))
            yield video, b.slice(at, n)
            at += n


def save(rows: DataFrame, folder: str | Path, suffix: str, form: Form, order: str = "frame_idx") -> None:
    """Write one ``{video}{suffix}`` per video of ``rows`` in ``folder``, in order; all of them or none."""

    class VideoFiles(DataSource):
        """The source with its form, which the workers couldn't look up by name."""

        @classmethod
        def name(cls):
            return "video_files"

        def writer(self, schema, overwrite):
            return VideoFilesWriter(self.options["path"], self.options["suffix"], form)

    rows.sparkSession.dataSource.register(VideoFiles)
    dealt = rows.repartition("video").sortWithinPartitions("video", order)
    dealt.write.format("video_files").option("suffix", suffix).mode("append").save(files.plain(folder))


def save_stacks(frames: DataFrame, folder: str | Path, suffix: str = ".npy") -> None:
    """Frames as one ``.npy`` stack per video, on a file system whose files can be completed at their beginning."""
    save(frames.where("pixels is not null"), folder, suffix, stack_form)
