"""Recordings on disk: discovery, container metadata, blank-frame lists."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import stem
from . import mp4
from .files import dealt, opened, plain

# How recordings are named; a fixed value of the data format.
PATTERN = "session-*_cuttle-*.mp4"

Info = tuple[int, float, int, int]
#: Probes by suffix: path to (frames, frames per second, width, height). ``register_probe`` adds more.
_probes: dict[str, Callable[[str], Info]] = {}


def register_probe(suffix: str, probe: Callable[[str], Info]) -> None:
    _probes[suffix] = probe


def listing(spark: SparkSession, folder: str | Path, pattern: str) -> list[str]:
    """Paths directly in a folder of any file system that Spark knows, sorted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(str(folder))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise FileNotFoundError(f"no such directory: {folder}")
    if fs.getScheme() == "file":
        # in Python: asking the JVM for every name takes longer than listing them
        return sorted(str(p) for p in Path(path.toUri().getPath()).glob(pattern))
    return sorted(f.getPath().toString() for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, pattern)) or [])


#: Folders, or one; all of one file system.
Folders = str | Path | Iterable[str | Path]
#: Names, or rows, that are handed over at once.
BATCH_ROWS = 10_000


def _found(spark: SparkSession, folders: Folders, pattern: str) -> DataFrame:
    """``path, stem`` of what matches directly in ``folders``.

    Folders that executors share are listed there, one by one, so names never pass through the
    driver. Other file systems are known to the driver only, which lists them.
    """
    folders = [str(f) for f in ([folders] if isinstance(folders, (str, Path)) else folders)]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folders[0]) if folders else None
    if at is not None and at.getFileSystem(conf).getScheme() != "file":
        found = spark.createDataFrame([(p,) for f in folders for p in listing(spark, f, pattern)], "path string")
        return found.withColumn("stem", stem(F.col("path")))
    paths = [plain(f) for f in folders]
    for f in paths:
        if not os.path.isdir(f):
            raise FileNotFoundError(f"no such directory: {f}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matches = re.compile(fnmatch.translate(pattern)).match
        for b in batches:
            for folder in b.folder:
                names = []
                with os.scandir(folder) as entries:
                    for e in entries:
                        if matches(e.name):
                            names.append(f"{folder}/{e.name}")
                        if len(names) == BATCH_ROWS:
                            yield pd.DataFrame({"path": names})
                            names = []
                if names:
                    yield pd.DataFrame({"path": names})

    found = spark.createDataFrame([(str(Path(f)),) for f in paths], "folder string").mapInPandas(run, "path string")
    return found.withColumn("stem", stem(F.col("path")))


def find_videos(spark: SparkSession, folders: Folders) -> DataFrame:
    """``path, stem`` of the recordings directly in ``folders``, also of empty files."""
    return _found(spark, folders, PATTERN)


def blank_files(spark: SparkSession, folders: Folders) -> DataFrame:
    """``path, stem`` of companion lists, also of empty ones (a text scan has no rows for those)."""
    return _found(spark, folders, PATTERN.replace(".mp4", ".txt"))


def blank_indices(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``stem, frame_idx`` of every line that isn't blank; repeats stay, other text fails the job.

    Lists are opened on the executors, and handed over together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names, places = [], []
            for path, name in zip(b.path, b.stem):
                with opened(path) as f:
                    lines = f.read().decode().split("\n")
                found = [int(x) for x in lines if x.strip()]
                names += [name] * len(found)
                places += found
                if len(places) >= BATCH_ROWS:
                    yield pd.DataFrame({"stem": names, "frame_idx": places})
                    names, places = [], []
            if places:
                yield pd.DataFrame({"stem": names, "frame_idx": places})

    return dealt(files.select("path", "stem")).mapInPandas(run, "stem string, frame_idx long")


def probe_mp4(path: str) -> Info:
    """Metadata of the first video track, from the boxes of an MP4 file; nothing is decoded.

    ``path`` may be a URI of a file system that Arrow knows.
    """
    return mp4.outline(path)


def probes() -> dict[str, Callable[[str], Info]]:
    """Every probe by suffix."""
    return {".mp4": probe_mp4, **_probes}


def video_info(videos: DataFrame) -> DataFrame:
    """``path, n_frames, fps, width, height``, as containers report them, probed on the executors."""
    known = probes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b.path:
                probe = known.get(Path(p).suffix)
                if probe is None:
                    raise OSError(f"no probe for {p}")
                rows.append((p, *probe(p)))
            yield pd.DataFrame(rows, columns=["path", "n_frames", "fps", "width", "height"])

    return dealt(videos.select("path")).mapInPandas(run, "path string, n_frames long, fps double, width int, height int")
