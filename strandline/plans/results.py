"""What has been computed already: a table of results by the content of their inputs.

A result is named by its recording, a digest of the recording's and its pose file's bytes, and
a mark of the settings. Files are digested in blocks, so that a long recording is
read by many tasks. What is to be computed is an anti join; a replaced file has another
digest and so is computed again, whatever its name and time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Mapping
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import opened
from .storage import settle

#: Name of the table beside the results.
FOLDER = "_results"
BLOCK_BYTES = 32 << 20


def digests(spark: SparkSession, paths: Iterable[str | Path], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path, digest`` (hex) of files: SHA-256 over the SHA-256 of every block; an empty file is one block."""
    listed = spark.createDataFrame([(str(p),) for p in paths], "path string")

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                with opened(path) as f:
                    f.seek(0, 2)
                    n = max(1, -(-f.tell() // block_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(n), pa.int64())], ["path", "block"])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, k in zip(*(c.to_pylist() for c in b.columns)):
                with opened(path) as f:
                    f.seek(k * block_bytes)
                    out.append(hashlib.sha256(f.read(block_bytes)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["path", "block", "sha"])

    cut = settle(listed.mapInArrow(blocks, "path string, block long"))
    tasks = max(1, min(cut.count(), 8 * spark.sparkContext.defaultParallelism))
    each = cut.repartition(tasks).mapInArrow(digest, "path string, block long, sha string")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("block", "sha"))), lambda x: x["sha"])
    return each.groupBy("path").agg(F.sha2(F.array_join(in_order, ""), 256).alias("digest"))


def inputs(spark: SparkSession, paths: Iterable[str | Path], posed: Mapping[str, str | Path]) -> DataFrame:
    """``stem, digest`` (settled) of recordings, each together with its pose file if ``posed`` names one by stem."""
    paths = [str(p) for p in paths]
    known = digests(spark, {*paths, *(str(p) for p in posed.values())})
    rows = spark.createDataFrame([(Path(p).stem, p, str(posed[Path(p).stem]) if Path(p).stem in posed else None) for p in paths], "stem string, path string, pose string")
    poses = known.select(F.col("path").alias("pose"), F.col("digest").alias("pose_digest"))
    return settle(rows.join(known, "path").join(poses, "pose", "left").select("stem", F.sha2(F.concat_ws(":", "digest", F.coalesce("pose_digest", F.lit("none"))), 256).alias("digest")))


def recorded(spark: SparkSession, folder: str | Path) -> DataFrame:
    """``stem, digest, mark`` of everything computed so far; none where nothing was."""
    try:
        return spark.read.parquet(str(folder)).select("stem", "digest", "mark")
    except AnalysisException:
        return spark.createDataFrame([], "stem string, digest string, mark string")


def missing(wanted: DataFrame, folder: str | Path, mark: str) -> DataFrame:
    """Rows of ``wanted`` (``stem, digest``) that the table has no result for, under ``mark``."""
    spark = wanted.sparkSession
    return wanted.join(recorded(spark, folder).where(F.col("mark") == mark), ["stem", "digest"], "left_anti")


def record(done: DataFrame, folder: str | Path, mark: str) -> None:
    """Add ``done`` (``stem, digest``) in place of what the table said of these recordings before.

    A file holds one result, so a recording has one row. The new table is written in
    full beside the old one and takes its place.
    """
    spark = done.sparkSession
    others = recorded(spark, folder).join(done, "stem", "left_anti")
    settle(others.unionByName(done.withColumn("mark", F.lit(mark)))).write.mode("overwrite").parquet(str(folder))
