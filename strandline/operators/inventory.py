"""Inventory algebra: names, companion files, manifests and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import name_part, stem
from ..schema import MANIFEST


def parse_names(videos: DataFrame, path: str = "path") -> DataFrame:
    """``videos`` with ``stem, session_id, fish_id``; the ids are null where the name doesn't parse."""
    s = stem(F.col(path))
    return videos.withColumns({"stem": s, "session_id": name_part(s, 1), "fish_id": name_part(s, 2)})


def unexpected_names(named: DataFrame) -> DataFrame:
    """Paths that discovery finds and the manifest skips."""
    return named.where("session_id is null").select("path", F.lit("unexpected name").alias("warning"))


def count_per_key(rows: DataFrame, key: str, index: str) -> DataFrame:
    """``key, n, largest``: rows (repeats counted) and the largest index, summed per task first."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.max(index).alias("largest"))


def with_companions(left: DataFrame, files: DataFrame, counts: DataFrame, key: str = "stem") -> DataFrame:
    """Left join to companion files: ``companion`` (path or null) and ``n_blank_frames``.

    An absent file gives nulls; a file without rows gives 0. That a file exists must
    therefore come from a listing (``files``), not from its rows (``counts``).
    """
    return (
        left.join(files.select(key, F.col("path").alias("companion")), key, "left")
        .join(counts, key, "left")
        .withColumn("n_blank_frames", F.when(F.col("companion").isNotNull(), F.coalesce("n", F.lit(0)).cast("long")))
        .drop("n")
    )


def out_of_range(manifest: DataFrame) -> DataFrame:
    """Warnings where the largest listed index isn't in the video; negative ones aren't looked at."""
    return manifest.where("largest >= n_frames").select("path", _outside().alias("warning"))


def _outside() -> Column:
    return F.format_string("index %d outside %d frames", "largest", "n_frames")


def companion_warnings(manifest: DataFrame) -> DataFrame:
    """Warnings where a video has no companion, and those of ``out_of_range``, in one pass."""
    found = F.array(F.when(F.col("companion").isNull(), F.lit("no blank-frames file")), F.when(F.expr("largest >= n_frames"), _outside()))
    return manifest.select("path", F.explode(F.array_compact(found)).alias("warning"))


def missing(left: DataFrame, existing: DataFrame, key: str = "stem") -> DataFrame:
    """Rows of ``left`` that have no partner: what is still to be computed."""
    return left.join(existing.select(key).distinct(), key, "left_anti")


def as_manifest(df: DataFrame) -> DataFrame:
    """The manifest's columns and types, also for an empty table."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MANIFEST])


def summary(manifest: DataFrame) -> DataFrame:
    """One row: videos, sessions, frames, frames flagged blank (0 if no file lists any)."""
    return manifest.agg(
        F.count("*").alias("n_videos"),
        F.countDistinct("session_id").alias("n_sessions"),
        F.coalesce(F.sum("n_frames"), F.lit(0)).alias("total_frames"),
        F.coalesce(F.sum("n_blank_frames"), F.lit(0)).alias("total_blank_frames"),
    )
