"""Text tables: pose predictions with three header rows, geometry files, and their sinks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import present, stem
from ..schema import CORNERS, GEOMETRY, KEYPOINTS
from . import sinks


def read_pose(spark: SparkSession, *paths: str | Path) -> DataFrame:
    """``video, frame_idx`` and the tail and neck keypoints of pose files.

    Header rows name scorer, body part and coordinate. Columns are found by name, so their
    order and other body parts don't matter; a file without a needed column fails. Empty
    cells and NaN are null. Large folders can be given as one path.
    """
    text = spark.read.text([str(p) for p in paths], wholetext=True)
    lines = text.select(stem(F.col("_metadata.file_path")).alias("video"), F.split("value", r"\r?\n").alias("l"))
    cells = lambda k: F.split(F.get("l", F.lit(k)), ",")
    names = F.zip_with(cells(1), cells(2), lambda part, coord: F.concat_ws("_", F.trim(part), F.trim(coord)))
    rows = (
        lines.withColumn("names", names)
        .select("video", "names", F.explode(F.slice("l", 4, F.greatest(F.size("l") - 3, F.lit(0)))).alias("line"))
        .where("trim(line) != ''")
        .select("video", "names", F.split("line", ",").alias("c"))
    )

    def value(name: str):
        at = F.array_position("names", name).cast("int")
        missing = F.raise_error(F.concat(F.lit(f"no column {name} in pose file "), F.col("video"))).cast("double")
        cell = F.trim(F.get("c", at - 1))
        return F.when(at == 0, missing).otherwise(present(F.when(cell != "", cell).cast("double"))).alias(name)

    return rows.select("video", F.trim(F.get("c", F.lit(0))).cast("double").cast("long").alias("frame_idx"), *[value(k) for k in KEYPOINTS])


def read_geometry(spark: SparkSession, *paths: str | Path) -> DataFrame:
    """``video`` and the columns of geometry files; rows are keyed by ``frame_idx``."""
    rows = spark.read.schema(GEOMETRY).option("header", True).csv([str(p) for p in paths])
    return rows.select(stem(F.col("_metadata.file_path")).alias("video"), *[f.name for f in GEOMETRY])


def write_geometry(geometry: DataFrame, folder: str | Path) -> None:
    """One ``{video}.csv`` per video in ``folder``; all of them or, if a task fails, none."""
    columns = ["frame_idx", *CORNERS, "is_interpolated"]
    sinks.save(geometry.select("video", *columns), folder, ".csv", sinks.csv_form(",".join(columns) + "\n", columns))


def write_pose(pose: DataFrame, folder: str | Path) -> None:
    """One pose file per video in ``folder``, as ``read_pose`` takes them; all of them or none."""
    names, columns = [k.split("_") for k in KEYPOINTS], ["frame_idx", *KEYPOINTS]
    heads = [["scorer", *["none"] * len(names)], ["bodyparts", *[n[0] for n in names]], ["coords", *[n[1] for n in names]]]
    sinks.save(pose.select("video", *columns), folder, ".csv", sinks.csv_form("".join(",".join(h) + "\n" for h in heads), columns))


def write_manifest(manifest: DataFrame, path: str | Path) -> None:
    """Overwrite the manifest as Parquet, in as many parts as it was made in."""
    manifest.write.mode("overwrite").parquet(str(path))
