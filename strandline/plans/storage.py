"""Cutting lineage: tables settled in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where it names none, a temporary folder is set if executors run on this machine, as in
    tests. Elsewhere that would be a folder no executor sees, so it is a ``ValueError``.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: What was settled inside each open ``cleaned`` block.
_scopes: list[list[str]] = []


def settle(df: DataFrame, replaces: DataFrame | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lost executors cost nothing.

    Written tables rather than checkpoints, as those keep the estimated sizes of the plan
    they came from, and in a loop with joins the estimates multiply until they overflow.
    ``replaces`` is an earlier settled table that nothing needs any more; it is deleted.
    ``options`` are the Parquet writer's.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.options(**options or {}).parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    if old := getattr(replaces, "_settled_at", None):
        delete(spark, old)
    return out


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Delete at the end whatever was settled inside; results must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)
