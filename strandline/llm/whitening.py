"""Embedding whitening by hierarchical SVD merging.

Every task turns its vectors into a summary: their number, their exact sums and the
singular values and right vectors of the centred rows, all of them. Two summaries merge
by stacking both and a row that corrects for the difference of their means, and taking
the singular values of that; nothing is cut, so the order of merging doesn't matter
beyond rounding. Summaries merge in a tree of groups of ``FAN``, on executors; what
reaches the driver is one summary, whose size depends on the dimensions alone.

Entries are counted in whole steps, ``x = floor(1024 * c) + 100000``, so sums are exact
and rows are centred before anything is multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle

COMPONENTS = 8
#: Summaries that one task merges at a time.
FAN = 16
#: Rows whose singular values are taken at once.
BLOCK = 2048
STEPS, OFFSET = 1024, 100_000
#: Entries beyond this many steps count as this many.
MOST_STEPS = float(1 << 52)
#: Directions with a smaller share of the largest singular value hold no variance but rounding.
LEAST_SHARE = 1e-10

SUMMARY = "n long, sums string, root binary"


@dataclass
class Summary:
    """``n`` rows, their exact ``sums``, and ``root``: singular values times right vectors of the centred rows."""

    n: int
    sums: list[int]
    root: np.ndarray

    def packed(self) -> tuple[int, str, bytes]:
        return self.n, ",".join(map(str, self.sums)), self.root.astype("<f8").tobytes()

    @staticmethod
    def unpacked(n: int, sums: str, root: bytes) -> Summary:
        whole = [int(s) for s in sums.split(",")]
        return Summary(n, whole, np.frombuffer(root, "<f8").reshape(-1, len(whole)))


def steps(vectors: np.ndarray) -> np.ndarray:
    """Entries as whole numbers of steps."""
    return np.clip(np.floor(STEPS * vectors.astype(np.float64)), -MOST_STEPS, MOST_STEPS).astype(np.int64) + OFFSET


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: as int64 where that is wide enough, else as Python's integers."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _root(rows: np.ndarray) -> np.ndarray:
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def summary(x: np.ndarray) -> Summary:
    n = len(x)
    safe = n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62
    sums = [int(s) for s in (x if safe else x.astype(object)).sum(axis=0)]
    return Summary(n, sums, _root((deviations(x, n, sums) / n).astype(np.float64)))


def merged(a: Summary, b: Summary) -> Summary:
    """Both summaries as one of all their rows."""
    n = a.n + b.n
    # the means' difference as a quotient of whole numbers, so that nothing cancels
    apart = np.array([(q * a.n - p * b.n) / (a.n * b.n) for p, q in zip(a.sums, b.sums)])
    bridge = math.sqrt(a.n * b.n / n) * apart
    return Summary(n, [p + q for p, q in zip(a.sums, b.sums)], _root(np.vstack([a.root, b.root, bridge])))


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vectors`` whose vector is whole: neither null nor with null or non-finite entries.

    Of vectors of several lengths those of the commonest length stay, of the longest among
    equals, and empty vectors go.
    """
    whole = vectors.where(F.forall(F.col(f"`{column}`"), lambda e: F.coalesce(F.abs(e) < F.lit(math.inf), F.lit(False))))
    size = F.size(F.col(f"`{column}`"))
    lengths = whole.where(size > 0).groupBy(size.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return whole.where(size == (lengths["size"] if lengths else -1))


@dataclass
class Whitener:
    """Means and principal components of the rows it was fitted to, by falling eigenvalue."""

    n: int
    sums: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def _blocks(batch: pa.Array) -> Iterator[np.ndarray]:
    for k in range(0, len(batch), BLOCK):
        part = batch.slice(k, BLOCK)
        yield steps(part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1))


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, fan: int = FAN) -> Whitener | None:
    """The whitener of ``vectors`` (from ``usable``); None if there are none.

    Of a component the entry that is largest in size is positive. Directions without
    variance are no components: a single row, or equal ones, have none.
    """

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for x in _blocks(b.column(0)):
                held = summary(x) if held is None else merged(held, summary(x))
        if held is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("n", "sums", "root"), held.packed()))])

    def merge(group: pa.Table) -> pa.Table:
        parts = sorted((r["n"], r["sums"], r["root"]) for r in group.to_pylist())
        n, sums, root = reduce(merged, (Summary.unpacked(*p) for p in parts)).packed()
        return pa.table({"n": [n], "sums": [sums], "root": [root], "at": [group["at"][0].as_py() // fan]}, schema=pa.schema([("n", pa.int64()), ("sums", pa.string()), ("root", pa.binary()), ("at", pa.int64())]))

    own = vectors.select(F.col(f"`{column}`").alias("v")).mapInArrow(summarise, SUMMARY)
    parts = settle(own.withColumn("at", F.spark_partition_id().cast("long")))
    places = parts.agg(F.max("at")).first()[0]
    if places is None:
        return None
    level = parts
    while places:
        level = level.groupBy(F.floor(F.col("at") / fan).cast("long").alias("k")).applyInArrow(merge, f"{SUMMARY}, at long")
        places //= fan
    top = Summary.unpacked(*level.select("n", "sums", "root").first())
    _, s, vt = np.linalg.svd(top.root, full_matrices=False)
    some = int(min(components, (s > s[0] * LEAST_SHARE).sum())) if len(s) and s[0] > 0 else 0
    axes = vt[:some] * np.sign(vt[np.arange(some), np.abs(vt[:some]).argmax(axis=1)])[:, None]
    return Whitener(top.n, top.sums, axes, s[:some] ** 2 / top.n, float((s**2).sum() / top.n))


def _squares(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares per row; None where a long can't hold one."""
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    return [t if t < 1 << 63 else None for t in (sum(int(v) ** 2 for v in row) for row in d)]


def whiten(vectors: DataFrame, fitted: Whitener, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``id_col``, ``deviation`` and ``whitened`` (array, a number per component) of every row.

    ``deviation`` is the sum of squares of ``n * x - sums``, null where a long can't hold
    it. Row by row, so repeated rows are all returned.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for x in _blocks(b.column(1)):
                d = deviations(x, fitted.n, fitted.sums)
                white = (d / fitted.n).astype(np.float64) @ fitted.axes.T / np.sqrt(fitted.eigenvalues)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(x)), pa.array(_squares(d), pa.int64()), lists], ["id", "deviation", "whitened"])
                at += len(x)

    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{column}`").alias("v"))
    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def identity_error(white: DataFrame, components: int) -> float:
    """Largest absolute entry of the whitened rows' covariance (divisor n, centred) minus the identity."""
    w = [F.col("whitened")[k] for k in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    found = white.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def components_table(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: ``component, n, deviation, whitened, explained, identity_error``.

    Null vectors and those with null or non-finite entries are left out, and those of a length
    other than the commonest; a null id stays null. Without variance there are no components
    and so no rows, as for an empty table.
    """
    rows = usable(vectors, column)
    fitted = fit(rows, column, components)
    kind = vectors.schema[id_col].dataType
    if fitted is None or not len(fitted.axes):
        names = {"component": T.IntegerType(), "n": T.LongType(), "deviation": T.LongType(), "whitened": T.DoubleType(), "explained": T.DoubleType(), "identity_error": T.DoubleType()}
        return vectors.sparkSession.createDataFrame([], T.StructType([T.StructField(id_col, kind), *(T.StructField(k, t) for k, t in names.items())]))
    white = whiten(rows, fitted, id_col, column)
    error = identity_error(white, len(fitted.axes))
    share = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.eigenvalues])
    long = white.select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        id_col, (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
