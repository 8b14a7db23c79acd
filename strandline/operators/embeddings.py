"""Embeddings: joined to their frames, projected to a plane, clustered.

Vectors are arrays of numbers; what comes to the driver is bounded by their length (a
covariance, two axes) or by the number of clusters.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_frames(embeddings: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Embeddings beside the frames that they belong to; others are left out."""
    return embeddings.join(manifest, list(keys))


def _constant(values: Sequence[float]) -> Column:
    """An array that is folded before the rows are read."""
    return F.from_json(F.lit(json.dumps(list(map(float, values)))), "array<double>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def principal_axes(vectors: DataFrame, column: str = "embedding", axes: int = 2) -> tuple[list[float], list[list[float]]]:
    """Mean and principal axes; of an axis the entry that is largest in size is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    rows = vectors.select(array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    mean = rows.select(Summarizer.mean(F.col("v"))).first()[0].toArray().tolist()
    found = PCA(k=axes, inputCol="v", outputCol="p").fit(rows).pc.toArray().T
    return mean, [(a if a[abs(a).argmax()] > 0 else -a).tolist() for a in found]


def project(vectors: DataFrame, column: str = "embedding", names: Sequence[str] = ("x", "y")) -> DataFrame:
    """``vectors`` with the coordinates along their principal axes, from the mean."""
    mean, axes = principal_axes(vectors, column, len(names))
    away = F.zip_with(F.col(column).cast("array<double>"), _constant(mean), lambda v, m: v - m)
    return vectors.withColumns({n: _dot(away, _constant(a)) for n, a in zip(names, axes)})


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which centre each row is nearest to, the first of equals, and the squared distance."""
    far = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _sums(vectors: DataFrame, column: str, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Members and sums of every centre, and the cost: each row is looked at once, and a task hands on one row per centre."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, cost = np.zeros(len(centres), np.int64), np.zeros(centres.shape), np.zeros(len(centres))
        for b in batches:
            x = _matrix(b.column(0))
            at, far = _nearest(x, centres)
            n += np.bincount(at, minlength=len(centres))
            cost += np.bincount(at, far, len(centres))
            np.add.at(total, at, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(cost[some]), pa.array(total[some].tolist(), pa.list_(pa.float64()))], ["centre", "n", "cost", "total"])

    each = vectors.where(F.col(column).isNotNull()).select(F.col(column).alias("v")).mapInArrow(run, "centre long, n long, cost double, total array<double>")
    parts = each.select("centre", "n", "cost", F.posexplode("total").alias("at", "x"))
    n, sums, far = np.zeros(len(centres), np.int64), np.zeros(centres.shape), np.zeros(len(centres))
    for r in parts.groupBy("centre", "at").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum("x").alias("x")).collect():
        n[r["centre"]], far[r["centre"]], sums[r["centre"], r["at"]] = r["n"], r["cost"], r["x"]
    return n, sums, float(far.sum())


def first_rows(vectors: DataFrame, id_col: str, column: str, k: int) -> np.ndarray:
    """The vectors of the ``k`` smallest ids."""
    return np.array([r[0] for r in vectors.where(F.col(column).isNotNull()).orderBy(id_col).select(column).limit(k).collect()], np.float64)


def spread_rows(vectors: DataFrame, id_col: str, column: str, k: int, passes: int = 4, per_pass: int = 2, seed: int = 0) -> np.ndarray:
    """``k`` centres spread by oversampling (k-means||).

    Each pass draws about ``per_pass * k`` rows, each with a chance in proportion to its squared
    distance from what was drawn before; draws come of a hash of id and pass, so a rerun
    draws the same. What was drawn, weighted by how many rows are nearest to it, is then
    reduced to ``k`` by drawing in proportion to weight and distance and a few rounds of
    Lloyd's iteration. Only what was drawn comes to the driver, some ``passes * per_pass * k`` rows.
    """
    drawn = first_rows(vectors, id_col, column, 1)
    for p in range(passes if len(drawn) else 0):
        _, _, cost = _sums(vectors, column, drawn)
        if not cost:
            break
        chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed), F.lit(p)), F.lit(1 << 52)) / float(1 << 52)
        held, share = drawn, per_pass * k / cost

        def some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                take = np.flatnonzero(b.column(1).to_numpy() < _nearest(_matrix(b.column(0)), held)[1] * share) if b.num_rows else []
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64()))], ["v"])

        rows = vectors.where(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("v"), chance.alias("chance"))
        drawn = np.unique(np.vstack([drawn, *[np.array(r["v"])[None] for r in rows.mapInArrow(some, "v array<double>").collect()]]), axis=0)
    if not len(drawn):
        return drawn
    weight = _sums(vectors, column, drawn)[0].astype(float)
    draw = np.random.default_rng(seed)
    chosen = [int(weight.argmax())]
    while len(chosen) < min(k, len(drawn)):
        far = _nearest(drawn, drawn[chosen])[1] * weight
        left = far if far.sum() else np.where(np.isin(np.arange(len(drawn)), chosen), 0.0, 1.0)
        chosen.append(int(draw.choice(len(drawn), p=left / left.sum())))
    centres = drawn[chosen]
    for _ in range(10):
        at, _ = _nearest(drawn, centres)
        for c in range(len(centres)):
            if weight[at == c].sum():
                centres[c] = np.average(drawn[at == c], axis=0, weights=weight[at == c])
    return centres


def clusters(vectors: DataFrame, id_col: str, column: str = "embedding", k: int = 10, rounds: int = 10, seeds: Callable[[DataFrame, str, str, int], np.ndarray] = first_rows) -> DataFrame:
    """``vectors`` with ``cluster`` after ``rounds`` of Lloyd's iteration, from ``seeds`` (``first_rows`` or ``spread_rows``).

    Of centres at the same distance the first counts; a centre without members stays
    where it is; null vectors have a null cluster. A round looks at each row once and exchanges a row per task and centre.
    """
    centres = seeds(vectors, id_col, column, k)
    if not len(centres):
        return vectors.withColumn("cluster", F.lit(None).cast("int"))
    for _ in range(rounds):
        n, total, _ = _sums(vectors, column, centres)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)

    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        out = np.zeros(len(v), np.int32)
        there = ~v.is_null().to_numpy(zero_copy_only=False)
        out[there] = _nearest(_matrix(v.drop_null()), centres)[0]
        return pa.array(out, pa.int32(), mask=~there)

    return vectors.withColumn("cluster", nearest(F.col(column)))


def cost(vectors: DataFrame, centres: np.ndarray, column: str = "embedding") -> float:
    """Sum of squared distances from the nearest of ``centres``."""
    return _sums(vectors, column, centres)[2]
