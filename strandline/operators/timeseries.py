"""Ordered operators on series: numbering, gap filling, smoothing, jitter.

Series are told apart by key columns and ordered by others. All windows of a chain share
one partitioning, so a chain is one exchange; gap filling sorts twice, once in either order,
and what follows needs no other sort. All operators are linear in a series. A series that
outgrows a task is cut with ``chunk_rows``: smoothing then works on chunks with a margin
of neighbouring rows, and gap filling carries the nearest valid value over chunks from
one summary row per chunk; both give the same values as the plain form.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import all_present, present, trusted

MEDIAN_WINDOW = 9
SIGMA = 2.0
TRUNCATE = 4.0
#: Largest radius that is written out as lags and leads; beyond, rows gather their window in an array.
UNROLLED_RADIUS = 64


def number_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], out: str = "frame_idx") -> DataFrame:
    """Position of each row in its series, from 0."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn(out, (F.row_number().over(w) - 1).cast("long"))


def number_long(df: DataFrame, key: Sequence[str], index: str, piece_rows: int, out: str) -> DataFrame:
    """``number_rows`` by a numeric index for series that outgrow a task: rows are numbered within pieces of so many
    positions, after all rows of the pieces before. ``df`` is read twice."""
    rows = _pieces(df, key, index, piece_rows)
    line = W.partitionBy(*[f"_piece.k{k}" for k in range(len(key))]).orderBy("_piece.chunk")
    counts = rows.groupBy("_piece").agg(F.count("*").alias("_n"))
    before = counts.select("_piece", F.coalesce(F.sum("_n").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_rows_before"))
    place = F.row_number().over(W.partitionBy("_piece").orderBy(index)) - 1
    return _told(rows.withColumn(out, place), before).withColumn(out, (F.col(out) + F.col("_rows_before")).cast("long")).drop("_piece", "_rows_before")


def _lerp(i: Column, before: Column, after: Column, c: str) -> Column:
    slope = (after[c] - before[c]) / (after["i"] - before["i"])
    return (
        F.when(before.isNull(), after[c]).when(after.isNull(), before[c])
        .when(before["i"] == after["i"], before[c]).otherwise(slope * (i - before["i"]) + before[c])
    )


def _latest(c: str, order, back: int = 0) -> Column:
    """The last value that isn't null up to ``back`` rows before the present one.

    Spark keeps it as it goes, in either order; a frame that looks ahead to the end would
    be computed anew for each row, which is quadratic in the length of a series.
    """
    return F.last(c, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -back))


def _pieces(df: DataFrame, key: Sequence[str], index: str, rows: int) -> DataFrame:
    """``_piece``: the series of each row (``k0``, ...) and which stretch of ``rows`` positions it is in (``chunk``).

    One column rather than several, so that series without a name meet in joins too.
    """
    return df.withColumn("_piece", F.struct(*[F.col(k).alias(f"k{n}") for n, k in enumerate(key)], F.floor(F.col(index) / rows).cast("long").alias("chunk")))


def _told(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """``rows`` beside what the one row of their ``_piece`` in ``summary`` says.

    Rows are always dealt out by piece: were they broadcast, where a table seems small, all
    of them would meet the summary in the one task that made it.
    """
    return rows.join(summary.hint("shuffle_hash"), "_piece", "left")


def fill_gaps(
    df: DataFrame,
    key: Sequence[str],
    index: str,
    values: Sequence[str],
    valid: Column | None = None,
    flag: str = "is_interpolated",
    on_empty: str = "null",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Linear interpolation of ``values`` over rows that aren't valid, flat at both ends.

    A row is valid as a whole: by default if none of its values is missing. ``flag`` tells
    which rows were filled. A series without a valid row stays null, or fails the job with
    ``on_empty="raise"``. ``index`` is the numeric position that is interpolated along.
    """
    ok = all_present([F.col(v) for v in values]) & (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False)))
    known = F.when(ok, F.struct(F.col(index).alias("i"), *[F.col(v).cast("double").alias(v) for v in values]))
    rows = df.withColumn("_known", known)
    if chunk_rows:
        rows = _pieces(rows, key, index, chunk_rows)
        i, x = F.when(ok, F.col(index)), lambda v: F.col(v).cast("double")
        # column by column, as an aggregate of structs would sort all rows
        ends = rows.groupBy("_piece").agg(
            F.max(i).alias("_last_i"), *[F.max_by(x(v), i).alias(f"_last_{k}") for k, v in enumerate(values)],
            F.min(i).alias("_first_i"), *[F.min_by(x(v), i).alias(f"_first_{k}") for k, v in enumerate(values)],
        )
        end = lambda at: F.when(F.col(f"{at}_i").isNotNull(), F.struct(F.col(f"{at}_i").alias("i"), *[F.col(f"{at}_{k}").alias(v) for k, v in enumerate(values)]))
        line, chunk = W.partitionBy(*[f"_piece.k{k}" for k in range(len(key))]), F.col("_piece.chunk")
        carried = ends.select("_piece", end("_last").alias("_last"), end("_first").alias("_first")).select(
            "_piece",
            _latest("_last", line.orderBy(chunk), 1).alias("_carry_before"),
            _latest("_first", line.orderBy(chunk.desc()), 1).alias("_carry_after"),
        )
    by = ["_piece"] if chunk_rows else key
    # the later neighbour first, so that what follows finds the rows in ascending order
    after = _latest("_known", W.partitionBy(*by).orderBy(F.col(index).desc()))
    before = _latest("_known", W.partitionBy(*by).orderBy(index))
    placed = rows.withColumn("_after", after).withColumn("_before", before)
    if chunk_rows:
        # told last, so that what is sorted stays narrow
        placed = _told(placed, carried).withColumns({c: F.coalesce(c, f"_carry{c}") for c in ("_before", "_after")})
    filled = {v: _lerp(F.col(index), F.col("_before"), F.col("_after"), v) for v in values}
    if on_empty == "raise":
        none = F.col("_before").isNull() & F.col("_after").isNull()
        message = F.concat(F.lit("no valid row in series "), F.to_json(F.struct(*key)))
        filled = {v: F.when(none, F.raise_error(message).cast("double")).otherwise(c) for v, c in filled.items()}
    return placed.withColumns({**filled, flag: F.col("_known").isNull()}).drop("_known", "_before", "_after", "_piece", "_carry_before", "_carry_after")


def fill_pose(df: DataFrame, key: Sequence[str], index: str, threshold: float = 0.9, flag: str = "is_interpolated", **options) -> DataFrame:
    """Fill keypoints where tail or neck is less likely than the threshold.

    A likely row whose coordinates are missing counts as invalid, so it can't spread.
    """
    valid = trusted([F.col("tail_likelihood"), F.col("neck_likelihood")], threshold)
    return fill_gaps(df, key, index, ["tail_x", "tail_y", "neck_x", "neck_y"], valid, flag, **options)


def _in_chunks(df: DataFrame, key: Sequence[str], index: str, margin: int, chunk_rows: int) -> tuple[DataFrame, list[str], Column]:
    """Rows filed under every chunk that needs them, the new key, and which copies to keep."""
    at = lambda shift: F.floor((F.col(index) + shift) / chunk_rows).cast("long")
    near = F.sequence(F.greatest(at(-margin), F.lit(0).cast("long")), at(margin))
    rows = df.withColumn("_chunk", F.explode(near))
    return rows, [*key, "_chunk"], F.col("_chunk") == at(0)


def rolling_median(
    df: DataFrame, key: Sequence[str], index: str, values: Sequence[str], window: int = MEDIAN_WINDOW, suffix: str = "", chunk_rows: int | None = None,
    piece_rows: int | None = None,
) -> DataFrame:
    """Centred rolling median; the window is cut at the ends, an even one reaches one row further back.

    ``chunk_rows`` needs ``index`` to count rows from 0. Windows of more than WIDE rows slide
    over chunks in any case, in time that grows with the logarithm of the window. ``piece_rows``
    takes any numeric index: a series that outgrows a task is numbered by pieces of so many
    positions, and then chunked.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    back, ahead = window // 2, (window - 1) // 2
    if piece_rows:
        numbered = number_long(df, key, index, piece_rows, "_place")
        return rolling_median(numbered, key, "_place", values, window, suffix, chunk_rows or max(CHUNK_ROWS, CHUNK_WINDOWS * window)).drop("_place")
    if window > WIDE:
        return _wide_median(df, key, index, values, back, ahead, suffix, chunk_rows)
    rows, keep = df, None
    if chunk_rows:
        rows, key, keep = _in_chunks(df, key, index, back, chunk_rows)
    w = W.partitionBy(*key).orderBy(index).rowsBetween(-back, ahead)
    out = rows.withColumns({f"{v}{suffix}": F.percentile(F.col(v), F.lit(0.5)).over(w) for v in values})
    return out if keep is None else out.where(keep).drop("_chunk")


#: Largest window whose median is found anew for each row, and rows of a chunk in windows, for wider ones.
WIDE, CHUNK_WINDOWS, CHUNK_ROWS = 64, 8, 16_384


def _wide_median(df: DataFrame, key: Sequence[str], index: str, values: Sequence[str], back: int, ahead: int, suffix: str, chunk_rows: int | None) -> DataFrame:
    """Medians of chunks with margins; each chunk is one group of bounded size."""
    numbered = df.withColumn("_at", F.col(index)) if chunk_rows else number_rows(df, key, [index], "_at")
    rows, by, keep = _in_chunks(numbered, key, "_at", back, chunk_rows or max(CHUNK_ROWS, CHUNK_WINDOWS * (back + ahead + 1)))
    names = [f"{v}{suffix}" for v in values]
    schema = rows.withColumns({n: F.col(v).cast("double") for n, v in zip(names, values)}).schema
    kinds = {f.name: f.dataType.simpleString() for f in schema}

    def slide(own: pa.Table) -> pa.Table:
        own = own.sort_by("_at")
        at = own["_at"].to_numpy()
        for name, value in zip(names, values):
            found = sliding_medians(own[value].to_numpy(zero_copy_only=False).astype(float), own[value].is_null().to_numpy(zero_copy_only=False), at, back, ahead)
            # infinite medians stand for NaN, and no median for null
            column = pa.array(np.where(np.isinf(found) & (found > 0), np.nan, found), pa.float64(), mask=np.isnan(found))
            own = own.set_column(own.column_names.index(name), name, column) if name in own.column_names else own.append_column(name, column)
        return own.select(list(kinds))

    return rows.groupBy(*by).applyInArrow(slide, schema).where(keep).drop("_chunk", "_at")


class Sliding:
    """The median of a multiset that gains and loses members: two heaps, whose dead members are thrown out when they come up.

    ``low`` holds the smaller half, negated, and one member more where the number is odd.
    """

    def __init__(self):
        self.low: list[tuple[float, int]] = []
        self.high: list[tuple[float, int]] = []
        self.below: dict[int, bool] = {}  # whether a live member is in the lower half
        self.n_low = self.n_high = 0

    def add(self, value: float, name: int) -> None:
        if self.n_low and value > -self._top(self.low)[0]:
            heappush(self.high, (value, name))
            self.below[name] = False
            self.n_high += 1
        else:
            heappush(self.low, (-value, name))
            self.below[name] = True
            self.n_low += 1
        self._balance()

    def remove(self, name: int) -> None:
        if self.below.pop(name):
            self.n_low -= 1
        else:
            self.n_high -= 1
        self._balance()

    def median(self) -> float:
        if not self.n_low:
            return math.nan
        least = -self._top(self.low)[0]
        return least if self.n_low > self.n_high else (least + self._top(self.high)[0]) / 2

    def _top(self, heap: list[tuple[float, int]]) -> tuple[float, int]:
        lower = heap is self.low
        while self.below.get(heap[0][1]) is not lower:
            heappop(heap)
        return heap[0]

    def _balance(self) -> None:
        while self.n_low > self.n_high + 1:
            value, name = self._top(self.low)
            heappop(self.low)
            heappush(self.high, (-value, name))
            self.below[name] = False
            self.n_low, self.n_high = self.n_low - 1, self.n_high + 1
        while self.n_high > self.n_low:
            value, name = self._top(self.high)
            heappop(self.high)
            heappush(self.low, (-value, name))
            self.below[name] = True
            self.n_low, self.n_high = self.n_low + 1, self.n_high - 1


def sliding_medians(x: np.ndarray, missing: np.ndarray, at: np.ndarray, back: int, ahead: int) -> np.ndarray:
    """Median of what isn't missing from ``back`` rows before each row to ``ahead`` rows after; NaN where nothing is.

    ``at`` are the rows' places in their series, in order; NaN counts, and comes out, as infinity.
    """
    held, out, first, last = Sliding(), np.empty(len(x)), 0, 0
    value = np.where(np.isnan(x), np.inf, x).tolist()
    skip, place = missing.tolist(), at.tolist()
    for k, here in enumerate(place):
        while last < len(place) and place[last] <= here + ahead:
            if not skip[last]:
                held.add(value[last], last)
            last += 1
        while place[first] < here - back:
            if not skip[first]:
                held.remove(first)
            first += 1
        out[k] = held.median()
    return out


def gaussian_weights(sigma: float, truncate: float = TRUNCATE) -> list[float]:
    """Normalised weights of taps -r to r; one tap as sigma goes to 0."""
    if sigma < 0:
        raise ValueError("sigma must not be negative")
    radius = int(truncate * sigma + 0.5)
    if not radius:
        return [1.0]
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def gaussian_smooth(
    df: DataFrame, key: Sequence[str], index: str, values: Sequence[str], sigma: float = SIGMA, suffix: str = "", chunk_rows: int | None = None,
) -> DataFrame:
    """Gaussian filter along the series; beyond its ends the first and last values continue.

    Values must be filled. ``chunk_rows`` needs ``index`` to count rows from 0.
    """
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    rows, keep = df, None
    if chunk_rows:
        rows, key, keep = _in_chunks(df, key, index, radius, chunk_rows)
    line = W.partitionBy(*key).orderBy(index)
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    def unrolled(v: str) -> Column:
        first, last = F.first(v).over(whole), F.last(v).over(whole)
        out = F.lit(0.0)
        for k, w in enumerate(weights, -radius):
            tap = F.col(v) if not k else F.coalesce(F.lag(v, -k).over(line), first) if k < 0 else F.coalesce(F.lead(v, k).over(line), last)
            out = out + F.lit(w) * tap
        return out

    def gathered(v: str) -> Column:
        back = F.collect_list(v).over(line.rowsBetween(-radius, -1))
        ahead = F.collect_list(v).over(line.rowsBetween(0, radius))
        first, last = F.first(v).over(whole), F.last(v).over(whole)
        lead = F.array_repeat(first, radius - F.size(back))
        trail = F.array_repeat(last, radius + 1 - F.size(ahead))
        taps = F.zip_with(F.concat(lead, back, ahead, trail), F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w)
        return F.aggregate(taps, F.lit(0.0), lambda s, x: s + x)

    form = unrolled if radius <= UNROLLED_RADIUS else gathered
    out = rows.withColumns({f"{v}{suffix}": form(v) for v in values})
    return out if keep is None else out.where(keep).drop("_chunk")


def smooth(df: DataFrame, key: Sequence[str], index: str, values: Sequence[str], window: int | None = None, sigma: float | None = None, **options) -> DataFrame:
    """The median if a window is given, else the Gaussian filter with sigma or its default."""
    if window is not None and sigma is not None:
        raise ValueError("window and sigma are mutually exclusive")
    if window is not None:
        return rolling_median(df, key, index, values, window, **options)
    return gaussian_smooth(df, key, index, values, SIGMA if sigma is None else sigma, **options)


def jitter(df: DataFrame, key: Sequence[str], index: str, x: str, y: str) -> DataFrame:
    """Mean and largest move from row to row, per series; null for one row."""
    w = W.partitionBy(*key).orderBy(index)
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return df.withColumn("_step", step).groupBy(*key).agg(F.avg("_step").alias("mean_step"), F.max("_step").alias("max_step"))


def uniform_subsample(df: DataFrame, index: str, every: int, offset: int = 0) -> DataFrame:
    return df.where((F.col(index) - offset) % every == 0)


def changed_subsample(df: DataFrame, key: Sequence[str], index: str, values: Sequence[str], least: float) -> DataFrame:
    """Rows that differ from the one before by ``least`` or more (Euclidean over ``values``), and the first of each series.

    A row next to a missing value has no distance and isn't kept unless it is the first.
    """
    w = W.partitionBy(*key).orderBy(index)
    apart = F.sqrt(sum((F.pow(F.col(v) - F.lag(v).over(w), F.lit(2.0)) for v in values), F.lit(0.0)))
    rows = df.withColumns({"_apart": apart, "_first": F.row_number().over(w) == 1})
    return rows.where(F.col("_first") | (F.col("_apart") >= least)).drop("_apart", "_first")


def change_weight(df: DataFrame, key: Sequence[str], index: str, values: Sequence[str], least: float = 1.0, out: str = "weight") -> DataFrame:
    """``out``: how far a row is from the one before (Euclidean over ``values``) and ``least`` more; ``least`` where there is no distance."""
    w = W.partitionBy(*key).orderBy(index)
    apart = F.sqrt(sum((F.pow(F.col(v) - F.lag(v).over(w), F.lit(2.0)) for v in values), F.lit(0.0)))
    return df.withColumn(out, F.coalesce(present(apart), F.lit(0.0)) + F.lit(least))


#: Rows that a task holds before it hands on what it has.
MOST_HELD = 200_000


def weighted_subsample(df: DataFrame, key: Sequence[str], index: str, weight: str, k: int, seed: int = 0, most_held: int = MOST_HELD) -> DataFrame:
    """``k`` rows of each series, drawn without replacement with chances in proportion to ``weight``.

    Every row draws an exponential number of rate ``weight`` from a hash of seed, series and
    index; the smallest win, so draws don't depend on order or partitions and a rerun draws the
    same. Each task keeps the ``k`` best of every series it meets and only those are
    exchanged; no series is sorted. Rows of no weight, or of none above 0, are never drawn.
    """
    name = F.concat_ws(":", F.lit(f"draw-{seed}"), *[F.col(c).cast("string") for c in [*key, index]])
    # 48 bits of a digest, in the middle of their step so that it is neither 0 nor 1
    even = (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / float(1 << 48)
    drawn = df.where(F.col(weight) > 0).withColumn("_draw", -F.ln(even) / F.col(weight))
    by = [*key, "_draw", index]

    def smallest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            new = pa.Table.from_batches([b])
            held = new if held is None else pa.concat_tables([held, new])
            order = held.select(by).to_pandas().reset_index(names="_row").sort_values(["_draw", index])
            kept = order.groupby(list(key), sort=False, dropna=False).head(k)["_row"].to_numpy()
            held = held.take(pa.array(np.sort(kept))).combine_chunks()
            if held.num_rows > most_held:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    line = W.partitionBy(*key).orderBy("_draw", index)
    best = drawn.mapInArrow(smallest, drawn.schema).withColumn("_place", F.row_number().over(line)).where(F.col("_place") <= k)
    return best.drop("_draw", "_place")


def either(*flags: Column) -> Column:
    """True where any flag is; a missing one doesn't count."""
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags])


def at_positions(rows: DataFrame, other: DataFrame, key: Sequence[str], index: str, how: str = "inner") -> DataFrame:
    """``rows`` beside the row of ``other`` that has the same series and position."""
    return rows.join(other, [*key, index], how)


def validity(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """``any_valid`` and ``n_valid`` per series: whether and how many rows have a value."""
    there = all_present([F.col(value)])
    return df.groupBy(*key).agg(F.bool_or(there).alias("any_valid"), F.count(F.when(there, 1)).alias("n_valid"))


def with_mode(rows: DataFrame, posed: DataFrame, key: Sequence[str]) -> DataFrame:
    """``mode`` of every row: "pose" where ``posed`` names its series, else "axis"."""
    named = posed.select(*key).distinct().withColumn("_posed", F.lit(True))
    return rows.join(named, list(key), "left").withColumn("mode", F.when(F.col("_posed"), "pose").otherwise("axis")).drop("_posed")
