"""Mixing sources to target weights, built-in functions only.

Sizes are summed per source (a hot source is one row per task), targets follow by
water-filling over the summed table, and each document gets floor(rate) copies and
one more if a hash of its id, read as a number in [0, 1), is below the fraction.

Where a source has few documents one draw can miss its target by far. So ``DRAWS``
seeds are tried: one aggregation sums what each would take of every source, and each
source uses the seed that comes nearest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: Seeds that are tried for each source.
DRAWS = 16
#: Sources up to which the target table is broadcast; beyond, Spark joins by key.
BROADCAST_SOURCES = 10_000


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """``source, source_size, target`` for a table of ``source, size``.

    Sources in code point order, null last, get ``weights`` in turn and divide
    ``share`` of all sizes by weight. A target stops at ``most`` times the source's
    size and its excess is divided again; the end of that process is the level L
    with sum(min(most * size, L * weight)) = share, which one ordered pass finds.
    Runs over one row per source, never over documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    named = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(named) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = by_source.select("source", "source_size", weight.alias("_w"), (F.lit(most) * F.col("source_size")).alias("_cap"))

    full = W.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = full.rowsBetween(W.unboundedPreceding, -1)
    onward = full.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = full.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.lit(share) * F.sum("source_size").over(whole)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    return (
        ranked.withColumn("_level", level)
        .withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
        .withColumn("_level", F.first(F.when(F.col("_fits"), F.col("_level")), ignorenulls=True).over(whole))
        # no level fits only if the share can't be placed at all: every source is then full
        .select("source", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))
    )


def uniform(key: Column, draw: Column | int = 0, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on ``key``, ``draw`` and ``seed`` alone; an MD5 digest serves four draws."""
    draw = draw if isinstance(draw, Column) else F.lit(draw)
    name = F.concat(F.lit(f"{seed}-"), F.floor(draw / 4).cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit("null")))
    digits = F.substring(F.md5(name.cast("binary")), (draw % 4 * 8 + 1).cast("int"), F.lit(8))
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def _copies(key: Column, rate: Column, draw: Column | int, seed: str) -> Column:
    return F.floor(rate).cast("long") + (uniform(key, draw, seed) < rate - F.floor(rate)).cast("long")


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
    draws: int = DRAWS,
) -> tuple[DataFrame, DataFrame]:
    """(sizes, sources), both settled: ``_id, _source, size`` per row, and per source its ``source_size, target, rate, draw``.

    ``draw`` is the seed whose copies come nearest to the target, the first of several.
    Texts are read and words counted once.
    """
    sized = settle(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words(F.col(text_col)).alias("size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = settle(source_targets(sized.select(F.col("_source").alias("source"), "size"), weights, share, most).withColumn("rate", rate))
    taken = [F.sum(F.col("size") * _copies(F.col("_id"), F.col("rate"), k, seed)).alias(f"_{k}") for k in range(draws)]
    tried = joined(sized, F.col("_source"), targets).groupBy("source").agg(F.first("target").alias("_target"), *taken)
    misses = [F.struct(F.abs(F.col(f"_{k}") - F.col("_target")).alias("miss"), F.lit(k).alias("draw")) for k in range(draws)]
    best = tried.select(F.col("source").alias("_best"), F.array_min(F.array(*misses))["draw"].alias("draw"))
    return sized, settle(targets.join(best, F.col("source").eqNullSafe(F.col("_best"))).drop("_best"))


def joined(rows: DataFrame, source: Column, sources: DataFrame) -> DataFrame:
    """``rows`` beside their source's row; sources are broadcast up to a number that is counted."""
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(sources) if few else sources, source.eqNullSafe(F.col("source")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **options) -> DataFrame:
    """One row per input row: id, ``size, source_size, target, copies, taken``.

    ``size`` is the word count (null text: 0) and ``taken`` is size times copies.
    Rows that repeat an id draw the same number; a null id draws one too. A null
    source is a source of its own. An empty table gives no rows. Other columns are ignored.
    """
    sized, sources = plan(docs, id_col, text_col, source_col, seed=seed, **options)
    return (
        joined(sized, F.col("_source"), sources)
        .withColumn("copies", _copies(F.col("_id"), F.col("rate"), F.col("draw"), seed))
        .select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **options) -> DataFrame:
    """``docs`` with each row written ``copies`` times, as ``mix`` gives them, every column as it was.

    Rows that get none are gone, so null texts may go like any other; rows that repeat an
    id are written equally often. An empty table gives no rows. Column names may clash
    with any that are used here, as rows travel whole.
    """
    _, sources = plan(docs, id_col, text_col, source_col, seed=seed, **options)
    row = F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns])
    rows = docs.select(docs[id_col].alias("_id"), docs[source_col].alias("_source"), row.alias("_row"))
    copies = _copies(F.col("_id"), F.col("rate"), F.col("draw"), seed)
    return (
        joined(rows, F.col("_source"), sources).withColumn("copies", copies).where("copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("_row.*")
    )
