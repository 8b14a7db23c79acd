"""Connected components of an edge table, distributed and restartable.

Alternates two contractions until the table stops changing: every node hands its
smaller neighbours to the smallest node it sees, then its larger ones. What is left
is one star per component around its smallest node. Each contraction is an
aggregation (min per node, summed per task before the shuffle) and a join back, which
Spark can split at a hub; no node's neighbours are ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, settle

MOST_ROUNDS = 100


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the ``m`` of their ``u``."""
    return edges.withColumn("k", dealt_anew(F.col("u"))).join(least.select(dealt_anew(F.col("u")).alias("k"), "m"), "k")


def _large(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _joined(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _joined(down, least).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge table ``u, v`` of longs.

    ``root`` is the smallest node of the component; roots themselves have no row.
    Loops and repeated edges change nothing; no edges give no rows.
    """
    # smaller neighbours first: spanning links of one group from many keys shrink to about one per node at once
    now = settle(_small(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
    seen = None
    for _ in range(MOST_ROUNDS):
        now = settle(_small(_large(now)), replaces=now)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
    raise RuntimeError("components did not settle")
