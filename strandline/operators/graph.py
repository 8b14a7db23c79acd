"""Connected components of edge tables by contraction and pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import settle

#: A round leaves about half of the nodes that still have an edge.
MOST_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """``f, node, root`` of every node of ``edges`` (``f, u, v``): the smallest node that links reach within ``f``.

    A round points every node to that neighbour, or itself, whose hash is smallest; pointers
    are doubled until they end, and the ends take the place of their nodes in the edges.
    Hashes change from round to round, so no numbering of nodes makes rounds many: their
    number grows with the logarithm of the number of nodes. Every table of a round is
    written, so lineage doesn't grow and a lost executor costs only what it was at.
    """
    left = settle(edges.where("u != v").select("f", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    ends = edges.select("f", F.explode(F.array("u", "v")).alias("node")).distinct()
    named = settle(ends.withColumn("end", F.col("node")))
    for k in range(MOST_ROUNDS):
        if left.isEmpty():
            roots = named.groupBy("f", "end").agg(F.min("node").alias("root"))
            return named.join(roots, ["f", "end"]).select("f", "node", "root")
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("node"))
        both = left.select("f", "u", "v").unionAll(left.select("f", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("f", "u").agg(F.min(rank("v")).alias("m")).select("f", "u", F.least(rank("u"), F.col("m"))["node"].alias("p"))
        points = settle(least)
        while True:
            onward = points.select("f", F.col("u").alias("p"), F.col("p").alias("q"))
            jumped = settle(points.join(onward, ["f", "p"]).select("f", "u", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), replaces=points)
            points = jumped
            if jumped.where("moved").isEmpty():
                break
        to = points.select("f", F.col("u").alias("end"), "p")
        named = settle(named.join(to, ["f", "end"], "left").select("f", "node", F.coalesce("p", "end").alias("end")), replaces=named)
        a = left.join(points.select("f", "u", F.col("p").alias("a")), ["f", "u"])
        b = a.join(points.select("f", F.col("u").alias("v"), F.col("p").alias("b")), ["f", "v"])
        left = settle(b.where("a != b").select("f", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), replaces=left)
    raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
