"""Line dedup of repeated passages, built-in functions only.

The rolling hash covers two neighbouring line hashes. A boundary by a divisor of that
hash loses every passage that lies inside a chunk or across one (at a divisor of two half
of all repeated lines in passages of two lines or more), so here every place is a boundary:
each window of two lines is filed under the SHA-256 of its bytes. Windows that stand
earlier in the table (smallest id, then place) are removed and windows that touch are one
chunk, so every run of two lines or more that repeats goes, wherever it begins and
whatever stands around it. Only digests and places are exchanged to find them, never
bytes; the texts move once, when they are cut. The join can be split where one passage
holds most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def repeated_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, mark, at``: every two neighbouring lines that stand earlier; ``mark`` is the text's hash.

    Two lines that share a line with the place where they are first (three equal lines)
    are left, so that the first place stays whole.
    """

    def pairs(ls: Column) -> Column:
        return F.transform(F.slice(ls, F.lit(1), F.size(ls) - 1), lambda x, i: F.struct(
            i.alias("at"), F.unhex(F.sha2(F.concat(x, F.lit("\n"), F.get(ls, i + 1)), 256)).alias("key"),
        ))

    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.explode(_let(F.split(text, "\n"), pairs)).alias("p"),
    ).select("id", "mark", "p.at", "p.key")
    # where they are first: rows without an id come last
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("mark").alias("mark"), F.col("at").alias("at"))
    firsts = rows.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("_n")).where("_n > 1")
    # a key of its own: the sums are dealt by key, and joining on that Spark could not split a hot passage
    anew = F.concat(F.col("key"), F.lit(b"="))
    found = rows.withColumn("k", anew).join(firsts.select(anew.alias("k"), "first"), "k")
    ours = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")) & (F.col("at") < F.col("first.at") + 2)
    return found.where(~ours).select("id", "mark", "at")


def drop_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", clean_col: str = "clean_text") -> DataFrame:
    """``id_col``, ``clean_col``, ``n_lines, n_removed_lines, n_removed_chunks`` of every row.

    A line goes if it and a neighbour stand earlier; of every line at least one copy
    stays. A removed chunk is a run of removed lines. The empty and the null text are one
    empty line and lose nothing. A text whose every line is removed becomes empty. Rows
    that repeat an id and a text are cut alike, other texts of the id by themselves. Rows
    without an id are compared but not cut. An empty table gives no rows.
    """
    gone = (
        repeated_pairs(docs, id_col, text_col).where("id is not null")
        .groupBy("id", "mark").agg(F.array_sort(F.collect_set("at")).alias("_gone")).withColumnsRenamed({"id": "_gone_id", "mark": "_gone_mark"})
    )
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_mark"))
    held, lines = F.coalesce(F.col("_gone"), F.array().cast("array<int>")), F.split("_text", "\n")
    # pairs that touch are one run of lines
    starts = F.filter(held, lambda x, k: (k == 0) | (x - F.get(held, k - 1) > 2))
    stops = F.transform(F.filter(held, lambda x, k: (k == F.size(held) - 1) | (F.get(held, k + 1) - x > 2)), lambda x: x + 2)
    cut = (
        rows.join(gone, (F.col("_id") == F.col("_gone_id")) & (F.col("_mark") == F.col("_gone_mark")), "left")
        .select("_id", "_text", F.size(lines).alias("_n"), starts.alias("_starts"), stops.alias("_stops"))
    )
    # what stands before each run, and after the last
    froms, tos = F.concat(F.array(F.lit(0)), "_stops"), F.concat("_starts", F.array("_n"))

    def rest(ls: Column) -> Column:
        return F.array_join(F.flatten(F.zip_with(froms, tos, lambda a, b: F.slice(ls, a + 1, b - a))), "\n")

    return cut.select(
        F.col("_id").alias(id_col),
        F.when(F.size("_starts") == 0, F.col("_text")).otherwise(_let(lines, rest)).alias(clean_col),
        F.col("_n").cast("long").alias("n_lines"),
        F.aggregate(F.zip_with("_stops", "_starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, n: s + n).alias("n_removed_lines"),
        F.size("_starts").cast("long").alias("n_removed_chunks"),
    )
