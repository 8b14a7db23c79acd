"""Exact dedup by progressive refinement, built-in functions only.

Round 1 groups by length in bytes, round 2 by the hash of a short prefix within
the surviving lengths; round 3 reads and hashes the full content, and only of
rows whose (length, prefix) survived. Every round aggregates before it shuffles,
so a text that holds a third of all rows is one row per task in each shuffle.

The survivors reach the scan of round 3 as a Bloom filter sized by their number and
broadcast within a stated size (``common.Filter``). A row that passes by chance costs a
needless hash and changes no result, as the full digest decides; beyond that size every
text is hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Filter, drop_marked, settle, whole_text

PREFIX_CHARS = 64


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    carry: dict[str, Column] | None = None,
    most_bytes: int | None = None,
) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, digest`` and ``carry``.

    Texts are equal when they are identical; null counts as the empty text, so
    null and empty rows form one group. The row with the largest id stays. Rows
    that repeat an id and a text all count in ``group_size`` and, if theirs is the
    largest id, are all marked kept. A null id loses to any other; a group of null
    ids only has a null ``keep_id`` and is kept. An empty table gives no rows.
    ``digest`` is the SHA-256 of texts that were read in full, and of every text in a
    group of two or more; null where length or prefix were enough. Other columns of
    ``docs`` are ignored whatever their names; ``carry`` adds expressions over ``docs``
    to the result. ``most_bytes`` bounds the filter of survivors.
    """
    text = whole_text(text_col)
    carry = carry or {}
    rows = docs.select(
        F.col(id_col).alias("_id"),
        text.alias("_text"),
        F.octet_length(text).alias("_length"),
        *[c.alias(name) for name, c in carry.items()],
    )
    prefix = F.xxhash64(F.substring("_text", 1, prefix_chars))

    lengths = rows.groupBy("_length").agg(F.count("*").alias("_n")).where("_n > 1").select("_length")
    survivors = settle(
        rows.groupBy("_length", prefix.alias("_prefix")).agg(F.count("*").alias("_n")).where("_n > 1")
        .join(lengths, "_length", "left_semi").select("_length", "_prefix")
    )
    known = Filter.of(survivors, F.xxhash64("_length", "_prefix"), most_bytes)
    tested, read = known.test(rows, F.xxhash64("_length", prefix)) if known else (rows, F.lit(True))
    # a row that no longer has a rival needs a key of its own
    hashed = tested.select("_id", F.when(read, F.sha2("_text", 256)).alias("_digest"), *carry)
    groups = (
        hashed.where("_digest is not null").groupBy("_digest")
        .agg(F.max("_id").alias("_keep"), F.count("*").alias("_n")).where("_n > 1")
        # a key of its own: the sums are dealt by _digest, and joining on that Spark could not split a hot text
        .select(F.concat(F.lit("="), "_digest").alias("_key"), "_keep", "_n")
    )
    alone = F.concat(F.lit("#"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    return (
        hashed.withColumn("_key", F.coalesce(F.concat(F.lit("="), "_digest"), alone))
        .join(groups, "_key", "left")
        .select(
            F.col("_id").alias(id_col),
            F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
            F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
            F.when(F.col("_n").isNull(), F.lit(True)).otherwise(F.col("_id").eqNullSafe(F.col("_keep"))).alias("kept"),
            F.col("_digest").alias("digest"),
            *carry,
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every text: the one with the largest id.

    Rows go by id and digest, so an id with two texts loses only the text that another
    row keeps. Of rows that repeat both the id and the text one stays, the first that
    Spark meets if other columns differ. Nulls in the id compare as equal: of equal
    texts whose ids are all null one stays.
    """
    digest = F.sha2(whole_text(text_col), 256)
    copies = (
        exact_groups(docs, id_col, text_col).where("group_size > 1")
        .groupBy(F.col(id_col).alias("_copy"), F.col("digest").alias("_sha")).agg(F.max("kept").alias("_stays"), F.count("*").alias("_n"))
    )
    return drop_marked(docs, docs[id_col], digest, settle(copies.where("not _stays or _n > 1")))
