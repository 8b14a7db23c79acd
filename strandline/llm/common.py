"""What the operators share: text normalisation, word rules, settled tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import checkpoint_dir, cleaned, settle

__all__ = ["Filter", "checkpoint_dir", "cleaned", "count_characters", "dealt_anew", "drop_marked", "in_small_batches", "n_words", "settle", "table", "whole_text", "words"]

#: A word is a maximal run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def whole_text(column: str | Column = "text") -> Column:
    """The text as it is, null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order. Splitting at one plain character needs no pattern matching."""
    for blank in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def n_words(text: Column) -> Column:
    """Number of words of a text, as long; 0 for null."""
    return F.coalesce(F.size(words(F.coalesce(text, F.lit("")))), F.lit(0)).cast("long")


def count_characters(text: Column, characters: str) -> Column:
    """How often the given ASCII characters occur, together."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


#: Bytes of rows that are handed to Python at once; whole texts make large rows.
BATCH_BYTES = 4 << 20


def in_small_batches(spark: SparkSession) -> None:
    """Have Spark hand rows to Python in batches of BATCH_BYTES, if the session says no less; Spark's own bound is 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_to = int("".join(c for c in spark.conf.get(key, str(64 << 20)) if c.isdigit()) or 0)
    if not 0 < set_to <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_anew(key: Column) -> Column:
    """A key that is equal where ``key`` (long) is, for joining a table back to its own sums.

    The sums of a group-by are already dealt by their key, and a join that reuses that
    has no exchange of its own on that side; Spark then can't split a partition in which
    one key has most rows. On this key both sides are exchanged, and it can.
    """
    return key.bitwiseXOR(F.lit(1))


#: A filter's bits per key and probes per key: about 1.2 % of other keys pass it.
KEY_BITS, PROBES = 10, 4
#: Bits of one block, and of one of the words that it is made of.
BLOCK_BITS, WORD_BITS = 1 << 15, 64
#: Largest filter that is broadcast, in bytes: 54 million keys.
MOST_FILTER_BYTES = 64 << 20


class Filter:
    """A blocked Bloom filter of the keys of a table, sized by their number.

    Built by aggregation, a row of 512 words per 3,276 keys, and broadcast. A key lies in one
    block, so a test is one lookup and up to four bits. ``Filter.of`` gives None where it
    would outgrow ``most_bytes``; the caller then does without, with the same result.
    """

    def __init__(self, table: DataFrame, blocks: int):
        self.table, self.blocks = table, blocks

    @classmethod
    def of(cls, keys: DataFrame, key: Column, most_bytes: int | None = None) -> Filter | None:
        """The filter of ``key`` over ``keys``, a settled table whose keys hardly repeat."""
        blocks = max(1, -(-keys.count() * KEY_BITS // BLOCK_BITS))
        if blocks * BLOCK_BITS // 8 > (MOST_FILTER_BYTES if most_bytes is None else most_bytes):
            return None
        block, probes = cls._places(key, blocks)
        placed = keys.select(block.alias("_block"), F.explode(F.array(*probes)).alias("_at"))
        word = F.floor(F.col("_at") / WORD_BITS).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_at") % WORD_BITS).cast("int"))
        words = placed.groupBy("_block", word.alias("_word")).agg(F.bit_or(bit).alias("_set")).groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_set"))).alias("_set"))
        every = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // WORD_BITS - 1)), lambda k: F.coalesce(F.try_element_at("_set", k), F.lit(0).cast("long")))
        return cls(words.select("_block", every.alias("_bits")), blocks)

    @staticmethod
    def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
        h = F.xxhash64(key)
        return F.pmod(h, F.lit(blocks)), [F.pmod(F.xxhash64(h, F.lit(k)), F.lit(BLOCK_BITS)) for k in range(PROBES)]

    def test(self, rows: DataFrame, key: Column) -> tuple[DataFrame, Column]:
        """``rows`` with the filter's columns beside, and what is false only where no key of the table equals ``key``."""
        block, probes = self._places(key, self.blocks)
        table = F.broadcast(self.table.withColumnsRenamed({c: f"{c}_{uuid.uuid4().hex[:8]}" for c in self.table.columns}))
        at, bits = (table[c] for c in table.columns)
        is_set = [F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")) == 1 for p in probes]
        return rows.join(table, block == at, "left"), reduce(lambda a, b: a & b, is_set, bits.isNotNull())


def drop_marked(docs: DataFrame, key: Column, digest: Column, marks: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """``docs`` without the rows that ``marks`` (settled) names by ``_copy`` (an id) and ``_sha`` (a text's digest).

    Rows that pass a filter of the marked ids, those to go and about 1.2 % of the others,
    are joined; the rest stay where they are. Where the filter would outgrow ``most_bytes``
    all rows are exchanged once, with the same result. Of rows that are marked ``_stays``
    and repeat both id and text the first that Spark meets stays. ``key`` and ``digest``
    are columns of ``docs``; null ids compare as equal.
    """
    names = docs.columns

    def own(rows: DataFrame) -> DataFrame:
        return rows.select(*[docs[f"`{c}`"] for c in names])

    def renamed(m: DataFrame) -> tuple[DataFrame, Column, Column]:
        m = m.select(*[F.col(c).alias(f"{c}_{uuid.uuid4().hex[:8]}") for c in ("_copy", "_sha")])
        return m, key.eqNullSafe(m[m.columns[0]]) & (digest == m[m.columns[1]]), m[m.columns[1]]

    def left(rows: DataFrame) -> DataFrame:
        # an outer join, as Spark would move an anti join below the filter's lookup
        gone, same, sha = renamed(marks)
        return own(rows.join(gone.hint("merge"), same, "left").where(sha.isNull()))

    known = Filter.of(marks, marks["_copy"], most_bytes)
    if known is None:
        rest = left(docs)
    else:
        told, hit = known.test(docs, key)
        rest = own(told.where(~hit)).unionAll(left(told.where(hit)))
    repeated = marks.where("_stays")
    if repeated.isEmpty():
        return rest
    # ids may be null and texts long, so rows are told apart by what they are joined on
    once, same, _ = renamed(repeated)
    ours = docs.join(once, same).select(*[docs[f"`{c}`"] for c in names], *[once[c] for c in once.columns])
    one = ours.toDF(*[f"_{k}" for k in range(len(names))], "id", "sha").dropDuplicates(["id", "sha"]).drop("id", "sha")
    return rest.unionAll(one.toDF(*names))
