"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept: toxic
documents go, exact copies go, one document of each near-duplicate group stays, sources
are mixed to their target weights, and what is left is encoded and decoded.

All stages take nulls in any column, empty and very long texts, repeated rows, empty
tables and columns of any other name; each says what comes of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import bpe, exact_dedup, mixing, simhash, toxicity
from strandline.llm.common import checkpoint_dir, cleaned, table
from strandline.llm.queries import vocabulary
from strandline.plans.storage import delete


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without what scores as toxic by a model learned from the labels of rows that aren't held out.

    Null and empty texts stay, repeated rows go or stay alike; without labelled rows in
    ``docs`` nothing goes.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one row of every text, the one with the largest id; null counts as empty.

    Of rows that repeat id and text one stays, whichever Spark meets first.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one row of each group of near copies, one with the smallest id.

    Near are texts whose 256-bit fingerprints of five-word shingles say a similarity of 0.8
    or more, and what is linked through such. Null and empty texts are copies of each other;
    rows without an id stay.
    """
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with each row as often as its source's target asks; some go, some stand twice.

    Null texts have no words, so their rows count for nothing and are written like others;
    a null source is a source of its own.
    """
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every row; null and empty texts have no ids."""
    return bpe.digest_table(docs, *vocabulary(), ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The learned stage and the fingerprints have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; each result is written as Parquet in the shared folder and read again.

    What a stage settles on its way, and what it was given by the one before, are deleted
    once its result is written; the last result stays.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with cleaned(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
