"""The registered queries: each applies one operator to its whole table.

Other columns are ignored whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, lexical, licenses, line_dedup, mixing, personal, quality, simhash, token_counts, toxicity, warc, whitening
from .common import checkpoint_dir, table, whole_text

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary() -> tuple[str, str]:
    """Path of the vocabulary and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, which row of its text stays, and the text's digest. Null and empty texts are equal; repeated rows are all returned; a null id loses to any other."""
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.exact_groups(docs, carry={"text_sha256": F.sha2(whole_text("text"), 256)}).drop("digest")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics, the base rule and the verdict of a list learned from the labels. A null text has no words, so the base rule rejects it; without labels that rule alone decides."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words that the mix takes of it. Null texts have size 0; a null source is one of its own; repeated ids draw alike."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids and the digests of its ids and of the decoded bytes. Null and empty texts have none."""
    return bpe.digest_table(table(spark, sf_dir, "documents"), *vocabulary())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id that links reach. Null and empty texts have fingerprint zero and link; rows without an id name no component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and license found, with its containment and first shingle. Null, empty and short texts hold none; rows of one id are found as one."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page, read back from the archives that it was written to. Null html is the empty payload; repeated rows are all written; a null id stays null and is no response that others refer to."""
    folder = f"{checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    return warc.archive_pages(table(spark, sf_dir, "pages"), folder).drop("payload", "uri")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pre-tokens and tokens before and after three edits, and how many pre-tokens the edits encoded. Null counts as empty; rows without an id are not edited."""
    return token_counts.count_edits(table(spark, sf_dir, "documents"), *vocabulary())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, how many are removed in how many runs, and the digest of what is left. Null and empty texts are one line; rows without an id are compared but not cut."""
    cut = line_dedup.drop_repeated_runs(table(spark, sf_dir, "documents"))
    return cut.withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fold, score and prediction, by a model learned from the rows that aren't held out. Null and empty texts score as texts without words; without labels all score near 0."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % toxicity.FOLDS
    return scored.select("doc_id", F.coalesce(fold == toxicity.HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item. Null texts have no terms: such documents aren't found, such items find nothing. Repeated rows are documents, or items, of their own."""
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: base matches by kind and, with those that the method adds, all spans. Null and empty texts have none; repeated rows are all returned."""
    docs = table(spark, sf_dir, "documents")
    return personal.spans_table(docs, personal.fit(docs))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's first eight whitened components. Vectors that are null or hold null or non-finite entries are left out; a null id stays null; repeated rows are all returned."""
    return whitening.components_table(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_exact_dedup, op2_quality_rules, op3_mixing, op4_bpe, op5_simhash,
        op6_licenses, op7_warc, op8_token_counts, op9_line_dedup, op10_toxicity,
        op11_lexical_search, op12_pii, op13_whitening,
    )}
