"""License scans by MinHash bands over overlapping windows, built-in functions only.

Texts and templates become word shingles. Windows slide over a text by the length of a
template and are three times as long, so a passage up to twice a template's length lies
whole in one. Shingles that no template has can't be contained, so windows are made of
known ones only: a Bloom filter and then a join tell which those are, and of what sizes of
templates. Windows get ``BANDS`` min-hashes, one row per band, and meet a template
wherever one agrees. At the lowest similarity that can matter (0.8 of a template in a
window of three, so 0.8 / 3.2 or more) a band agrees with probability 0.25, so one of 48
does with more than 0.999999. What is met is verified by exact containment of the
template's shingles.

Templates are a table of any number: ``TEMPLATES`` (lines, notices and whole short
licenses), or a folder of license texts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import stem
from .common import Filter, settle
from .license_texts import TEMPLATES

SHINGLE = 5
CONTAINED = 0.8
BANDS = 48
WINDOW = 3

#: Characters that end words, and one that is dropped, before comparing.
BREAKS = "\t\n\x0b\x0c\r,;:!?()[]{}\"'"
DROPPED = "."


def shingles(text: Column) -> Column:
    """Hashes of every run of five words, in order: lower case, without punctuation; fewer words give none."""
    text = F.lower(F.coalesce(text, F.lit("")))
    for c in BREAKS:
        text = F.replace(text, F.lit(c), F.lit(" "))
    text = F.replace(text, F.lit(DROPPED), F.lit(""))
    words = F.array_remove(F.split(text, " "), "")

    def runs(ws: Column) -> Column:
        return F.when(
            F.size(ws) >= SHINGLE,
            F.transform(F.sequence(F.lit(0), F.size(ws) - SHINGLE), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(SHINGLE)])),
        ).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), runs)[0]


def min_hashes(hs: Column, bands: int = BANDS) -> Column:
    """``bands`` min-hashes of an array of hashes, each with its number."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.struct(b.alias("band"), F.array_min(F.transform(hs, lambda h: F.xxhash64(b, h))).alias("least")),
    )


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Templates from a folder of text files, one license each: ``license`` (file name without suffix) and ``words``."""
    files = spark.read.text(folder, wholetext=True)
    return files.select(stem(F.col("_metadata.file_path")).alias("license"), F.col("value").alias("words"))


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] | DataFrame = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
    contained: float = CONTAINED,
    bands: int = BANDS,
) -> DataFrame:
    """One row per document and license found: ``id_col, license, containment, first_shingle``.

    ``templates`` maps names to texts, or is a table of ``license, words``. ``containment`` is
    the largest share of the template's shingles in one window and ``first_shingle`` the
    start of the first window that has it, counted in shingles. Whole texts; null, empty and
    short texts contain nothing. Rows that repeat an id are found as one, and so are rows
    without an id. An empty table gives no rows, and so do no templates. Other columns are
    ignored whatever their names. Templates of fewer than five words are refused.
    """
    if not isinstance(templates, DataFrame):
        templates = docs.sparkSession.createDataFrame(list(templates.items()), "license string, words string")
    kinds = settle(templates.select("license", F.array_distinct(shingles(F.col("words"))).alias("t")).withColumn("size", F.size("t")))
    if short := [r["license"] for r in kinds.where("size = 0").select("license").limit(10).collect()]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    owned = settle(kinds.select("size", F.explode("t").alias("h")).distinct())

    hashed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_row"), shingles(F.col(text_col)).alias("_hs"))
    each = hashed.select("_id", "_row", F.posexplode("_hs").alias("_at", "_h"))
    known = Filter.of(settle(owned.select("h").distinct()), F.col("h"))
    if known is not None:
        told, hit = known.test(each, each["_h"])
        each = told.where(hit).select(*[each[c] for c in each.columns])
    first = F.floor(F.col("_at") / F.col("size")).cast("int")
    starts = F.transform(F.sequence(F.greatest(first - WINDOW + 1, F.lit(0)), first), lambda k: k * F.col("size"))
    placed = each.join(owned, F.col("_h") == F.col("h")).select("_id", "_row", "size", F.explode(starts).alias("at"), "h")
    windows = settle(placed.groupBy("_id", "_row", "size", "at").agg(F.collect_set("h").alias("w")).withColumn("window", F.monotonically_increasing_id()))

    # bands carry the number of a window, not what is in it
    filed = windows.select("window", "size", F.explode(min_hashes(F.col("w"), bands)).alias("m")).select("window", "size", "m.band", "m.least")
    wanted = kinds.select("license", "size", F.explode(min_hashes(F.col("t"), bands)).alias("m")).select("license", "size", "m.band", "m.least")
    met = filed.join(wanted, ["size", "band", "least"]).select("window", "license").distinct()
    pairs = windows.select("window", "_id", "at", "w").join(met, "window").join(kinds.select("license", "t"), "license")
    share = F.size(F.array_intersect("w", "t")) / F.size("t")
    return (
        pairs.withColumn("_share", share).where(F.col("_share") >= contained)
        .groupBy("_id", "license")
        .agg(F.max("_share").alias("containment"), F.min_by("at", F.struct(-F.col("_share"), F.col("at"))).cast("long").alias("first_shingle"))
        .withColumnRenamed("_id", id_col)
    )
