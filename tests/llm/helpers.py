"""Rows that every operator must stand: nulls, empties, repeats, long texts, clashing columns."""

from pyspark.sql import functions as F

LONG = "word " * 30_000 + "end"
CLASHES = ["size", "target", "copies", "_id", "_row", "_text", "_source", "_gone", "fp", "id", "text2", "n_words", "kept", "keep_id", "license", "component_id", "score", "_q", "u", "group", "_copy", "_sha", "_stays", "_n", "a.b"]


def docs(spark, rows, clash=True):
    """``rows`` of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], None if r[0] is None else "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in CLASHES}) if clash else df


EDGES = [
    (1, "one two three four five six"), (2, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, ""), (5, " \n\t "),
    (6, LONG), (None, "one two three four five six"), (None, None), (7, "Ünïcödé 中文 😀 text"), (8, "x"), (9, "one two three four five six seven", None),
]


def rows(df):
    return [r.asDict() for r in df.collect()]
