"""Ranked lexical search over document shards.

The index holds every document once. A shard is a bounded run of documents with its own
postings in compressed rows: the shard's terms, where each term's postings begin, and per
posting the document's place in the shard and its impact, a whole number that has the
term's frequency and the document's length in it. What depends on all documents, the
terms' weights, joins at search time, so an index is written in one pass over the texts.

Spark holds a group of rows of a file at once, both to write and to read it, so a shard
is a group of its own, and its numbers are bytes, where an array's would each have two
levels beside them. A task then needs room for one shard, however many it writes or reads.

A search goes through every shard's terms one at a time, adding weight times impact into
a dense array of scores, a slot per document; the best of a shard are picked by
partition, ties at the edge included, and cut by id. A task merges the shards that it
reads, so each hands on ``k`` rows per query. Queries are read in blocks of bounded size.

Scores are sums of 64-bit whole numbers and don't depend on how documents are dealt.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_small_batches, settle

BEST = 10
#: Postings and documents at which a shard is closed; a document's place has 16 bits.
SHARD_POSTINGS, SHARD_DOCS = 1 << 19, 1 << 16
#: Terms of one block of queries; a query with more is a block of its own.
BLOCK_TERMS = 1 << 18
#: Share of a document's length in its normalisation, in hundredths.
LENGTH_SHARE = 90

#: What parts terms: ASCII other than letters and digits. Letters A-Z become lower case.
_FOLD = bytes(32 if not chr(c).isalnum() else ord(chr(c).lower()) for c in range(128)) + bytes(range(128, 256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_FOLD).split()


def _bytes(column: pa.Array) -> Iterator[bytes]:
    return (b"" if v is None else v for v in column.cast(pa.binary()).to_pylist())


def _small(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))


@dataclass
class Index:
    """``shards``: a row per shard. ``documents`` and ``terms``: how many documents have a term, and all their terms."""

    shards: DataFrame
    documents: int
    terms: int


def _counts(rows: DataFrame) -> tuple[int, int]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for b in _small(batches):
            for text in _bytes(b.column(0)):
                n = len(terms_of(text))
                docs, terms = docs + (n > 0), terms + n
        yield pa.RecordBatch.from_pylist([{"docs": docs, "terms": terms}])

    got = rows.select("text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return got["docs"] or 0, got["terms"] or 0


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_postings: int = SHARD_POSTINGS) -> Index:
    """The index of all ``docs``, written to the shared folder.

    Null and empty texts, and texts of blanks and signs only, hold no term, so nothing finds
    them; rows that repeat are documents of their own.
    """
    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    n_docs, n_terms = _counts(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        places: dict[bytes, list[int]] = {}
        held = 0

        def shard() -> pa.RecordBatch:
            terms = sorted(places)
            counts = [len(places[t]) // 2 for t in terms]
            flat = np.fromiter((v for t in terms for v in places[t]), np.int32, 2 * held).reshape(-1, 2)
            row = [ids, b"".join(terms), _from_0(map(len, terms)), _from_0(counts), flat[:, 0].astype(PLACE).tobytes(), flat[:, 1].astype(WHOLE).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.int64()) if v is ids else pa.binary()) for v in row], SHARD.names)

        for b in _small(batches):
            for doc, text in zip(b.column(0).to_pylist(), _bytes(b.column(1))):
                words = terms_of(text)
                if not words:
                    continue
                m = 100 - LENGTH_SHARE + LENGTH_SHARE * len(words) * n_docs // n_terms
                counted = Counter(words)
                for w, tf in counted.items():
                    places.setdefault(w, []).extend((len(ids), impact(tf, m)))
                ids.append(doc)
                held += len(counted)
                if held >= shard_postings or len(ids) >= SHARD_DOCS:
                    yield shard()
                    ids, places, held = [], {}, 0
        if ids:
            yield shard()

    return Index(settle(rows.mapInArrow(run, SHARD), options=ROW_BY_ROW), n_docs, n_terms)


#: ``terms`` one after the other, in order, term k beginning at ``starts[k]``. ``docs`` and
#: ``impacts`` are the postings, those of term k beginning at ``begins[k]``. Whole numbers
#: of the kind PLACE in ``docs`` and of WHOLE elsewhere.
SHARD = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), *(T.StructField(c, T.BinaryType()) for c in ("terms", "starts", "begins", "docs", "impacts"))])
PLACE, WHOLE = np.dtype("<u2"), np.dtype("<i4")
#: A row is a group of its own; dictionaries and bounds of its bytes would serve nobody.
ROW_BY_ROW = {"parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false"}


def _from_0(lengths: Iterable[int]) -> bytes:
    """Where each begins and the last ends of what is so long."""
    return np.array([0, *accumulate(lengths)], WHOLE).tobytes()


def _numbers(value: pa.BinaryScalar, kind: np.dtype = WHOLE) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _terms(terms: pa.BinaryScalar, starts: pa.BinaryScalar) -> pa.Array:
    offsets = starts.as_buffer()
    return pa.Array.from_buffers(pa.binary(), offsets.size // WHOLE.itemsize - 1, [None, offsets, terms.as_buffer()])


def impact(tf: int, m: int) -> int:
    """What a term adds for its weight in a document where it stands ``tf`` times and whose length counts as ``m``."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of ``documents`` hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def best(scores: np.ndarray, ids: np.ndarray, absent: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores above 0, ties by id, rows without an id last."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        # all that reach the k-th score stay in, so that ids can decide between them
        edge = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= edge]
    return found[np.lexsort((ids[found], absent[found], -scores[found]))][:k]


Block = list[tuple[int, list[bytes]]]


def _blocks(queries: DataFrame, id_col: str, text_col: str, block_terms: int) -> Iterator[tuple[list, Block]]:
    """Queries in blocks: their ids, and for each its place in the block and its terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            terms = pa.array([sorted(set(terms_of(t))) for t in _bytes(b.column(1))], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), terms], ["id", "terms"])

    schema = T.StructType([T.StructField("id", queries.schema[id_col].dataType), T.StructField("terms", T.ArrayType(T.BinaryType()))])
    asked = settle(queries.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema))
    ids, block, held = [], [], 0
    for r in asked.toLocalIterator():
        if block and held + len(r["terms"]) > block_terms:
            yield ids, block
            ids, block, held = [], [], 0
        block.append((len(ids), [bytes(t) for t in r["terms"]]))
        ids.append(r["id"])
        held += len(r["terms"])
    if block:
        yield ids, block


def _holding(index: Index, wanted: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the ``wanted`` terms; reads no postings."""
    known = pa.array(wanted, pa.binary())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(known), np.int64)
        for b in batches:
            for terms, starts, begins in zip(*b.columns):
                at = pc.index_in(_terms(terms, starts), known).to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(at == at)  # a term that isn't wanted has NaN
                sums[at[hit].astype(np.int64)] += np.diff(_numbers(begins))[hit]
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["term", "n"])

    got = index.shards.select("terms", "starts", "begins").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {wanted[r["term"]]: r["n"] for r in got.collect()}


def _scored(index: Index, block: Block, k: int) -> DataFrame:
    """The ``k`` best documents of every task for each query of a block: ``q, id, score``."""
    wanted = sorted({t for _, terms in block for t in terms})
    holding = _holding(index, wanted)
    wanted = [t for t in wanted if t in holding]
    number = {t: j for j, t in enumerate(wanted)}
    weights = [weight(index.documents, holding[t]) for t in wanted]
    asked = [(q, [number[t] for t in terms if t in number]) for q, terms in block]
    known = pa.array(wanted, pa.binary())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            for ids, terms, starts, begins, docs, impacts in zip(*b.columns):
                absent = ids.values.is_null().to_numpy(zero_copy_only=False)
                own, begins = ids.values.fill_null(0).to_numpy(), _numbers(begins)
                docs, impacts = _numbers(docs, PLACE), _numbers(impacts)
                # where each wanted term is in this shard, if it is
                at = {j: i for i, j in enumerate(pc.index_in(_terms(terms, starts), known).to_pylist()) if j is not None}
                scores = np.zeros(len(own), np.int64)
                for q, named in asked:
                    here = [(j, at[j]) for j in named if j in at]
                    if not here:
                        continue
                    scores[:] = 0
                    for j, i in here:
                        part = slice(begins[i], begins[i + 1])
                        scores[docs[part]] += weights[j] * impacts[part].astype(np.int64)
                    top = best(scores, own, absent, k)
                    found = (scores[top], own[top], absent[top])
                    if q in kept:
                        s, i, a = (np.concatenate(p) for p in zip(kept[q], found))
                        top = best(s, i, a, k)
                        found = s[top], i[top], a[top]
                    kept[q] = found
        for q, (s, i, a) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q)), pa.array(i, mask=a), pa.array(s)], ["q", "id", "score"])

    return index.shards.select(*SHARD.names).mapInArrow(run, "q long, id long, score long")


def search(index: Index, queries: DataFrame, k: int = BEST, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``id_col, rank, doc_id, score``: the ``k`` best documents of each query, by falling score, equal ones by id.

    A query without terms, or whose terms no document holds, finds nothing, and so do all
    in an empty index. Queries that repeat are answered each on its own. Documents without
    an id come after equals. A term that all documents hold may weigh 0, and a score of 0
    finds nothing.
    """
    spark: SparkSession = queries.sparkSession
    schema = T.StructType([T.StructField(id_col, queries.schema[id_col].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    found = spark.createDataFrame([], schema)
    if not index.documents:
        return found
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    for ids, block in _blocks(queries, id_col, text_col, block_terms):
        ranked = _scored(index, block, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("at", T.LongType()), schema[id_col]]))
        part = ranked.join(F.broadcast(names), F.col("q") == F.col("at")).select(id_col, "rank", F.col("id").alias("doc_id"), "score")
        found = found.unionAll(settle(part))
    return found
