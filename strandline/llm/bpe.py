"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by the vocabulary's pattern and each is merged apart.
A pre-token is a linked list of symbols. Every adjacent pair that has a rank is filed
in the bucket of that rank, by the position of its left symbol. A bitmap of non-empty buckets
with a bitmap of its non-zero words above it finds the smallest rank by find-first-set,
from the top down. A bucket's positions are taken from left to right; an
entry whose pair is no longer there is stale and skipped. A merge costs a few bit
operations whatever the length, so a pre-token of a million bytes costs about a million
times what one byte does.

Words repeat, so ids of short pre-tokens are remembered; the memory is bounded by bytes
and its two generations turn over, which changes no result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from heapq import heappop, heappush
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_small_batches

#: Bits of a bitmap word: 2 ** SHIFT.
SHIFT = 8
BITS, MASK = 1 << SHIFT, (1 << SHIFT) - 1
BIT = [1 << k for k in range(BITS)]
#: Bytes of a generation of what is remembered, and of an entry beside its characters and ids, as measured.
REMEMBERED_BYTES = 64 << 20
ENTRY_BYTES = 200
REMEMBERED_LENGTH = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Memory(dict):
    """Ids by pre-token, in two generations of ``most`` bytes each; looking up what is known runs no Python code."""

    def __init__(self, merge: Callable[[bytes], tuple[int, ...]], most: int):
        self.merge, self.most, self.held = merge, most, 0
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.merge(piece.encode("utf-8", "replace"))
            if len(piece) > REMEMBERED_LENGTH:
                return ids
        if self.held >= self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += ENTRY_BYTES + len(piece) + 8 * len(ids)
        self[piece] = ids
        return ids


class ByteBPE:
    """Encoder and decoder for a rank table, each pre-token separately, no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED_BYTES):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.split = regex.compile(pattern).findall
        #: The lower level of the bitmap, a word per BITS ranks; the upper one is a number with a bit per word.
        self.words = [0] * (max(ranks.values()) // BITS + 1)
        self.remember = Memory(self.merge, remembered)
        self.names = {r: str(r) for r in self.bytes_of}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        rank_of = self.ranks.get
        whole = rank_of(data)
        if whole is not None:
            return (whole,)
        n = len(data)
        end = list(range(1, n + 1))  # where the symbol that starts here ends
        start = list(range(-1, n))  # where the symbol that ends here starts
        # the rank of the pair that starts here; None if there is none, or it has no rank
        pair = [rank_of(data[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        words, buckets, top = self.words, {}, 0  # no bit is set between calls
        new = enumerate(pair)
        while True:
            # file pairs: by rank, then by position; a rank's first one sets its bit
            for i, rank in new:
                if rank is None:
                    continue
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    at = rank >> SHIFT
                    if not words[at]:
                        top |= 1 << at
                    words[at] |= BIT[rank & MASK]
            if not top:
                break
            # find the first set bit, on top and then in the word it stands for
            at = (top & -top).bit_length() - 1
            word = words[at]
            low = word & -word
            rank = (at << SHIFT) + low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[at] = word = word ^ low
                if not word:
                    top &= top - 1
            if pair[i] != rank:  # stale
                new = ()
                continue
            j = end[i]
            k = end[i] = end[j]
            start[k], pair[j] = i, None
            pair[i] = rank_of(data[i : end[k]]) if k < n else None
            if i:
                h = start[i]
                pair[h] = rank_of(data[h:k])
                new = ((h, pair[h]), (i, pair[i]))
            else:
                new = ((i, pair[i]),)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            j = end[i]
            out.append(ranks[data[i:j]])
            i = j
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.remember.__getitem__, self.split(text or ""))))

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_encoders: dict[tuple[str, str], ByteBPE] = {}


@contextmanager
def encoder(path: str, pattern: str) -> Iterator[ByteBPE]:
    """The one encoder of this worker process and vocabulary, for the time of a task.

    ``path`` is a file that was sent along with ``ship_vocabulary``, or one that every
    executor has. Meanwhile Python's search for cycles rests: what is remembered has none,
    and looking through it costs more than encoding.
    """
    if (path, pattern) not in _encoders:
        there = SparkFiles.get(Path(path).name) if SparkFiles._is_running_on_worker else path
        _encoders[path, pattern] = ByteBPE(read_ranks(there if Path(there).exists() else path), pattern)
    gc.disable()
    try:
        yield _encoders[path, pattern]
    finally:
        gc.enable()
        pa.default_memory_pool().release_unused()


def ship_vocabulary(spark: SparkSession, path: str) -> None:
    """Send a vocabulary file to the executors; once per application and file."""
    in_small_batches(spark)
    context = spark.sparkContext
    if (context.applicationId, path) not in _shipped:
        context.addFile(path)
        _shipped.add((context.applicationId, path))


_shipped: set[tuple[str, str]] = set()


def encode_table(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``ids`` (array of int), whole texts.

    Null and empty texts have no ids. Row by row, so repeated rows are all returned and an
    empty table gives no rows; other columns are ignored.
    """
    ship_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(vocabulary, pattern) as enc:
            for part in pieces(batches):
                ids = pa.array([enc.encode(t.as_py()) for t in part.column(1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of a few rows, so that what is made of one stays small."""
    return (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))


def digest_table(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode, decode again, and return ``n_tokens, ids_sha256, decoded_sha256`` per row, and with ``ids`` the ids.

    ``ids_sha256`` is over the decimal ids joined by commas, ``decoded_sha256`` over the
    decoded bytes. Null and empty texts have no tokens. Works row by row, so an empty
    table gives no rows and repeated rows are all returned; other columns are ignored.
    """
    ship_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(vocabulary, pattern) as enc:
            for part in pieces(batches):
                coded = [enc.encode(t.as_py()) for t in part.column(1)]
                columns = {
                    "n_tokens": pa.array(map(len, coded), pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(",".join(map(enc.names.__getitem__, x)).encode()).hexdigest() for x in coded], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in coded], pa.string()),
                }
                if ids:
                    columns["ids"] = pa.array(coded, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns.values()], ["id", *columns])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_table(coded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id and ``content`` (binary), the bytes that the ids stand for.

    Null and empty ids stand for no bytes; an id that the vocabulary lacks fails the job.
    Row by row, so repeated rows are all returned and an empty table gives no rows.
    """
    ship_vocabulary(coded.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(vocabulary, pattern) as enc:
            for part in pieces(batches):
                out = pa.array([enc.decode(x.as_py() or ()) for x in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), out], ["id", "content"])

    kind = coded.schema[id_col].dataType.simpleString()
    out = coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, content binary")
    return out.withColumnRenamed("id", id_col)
