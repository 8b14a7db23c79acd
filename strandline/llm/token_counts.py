"""Edit-aware token counts: a stored segment tree over the pre-tokens of a document.

A leaf stands for a block of pre-tokens and holds how many characters, tokens and
pre-tokens it has; inner nodes hold the sums. Trees are a table of their own, a few
numbers per 32 pre-tokens. An edit walks down to its place, re-encodes from the block it
stands in until the cut of the new text falls on an old block's end behind it, and updates the
sums above the blocks that changed; whatever stands elsewhere is neither cut nor encoded
again. A pre-token depends on what follows it by two characters at most and on nothing
before it, so the boundary context makes the count exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import REMEMBERED_LENGTH, ByteBPE, encoder, pieces, ship_vocabulary
from .common import settle, whole_text

BLOCK = 32

COUNTS = ("n_pretokens", "n_tokens", "n_tokens_edited", "n_reencoded")

Counter = Callable[[str], int]


class CountTree:
    """Sums of a text as three heaps, of characters, tokens and pre-tokens: the node k has the children 2k and 2k + 1, leaves begin at half the length.

    The heaps are one array, which is stored as its bytes. ``reencoded`` counts the
    pre-tokens that edits had to encode.
    """

    def __init__(self, heaps: np.ndarray):
        self.heaps = heaps
        self.reencoded = 0

    @classmethod
    def of(cls, text: str, pattern: regex.Pattern, count: Counter) -> CountTree:
        found = pattern.findall(text)
        return cls._over(cls._blocks(np.array([list(map(len, found)), list(map(count, found))], np.int32).reshape(2, -1)))

    @classmethod
    def stored(cls, data: bytes) -> CountTree:
        return cls(np.frombuffer(data, "<i4").reshape(3, -1).copy())

    def packed(self) -> bytes:
        return self.heaps.astype("<i4").tobytes()

    @staticmethod
    def _blocks(pieces: np.ndarray) -> np.ndarray:
        """Leaves over pre-tokens, given as rows of characters and tokens."""
        n = pieces.shape[1]
        starts = np.arange(0, n, BLOCK)
        if not n:
            return np.zeros((3, 0), np.int32)
        return np.vstack([np.add.reduceat(pieces, starts, axis=1), np.minimum(BLOCK, n - starts)[None]]).astype(np.int32)

    @classmethod
    def _over(cls, leaves: np.ndarray) -> CountTree:
        n = leaves.shape[1]
        base = 1 << max(0, n - 1).bit_length()
        heaps = np.zeros((3, 2 * base), np.int32)
        heaps[:, base : base + n] = leaves
        while base > 1:
            heaps[:, base // 2 : base] = heaps[:, base : 2 * base : 2] + heaps[:, base + 1 : 2 * base : 2]
            base //= 2
        return cls(heaps)

    @property
    def base(self) -> int:
        return self.heaps.shape[1] // 2

    @property
    def total(self) -> int:
        return int(self.heaps[1, 1])

    @property
    def n_pieces(self) -> int:
        return int(self.heaps[2, 1])

    def _block_at(self, at: int) -> tuple[int, int]:
        """The block of the character ``at``, or the last one, and where it begins."""
        chars, k, before, base = self.heaps[0], 1, 0, self.base
        while k < base:
            k *= 2
            left = int(chars[k])
            if at >= before + left and chars[k + 1]:
                before += left
                k += 1
        return k - base, before

    def edit(self, text: str, at: int, removed: int, inserted: str, pattern: regex.Pattern, count: Counter) -> str:
        """Replace ``removed`` characters of ``text``, whose tree this is, at ``at``; returns the new text.

        Places and lengths beyond the text are cut to it.
        """
        at = min(max(at, 0), len(text))
        removed = min(max(removed, 0), len(text) - at)
        new = text[:at] + inserted + text[at + removed :]
        shift = len(inserted) - removed
        base = self.base
        first, start = self._block_at(max(0, at - 2))
        while first and (start > at - 2 or text[start:at].isspace()):
            first -= 1
            start -= int(self.heaps[0, base + first])
        # cut the new text until a cut falls on the end of an old block behind the edit
        block, old, now, got = first, start, start, []
        behind = iter(self.heaps[0, base + first :].tolist())
        for found in pattern.finditer(new, start):
            while block < base and (old < at + removed or old + shift < now):
                old += next(behind)
                block += 1
            if old >= at + removed and old + shift == now:
                break
            got.append(found[0])
            now = found.end()
        if now >= len(new):
            block = base  # the rest of the text is cut anew
        self.reencoded += len(got)

        leaves = self._blocks(np.array([list(map(len, got)), list(map(count, got))], np.int32).reshape(2, -1))
        n = leaves.shape[1]
        if n <= block - first:
            # the new blocks fit where the old ones were
            self.heaps[:, base + first : base + first + n] = leaves
            self.heaps[:, base + first + n : base + block] = 0
            low, high = base + first, base + block
            while low > 1:
                low, high = low // 2, (high + 1) // 2
                self.heaps[:, low:high] = self.heaps[:, 2 * low : 2 * high : 2] + self.heaps[:, 2 * low + 1 : 2 * high : 2]
        else:
            every = np.hstack([self.heaps[:, base : base + first], leaves, self.heaps[:, base + block :]])
            self.heaps = self._over(every[:, every[2] > 0]).heaps
        return new


#: Bytes of a generation of remembered numbers, and of an entry beside its characters.
LENGTHS_BYTES, LENGTH_BYTES = 48 << 20, 130
#: Pre-tokens up to so many bytes are merged by looking at all pairs; longer ones by the encoder's rank queue.
SHORT = 48

_BYTES = [bytes([b]) for b in range(256)]
_NO_RANK = 1 << 60


def n_tokens(data: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of a short pre-token: the pair of the smallest rank, the first of equals, is merged until none has a rank."""
    if data in ranks:
        return 1
    rank, symbols = ranks.get, [_BYTES[b] for b in data]
    pairs = [rank(a + b, _NO_RANK) for a, b in zip(symbols, symbols[1:])]
    while pairs and (least := min(pairs)) < _NO_RANK:
        i = pairs.index(least)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = rank(symbols[i - 1] + symbols[i], _NO_RANK)
        if i < len(pairs):
            pairs[i] = rank(symbols[i] + symbols[i + 1], _NO_RANK)
    return len(symbols)


class Lengths(dict):
    """Numbers of tokens by pre-token, in two generations of ``most`` bytes each; looking up what is known runs no Python code."""

    def __init__(self, encoder: ByteBPE, most: int = LENGTHS_BYTES):
        self.encoder, self.most, self.held = encoder, most, 0
        self.old: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            data = piece.encode("utf-8", "replace")
            n = n_tokens(data, self.encoder.ranks) if len(data) <= SHORT else len(self.encoder.merge(data))
            if len(piece) > REMEMBERED_LENGTH:
                return n
        if self.held >= self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += LENGTH_BYTES + len(piece)
        self[piece] = n
        return n


_lengths: dict[tuple[str, str], Lengths] = {}


@contextmanager
def counter(vocabulary: str, pattern: str) -> Iterator[Counter]:
    """How many tokens a pre-token has, by the one encoder of this worker process, for the time of a task."""
    with encoder(vocabulary, pattern) as enc:
        if (vocabulary, pattern) not in _lengths:
            _lengths[vocabulary, pattern] = Lengths(enc)
        yield _lengths[vocabulary, pattern].__getitem__


def plant(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tree of every row: id, ``mark`` (the text's hash) and ``tree``, the heaps' bytes.

    Null counts as empty, whose tree is zeros. Row by row, so repeated rows are all
    returned and an empty table gives no rows. Other columns are ignored.
    """
    ship_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(pattern)
        with counter(vocabulary, pattern) as count:
            for part in pieces(batches):
                trees = [CountTree.of(t.as_py(), cut, count).packed() for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(trees, pa.binary())], ["id", "mark", "tree"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return rows.mapInArrow(run, f"id {kind}, mark long, tree binary").withColumnRenamed("id", id_col)


def standard_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """An edits table for every document: an insertion at the start, a replacement in the middle, a cut near the end."""
    n = F.length(whole_text(text_col))
    edits = [(F.lit(0), 0, "Note: "), (F.floor(n / 2), 12, " revised wording"), (F.greatest(n - 30, F.lit(0)), 7, "")]
    rows = [F.struct(F.lit(k).alias("seq"), at.cast("int").alias("at"), F.lit(cut).alias("removed"), F.lit(new).alias("inserted")) for k, (at, cut, new) in enumerate(edits)]
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.explode(F.array(*rows)).alias("e")).distinct().select(id_col, "e.*")


def apply_edits(
    docs: DataFrame, trees: DataFrame, edits: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", counts_only: bool = False,
) -> DataFrame:
    """Update stored trees by a table of edits, ``id_col, seq, at, removed, inserted``.

    One row per row of ``docs``: id, the new ``text`` and tree (unless ``counts_only``),
    ``n_pretokens`` and ``n_tokens`` before, ``n_tokens_edited`` and ``n_reencoded``. The edits of an id are
    applied in the order of ``seq``, to each row that has the id; places count in the text
    as it then is. Without edits everything stays; a null id has none. ``trees`` are those
    of ``plant`` over the same texts: rows that repeat an id and a text share one, and a
    text without a tree fails the job. Trees and edits meet first, so texts move once.
    """
    ship_vocabulary(docs.sparkSession, vocabulary)
    text = whole_text(text_col)
    mine = F.array_sort(F.collect_list(F.struct("seq", "at", "removed", "inserted"))).alias("edits")
    per = edits.groupBy(F.col(id_col).alias("_edited")).agg(mine)
    known = trees.select(F.col(id_col).alias("_id"), F.col("mark").alias("_mark"), "tree")
    # all sides are dealt by id alone, so that trees and edits are exchanged once, like texts; marks are compared within
    side = known.where("_id is not null").repartition("_id").dropDuplicates(["_id", "_mark"]).join(per, F.col("_id") == F.col("_edited"), "left").drop("_edited")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    named = rows.where("id is not null").join(side, (F.col("id") == F.col("_id")) & (F.col("mark").bitwiseXOR(F.col("_mark")) == 0), "left")
    nameless = rows.where("id is null").join(known.where("_id is null").dropDuplicates(["_mark"]), F.col("mark") == F.col("_mark"), "left")
    columns = ["id", "text", "tree"]
    joined = named.select(*columns, "edits").unionByName(nameless.select(*columns), allowMissingColumns=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(pattern)
        kinds = [*([] if counts_only else [pa.string(), pa.binary()]), *[pa.int64()] * 4]
        with counter(vocabulary, pattern) as count:
            for part in pieces(batches):
                out = []
                for text, data, todo in zip(*(part.column(k).to_pylist() for k in range(1, 4))):
                    if data is None:
                        raise ValueError("a text without a stored tree")
                    tree = CountTree.stored(data)
                    before = (tree.n_pieces, tree.total)
                    for e in todo or ():
                        text = tree.edit(text, e["at"], e["removed"], e["inserted"], cut, count)
                    out.append((*(() if counts_only else (text, tree.packed())), *before, tree.total, tree.reencoded))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], ["id", *([] if counts_only else ["text", "tree"]), *COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    whole = "" if counts_only else "text string, tree binary, "
    updated = joined.mapInArrow(run, f"id {kind}, {whole}{', '.join(f'{c} long' for c in COUNTS)}")
    return updated.withColumnRenamed("id", id_col)


def count_edits(docs: DataFrame, vocabulary: str, pattern: str, edits: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plant and store the trees of ``docs``, then update them by ``edits`` (the standard ones if None): id and the four counts.

    Nulls, repeated rows and empty tables as in ``plant`` and ``apply_edits``.
    """
    trees = settle(plant(docs, vocabulary, pattern, id_col, text_col))
    edits = settle(standard_edits(docs, id_col, text_col)) if edits is None else edits
    return apply_edits(docs, trees, edits, vocabulary, pattern, id_col, text_col, counts_only=True)
