"""SimHash near-dedup: fingerprints, linked at a few differing bits.

Pigeonhole blocks, in two forms.

``Narrow`` links 64-bit fingerprints at a handful of bits and loses no link. The bits are
cut into ``blocks`` parts; two fingerprints that differ in at most ``bits`` bits agree on
``blocks - bits`` parts at least, so each is filed under every choice of that many parts.
With six parts and four bits that is 15 keys of 20 to 22 bits; more parts are taken where
there are too many fingerprints for keys of that width.

``Wide`` links 256-bit fingerprints of five-word shingles at a share of differing bits that
stands for a similarity of 0.8. So many bits may differ that no choice of parts is both
certain and selective; the bits are cut into parts again and again, each time in another
order, as often as gives close pairs a common part with a stated probability.

Either way candidates are then verified by Hamming distance over the whole fingerprint.
Only distinct fingerprints are filed. Rows of a key are read as one sorted stream and
a search over the key's members returns a spanning forest of its links, never its
pairs: a member that is reached is compared with those not yet reached only, so a tight
group costs about as much as it has members. A key with more than ``chunk`` members is
dealt out as pairs of chunks, each in a task of its own, so nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, drop_marked, in_small_batches, settle, whole_text
from .components import components

BITS = 4
BLOCKS = 6
CHUNK = 16_384
SHINGLE = 4
#: Shingles whose bits are counted at once.
STEP = 1 << 14
#: Mean members of a key that the choice of keys aims at, at most.
MEMBERS = 256


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of 64-bit hashes; the first is the hash itself."""
    if not k:
        return h
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def print_of(text: str | None, shingle: int = SHINGLE, width: int = 1) -> bytes:
    """The fingerprint: ``width`` words of 64 bits, most significant byte first; zeros for a text without words.

    A-Z are lower-cased, words are runs of non-blanks, shingles of ``shingle`` words
    joined by spaces are hashed (XXH64, seed 42), repeats included; a shorter text is
    one shingle. A bit is 1 if more than half of the hashes have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8 * width)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], np.uint64)
    ones = np.zeros(64 * width, np.int64)
    for k in range(0, len(hashes), STEP):
        part = hashes[k : k + STEP]
        full = part[:, None] if width == 1 else np.stack([_mixed(part, j) for j in range(width)], axis=1)
        ones += np.unpackbits(full.astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as an unsigned number."""
    return int.from_bytes(print_of(text, shingle), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, width: int = 1, digest: bool = False) -> DataFrame:
    """``id`` and ``fp`` (binary) of every row; with ``digest`` also ``sha``, the text's SHA-256 in hex."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([print_of(t.as_py(), shingle, width) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out, *batch.columns[2:]], ["id", "fp", *batch.schema.names[2:]])

    in_small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.sha2(whole_text(text_col), 256).alias("sha")] if digest else []))
    return rows.mapInArrow(run, f"id {kind}, fp binary" + ", sha string" * digest)


def as_words(column: pa.Array) -> np.ndarray:
    """Fingerprints of a batch as rows of 64-bit words."""
    got = column.to_pylist()
    return np.frombuffer(b"".join(got), ">u8").astype(np.uint64).reshape(len(got), -1)


@dataclass(frozen=True)
class Narrow:
    """64 bits, linked at ``bits`` differing ones; ``blocks`` is chosen from the number of fingerprints if not given."""

    bits: int = BITS
    blocks: int | None = None
    shingle: int = SHINGLE
    width: int = 1

    def fitted(self, n: int) -> Narrow:
        """With the fewest blocks whose keys hold MEMBERS fingerprints at most, on average, of ``n``."""
        blocks = self.blocks or max(BLOCKS, self.bits + 2)
        while not self.blocks and blocks < 16 and n >> (64 // blocks) * (blocks - self.bits) > MEMBERS:
            blocks += 1
        return Narrow(self.bits, blocks, self.shingle)

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """A column of key values per choice of parts."""
        edges = [round(64 * k / self.blocks) for k in range(self.blocks + 1)]
        masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        chosen = np.array([sum(c) for c in combinations(masks, self.blocks - self.bits)], np.uint64)
        return fps & chosen


#: Share of differing bits at a similarity of 0.8, and the largest that is linked.
APART, LINKED = 0.155, 0.165


@dataclass(frozen=True)
class Wide:
    """``width`` words of 64 bits, linked where at most ``bits`` differ.

    Parts of ``part`` bits; as many of them that two fingerprints ``APART`` of whose bits
    differ share one with a probability of ``recall`` (closer ones with a larger one).
    """

    bits: int = int(LINKED * 256)
    part: int | None = None
    recall: float = 0.95
    shingle: int = 5
    width: int = 4

    def fitted(self, n: int) -> Wide:
        """With parts wide enough for ``n`` fingerprints: MEMBERS of them to a key at most, on average."""
        return Wide(self.bits, self.part or min(60, max(16, math.ceil(math.log2(max(n, 1) / MEMBERS)))), self.recall, self.shingle, self.width)

    @property
    def n_keys(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - (1 - APART) ** self.part))

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """A column of key values per part; the bits are cut in order first, then in orders drawn with fixed seeds."""
        bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)
        per = bits.shape[1] // self.part
        weights = np.uint64(1) << np.arange(self.part, dtype=np.uint64)
        out = np.empty((len(fps), self.n_keys), np.uint64)
        for k in range(self.n_keys):
            if k % per == 0:
                order = np.arange(bits.shape[1]) if not k else np.random.default_rng(k).permutation(bits.shape[1])
            mine = order[k % per * self.part : (k % per + 1) * self.part]
            out[:, k] = bits[:, mine].astype(np.uint64) @ weights
        return out


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints given as rows of words."""
    return np.bitwise_count(a ^ b).sum(axis=-1)


def forest(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links that span every group of fingerprints (rows of words) linked at ``bits`` bits."""
    left = np.arange(len(fps))
    found_a, found_b = [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            a = queue.pop()
            near = apart(fps[left], fps[a]) <= bits
            if near.any():
                got = left[near]
                left = left[~near]
                found_a.append(np.full(len(got), a))
                found_b.append(got)
                queue.extend(got.tolist())
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


#: Groups up to this size are first asked, all together, whether they hold any link at all.
SMALL = 64


def _linked_groups(fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """Which groups hold a link; of large ones it isn't asked."""
    hit = sizes > SMALL
    for step in range(1, SMALL):
        some = np.flatnonzero((sizes > step) & ~hit)
        if not len(some):
            break
        # every member against the one ``step`` places on
        n = sizes[some] - step
        which = np.repeat(some, n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[which]
        hit[which[apart(fp[at], fp[at + step]) <= bits]] = True
    return hit


def _linker(bits: int):
    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of ``group, fp, node`` in the order of group, as spanning links of each group."""

        def solve(group: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1))
            sizes = np.diff(np.concatenate((starts, [len(group)])))
            some = np.flatnonzero(_linked_groups(fp, starts, sizes, bits))
            us, vs = [], []
            for s, n in zip(starts[some].tolist(), sizes[some].tolist()):
                a, b = forest(fp[s : s + n], bits)
                us.append(node[s + a])
                vs.append(node[s + b])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (us, vs)], ["u", "v"])

        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column(0).to_numpy(zero_copy_only=False), as_words(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False))
            last = int(np.searchsorted(now[0], now[0][-1], side="left"))
            if last or (held and held[-1][0][-1] != now[0][0]):
                # groups before the last of this batch are complete
                whole = [*held, tuple(x[:last] for x in now)]
                yield from solve(*(np.concatenate([w[k] for w in whole]) for k in range(3)))
                held = []
            held.append(tuple(x[last:] for x in now))
        if held:
            yield from solve(*(np.concatenate([w[k] for w in held]) for k in range(3)))

    return link


def links(nodes: DataFrame, form: Narrow | Wide = Narrow(), chunk: int = CHUNK) -> DataFrame:
    """Edges ``u, v`` between ``node`` (long) of ``nodes`` (settled, distinct ``fp``) that span all links."""
    fitted = form.fitted(nodes.count())

    def file(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                keys = fitted.keys(as_words(part.column(0)))
                rows = np.repeat(np.arange(len(keys)), keys.shape[1])
                numbers = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(keys))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array(numbers), pa.array(keys.ravel().view(np.int64))], ["fp", "node", "part", "value"])

    filed = nodes.select("fp", "node").mapInArrow(file, "fp binary, node long, part int, value long")
    large = settle(
        filed.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
        .select("part", "value", F.ceil(F.col("n") / chunk).cast("long").alias("chunks"))
    )
    if large.isEmpty():
        dealt = filed.withColumn("pair", F.lit(0).cast("long"))
    else:
        mine = F.pmod(F.xxhash64("node"), F.col("chunks"))
        pairs = F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1),
            lambda j: F.least(mine, j) * F.col("chunks") + F.greatest(mine, j),
        )
        dealt = (
            filed.join(large, ["part", "value"], "left")
            .withColumn("pair", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)))
        )
    # groups are told apart by a hash: two that meet by chance are searched as one, which adds no false link
    group = F.xxhash64("part", "value", "pair")
    return (
        dealt.select(group.alias("group"), "fp", "node")
        # by node, so that the searches of many keys begin at the same nodes and find the same links
        .repartition("group").sortWithinPartitions("group", "node")
        .mapInArrow(_linker(fitted.bits), "u long, v long")
    )


def classes(printed: DataFrame, least: Column, form: Narrow | Wide, chunk: int) -> DataFrame:
    """``fp, root, least``: the class (a number) of every ``fp`` of ``printed`` and the smallest ``least`` of its rows.

    Nodes are fingerprints, numbered when they are settled, so what rows share beside a
    fingerprint (an id, say) links nothing.
    """
    nodes = settle(printed.groupBy("fp").agg(F.min(least).alias("least")).withColumn("node", F.monotonically_increasing_id()))
    roots = components(links(nodes, form, chunk)).withColumnRenamed("node", "_node")
    return nodes.join(roots, F.col("node") == F.col("_node"), "left").select("fp", F.coalesce("root", "node").alias("root"), "least")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: Narrow | Wide = Narrow(), chunk: int = CHUNK,
) -> DataFrame:
    """One row per input row: ``id_col, fingerprint, component_id``.

    ``fingerprint`` is lowercase hex digits (16 in the narrow form); ``component_id`` the
    smallest id that can be reached over links, the row's own included. Null and empty
    texts have fingerprint zero and link like any other. A null id never names a component:
    a fingerprint that only rows without an id have links to nothing and has a null
    component. Repeated ids and rows are all returned; texts of one id link only if they
    are near. Ids keep their type. An empty table gives no rows.
    """
    printed = settle(fingerprints(docs, id_col, text_col, form.shingle, form.width))
    named = settle(classes(printed.where("id is not null"), F.col("id"), form, chunk))
    firsts = named.groupBy("root").agg(F.min("least").alias("first")).select(dealt_anew(F.col("root")).alias("k"), "first")
    judged = named.select(F.col("fp").alias("_fp"), dealt_anew(F.col("root")).alias("k")).join(firsts, "k")
    return (
        printed.join(judged, F.col("fp") == F.col("_fp"), "left")
        .select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), F.col("first").alias("component_id"))
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: Narrow | Wide = Wide(), chunk: int = CHUNK) -> DataFrame:
    """``docs`` with one row of each class of near texts, one with the smallest id; rows without an id stay.

    Null and empty texts count as equal. Classes are those of fingerprints and rows go by
    id and digest, so unrelated texts of one id are told apart. Of near texts of the
    smallest id that with the smallest digest stays; of rows that repeat both its id and
    its text the first that Spark meets. An empty table gives no rows; other columns stay
    as they are whatever their names.
    """
    printed = settle(fingerprints(docs, id_col, text_col, form.shingle, form.width, digest=True)).where("id is not null")
    named = settle(classes(printed, F.struct("id", "sha"), form, chunk))
    firsts = named.groupBy("root").agg(F.min("least").alias("first")).select(dealt_anew(F.col("root")).alias("k"), "first")
    judged = named.select(F.col("fp").alias("_fp"), dealt_anew(F.col("root")).alias("k")).join(firsts, "k").select("_fp", "first")
    rows = printed.groupBy("id", "sha", "fp").agg(F.count("*").alias("_n")).join(judged, F.col("fp") == F.col("_fp")).select(
        F.col("id").alias("_copy"), F.col("sha").alias("_sha"), "_n", ((F.col("id") == F.col("first.id")) & (F.col("sha") == F.col("first.sha"))).alias("_stays"),
    )
    return drop_marked(docs, docs[id_col], F.sha2(whole_text(text_col), 256), settle(rows.where("not _stays or _n > 1")))
