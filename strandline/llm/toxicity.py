"""Toxicity scores from a learned lexicon, a Levenshtein automaton and context windows.

The lexicon is learned from labelled rows: words, and stems that words begin with,
that toxic rows have and clean rows lack. Its trie is intersected with a Levenshtein
automaton of one edit, made deterministic as words are read, so a word costs a table
lookup per letter. Which kinds of edit a term may have, the first letter's included, is
measured on clean rows. A hit counts by its weight, less for a misspelling, and less
again inside quotation marks or beside a reporting word. Beginnings that ordinary words
share, but that only toxic rows hold again and again, count from their second or third
word on. One logistic curve over the summed weight and the text's length (long texts hold
some terms by chance) gives the score, set so that even odds score ``THRESHOLD``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, settle

#: Most labelled rows of each class that the model is fitted on, in the order of a hash of the id.
SAMPLE_PER_CLASS = 2_500
THRESHOLD = 0.7
#: Added to the log odds, so that even odds score THRESHOLD.
EVEN = math.log(THRESHOLD / (1 - THRESHOLD))
FOLDS, HELD_OUT = 3, 1

STEM_LENGTHS = range(4, 9)
#: How often a text must hold a beginning that one word alone says nothing by.
REPEATS = (2, 3)
MOST_LETTERS = 24
MISSPELLED = 0.6
QUOTED = 0.3
#: Characters on each side of a hit that are its context.
WINDOW = 60

SYMBOLS = "*@$!"
WORD = re.compile(r"\w+(?:[*@$!]\w+)*")
#: A word as it may be misspelled: its first letter may be written as a symbol.
SPELLED = re.compile(r"[*@$!]*\w+(?:[*@$!]\w+)*")
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’"}
# Words that report speech rather than address somebody; fixed values.
REPORTING = frozenset("said says saying called quote quoted quotes wrote word words term sagte sagt nannte zitat wort dijo dice llamó cita palabra dit disait appelé citation mot".split())


def is_held_out(doc_id) -> bool:
    """Rows whose labels are never learned from: crc32 of the id as text, mod 3, is 1."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def candidate_terms(words: Iterable[str]) -> set[tuple[str, int]]:
    """What a text offers to the lexicon: its words, and stems marked by a star, each with how often it stands there at least."""
    out, stems = set(), Counter()
    for w, n in Counter(words).items():
        if 3 <= len(w) <= MOST_LETTERS and not w.isdigit():
            out.add((w, 1))
            for k in STEM_LENGTHS:
                if k < len(w):
                    stems[w[:k] + "*"] += n
    out.update((s, k) for s, n in stems.items() for k in (1, *REPEATS) if n >= k)
    return out


def choose_terms(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, least: int, share: float = 0.98, begun: Iterable[str] = ()) -> dict[str, float]:
    """Terms and weights from (toxic rows, clean rows) per candidate.

    Stems are taken shortest first; one is drawn out letter by letter while it keeps
    nearly all of its toxic rows, and what begins with a chosen term, or with a stem of
    ``begun``, isn't looked at again. The weight is the log ratio of the rates, smoothed.
    """

    def clean_enough(t: str) -> bool:
        a, b = counts[t]
        return a >= least and a / n_toxic >= share * (a / n_toxic + (b + 0.5) / (n_clean + 1))

    def weight(t: str) -> float:
        a, b = counts[t]
        return math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))

    longer: dict[str, list[str]] = {}
    for t in counts:
        longer.setdefault(t.rstrip("*")[:-1], []).append(t)
    chosen: dict[str, float] = {}
    taken = {t for t in begun if t.endswith("*")}
    for t in sorted(counts, key=lambda t: (len(t.rstrip("*")), not t.endswith("*"), t)):
        stem = t.rstrip("*")
        if not clean_enough(t) or any(stem[:n] + "*" in taken for n in range(1, len(stem) + 1)) or any(c.startswith(stem) and t.endswith("*") for c in chosen):
            continue
        if t.endswith("*"):
            while True:
                near = [x for x in (*longer.get(stem, ()), stem) if x in counts and x != t and x.startswith(stem) and counts[x][0] >= share * counts[t][0]]
                if not near:
                    break
                t = max(near, key=lambda x: (counts[x][0], not x.endswith("*"), x))
                stem = t.rstrip("*")
                if not t.endswith("*"):
                    break
        chosen[t] = weight(t)
        taken.add(t)
    return {t: w for t, w in chosen.items() if w > 0}


#: Kinds of edit: after the first letter, at or before it, and one that writes a symbol anywhere.
INNER, FIRST, SYMBOL = KINDS = 1, 2, 3


def is_long(term: str) -> bool:
    """Whether a term has five letters or more, or a stem six."""
    return len(term.rstrip("*")) >= (6 if term.endswith("*") else 5)


class Automaton:
    """Lexicon trie x Levenshtein automaton of one edit, determinised lazily.

    States are sets of (trie node, kind of the edit so far or 0). ``fuzzy`` has the
    (term, kind) that are looked for; without it the kinds are INNER and SYMBOL, of long
    terms. ``look`` gives the best (term, edits) of a
    word or None.
    """

    def __init__(self, terms: Iterable[str], fuzzy: Iterable[tuple[str, int]] | None = None):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, bool]]] = [[]]
        self.fuzzy = {(t, k) for t in terms if is_long(t) for k in (INNER, SYMBOL)} if fuzzy is None else set(fuzzy)
        self.soft: list[set[int]] = [set()]  # kinds of edit that some term below may have
        for t in sorted(terms):
            kinds = {k for k in KINDS if (t, k) in self.fuzzy}
            self.soft[0] |= kinds
            at = 0
            for c in t.rstrip("*"):
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.soft.append(set())
                at = self.children[at][c]
                self.soft[at] |= kinds
            self.ends[at].append((t, t.endswith("*")))
        self.steps: list[dict[str, int]] = []
        self.sets: list[tuple] = []
        self.found: list[tuple | None] = []
        self.known: dict[tuple, int] = {}
        self.dead = self._state(set(), frozenset())
        self.start = self._state(self._closed({(0, 0)}), frozenset())

    def _closed(self, nodes: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """With what a letter left out leads to; a node that is reached without an edit needs no other."""
        out = set(nodes)
        for n, e in nodes:
            if not e:
                kind = INNER if n else FIRST
                out |= {(m, kind) for m in self.children[n].values() if kind in self.soft[m]}
        return {(n, e) for n, e in out if not e or (n, 0) not in out}

    def _hits(self, state: int) -> set[tuple[int, str]]:
        nodes, stems = self.sets[state]
        return {(e, t) for n, e in nodes for t, is_stem in self.ends[n] if not is_stem and (not e or (t, e) in self.fuzzy)} | stems

    def _state(self, nodes: set[tuple[int, int]], stems: frozenset) -> int:
        key = (frozenset(nodes), stems)
        if key not in self.known:
            self.known[key] = len(self.steps)
            self.steps.append({})
            self.sets.append(key)
            best = min(self._hits(len(self.sets) - 1), default=None)
            self.found.append((best[1], min(best[0], 1)) if best else None)
        return self.known[key]

    def _step(self, state: int, c: str) -> int:
        nodes, stems = self.sets[state]
        out = set()
        for n, e in nodes:
            if c in self.children[n] and (not e or e in self.soft[self.children[n][c]]):
                out.add((self.children[n][c], e))
            kind = SYMBOL if c in SYMBOLS else INNER if n else FIRST
            if not e and kind in self.soft[n]:
                # a letter too many, or a wrong one
                out |= {(n, kind), *((m, kind) for m in self.children[n].values() if kind in self.soft[m])}
        out = self._closed(out)
        stems = stems | {(e, t) for n, e in out for t, is_stem in self.ends[n] if is_stem and (not e or (t, e) in self.fuzzy)}
        if stems and not min(stems)[0]:
            stems = frozenset({min(stems)})  # none is better
        to = self.steps[state][c] = self._state(out, stems)
        return to

    def _read(self, word: str) -> int:
        state, steps = self.start, self.steps
        for c in word:
            to = steps[state].get(c)
            if to is None:
                to = self._step(state, c)
            state = to
            if state == self.dead:
                break
        return state

    def look(self, word: str) -> tuple[str, int] | None:
        got = self.found[self._read(word)]
        if word[0] in SYMBOLS and not (got and not got[1]):
            # symbols before a word that is spelled right are no misspelling
            bare = self.found[self._read(word.lstrip(SYMBOLS))]
            got = bare if bare and (not bare[1] or not got) else got
        return got

    def near(self, word: str) -> set[tuple[str, int]]:
        """Every (term, kind of edit) that the word is a misspelling of; none if it is a term."""
        got = self._hits(self._read(word)) | self._hits(self._read(word.lstrip(SYMBOLS)))
        return set() if any(not e for e, _ in got) else {(t, e) for e, t in got}


def is_quoted(text: str, a: int, b: int) -> bool:
    """Whether the hit text[a:b] stands in quotation marks or beside a reporting word, within the window."""
    before, after = text[max(0, a - WINDOW) : a], text[b : b + WINDOW]
    for left, right in QUOTES.items():
        if left == right:
            if before.count(left) % 2 and left in after:
                return True
        elif before.rfind(left) > before.rfind(right) and right in after:
            return True
    near = WORD.findall(before)[-3:] + WORD.findall(after)[:3]
    return any(w in REPORTING for w in near)


@dataclass
class Model:
    """Term weights, the (term, kind of edit) that count as misspellings, repeated stems, and the curve's bias and slopes.

    ``repeated`` gives a stem's (least number of words, weight).
    """

    weights: dict[str, float] = field(default_factory=dict)
    fuzzy: frozenset[tuple[str, int]] = frozenset()
    repeated: dict[str, tuple[int, float]] = field(default_factory=dict)
    bias: float = -10.0
    slope: float = 0.0
    per_length: float = 0.0

    def __post_init__(self):
        #: What a text must hold to be predicted toxic: one term spelled right and not quoted, or as much.
        self.least = min(self.weights.values(), default=math.inf)
        self.automaton = Automaton(self.weights, self.fuzzy)
        self.stems = Automaton(self.repeated, ())

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("weights", "fuzzy", "repeated", "bias", "slope", "per_length")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def evidence(self, text: str | None) -> float:
        """Summed weight of the hits of a whole text."""
        return self.measure(text)[0]

    def measure(self, text: str | None) -> tuple[float, int]:
        """Evidence and number of words of a whole text."""
        low = (text or "").lower()
        every = SPELLED.findall(low)
        known = set(every)
        hits = {w: hit for w in known if (hit := self.automaton.look(w))}
        often = {w: hit[0] for w in known if (hit := self.stems.look(w))}
        if not hits and not often:
            return 0.0, len(every)
        total, times = 0.0, Counter()
        for m in SPELLED.finditer(low):
            hit, stem = hits.get(m[0]), often.get(m[0])
            if hit or stem:
                held = QUOTED if is_quoted(low, m.start(), m.end()) else 1.0
                if hit:
                    total += self.weights[hit[0]] * (MISSPELLED if hit[1] else 1.0) * held
                if stem:
                    times[stem] += held
        for stem, n in times.items():
            least, weight = self.repeated[stem]
            if n >= least:
                total += weight * n / least
        return total, len(every)

    def score(self, text: str | None) -> float:
        total, n = self.measure(text)
        z = self.bias + self.slope * math.log1p(total) + self.per_length * math.log1p(n) + EVEN
        chance = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
        return chance if total >= self.least else min(chance, THRESHOLD - 0.01)


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Weighted logistic regression on log evidence and log length with a small ridge: bias and slopes.

    Evidence never speaks against toxicity and length never for it.
    """

    def fitted(rows: np.ndarray) -> np.ndarray:
        beta = np.zeros(rows.shape[1])
        beta[0] = math.log((w @ y + 0.5) / (w @ (1 - y) + 0.5))
        small = ridge * np.array([0.0] + [1.0] * (len(beta) - 1))
        total = w.sum()
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
            grad = rows.T @ (w * (y - p)) / total - small * beta
            hess = (rows * (w * p * (1 - p))[:, None]).T @ rows / total + np.diag(small + 1e-9)
            step = np.linalg.solve(hess, grad)
            step *= min(1.0, 4 / max(1e-12, np.abs(step).max()))
            beta += step
            if np.abs(step).max() < 1e-9:
                break
        return beta

    ones = np.ones(len(x))
    bias, slope, per_length = fitted(np.column_stack([ones, x]))
    if per_length > 0 or slope < 0:
        (bias, slope), per_length = fitted(np.column_stack([ones, x[:, 0]])), 0.0
    return float(bias), float(max(0.0, slope)), float(per_length)


def _sketch(words: list[str]) -> tuple[int, int]:
    """Two min-hashes over word pairs: near copies share one or both nearly always."""
    pairs = [f"{a} {b}".encode() for a, b in zip(words, words[1:])] or [b" ".join(w.encode() for w in words)]
    return min(map(zlib.crc32, pairs)), min(zlib.crc32(p, 0x5EED) for p in pairs)


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, int]]:
    """The bounded training sample (settled), and how many training labels each class has."""
    usable = labels.where(
        F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1)
        & (F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS != HELD_OUT)
    ).select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    order = F.xxhash64("_id")
    parts = [usable.where(F.col("toxic") == y).orderBy(order, "_id").limit(per_class) for y in (0, 1)]
    some = F.broadcast(parts[0].union(parts[1]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.join(some, F.col("id") == F.col("_id"))
    # one row per label, however many rows repeat its id
    return settle(found.groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "text", "toxic")), counts


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``2 * per_class`` labelled rows that aren't held out.

    Of rows that repeat an id the one whose text has the smallest hash counts. Near copies in the sample count once, or one copied text's rare words would all
    look toxic. Only ids, sketches, term counts and sums come to the driver. Without
    labels of both classes the model scores everything near 0.
    """
    in_small_batches(docs.sparkSession)
    sample, counts = _sample(docs, labels, per_class, id_col, text_col)

    def sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_sketch(words_of(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([g[k] for g in got], pa.int64()) for k in (0, 1))], ["id", "toxic", "a", "b"])

    seen: set[tuple[int, int, int]] = set()
    kept: dict[int, int] = {}
    kind = sample.schema["id"].dataType.simpleString()
    for r in sorted(sample.mapInArrow(sketches, f"id {kind}, toxic int, a long, b long").collect()):
        marks = {(r["toxic"], 0, r["a"]), (r["toxic"], 1, r["b"])}
        if not marks & seen:
            kept[r["id"]] = r["toxic"]
        seen |= marks
    n = Counter(kept.values())
    if not n[0] or not n[1]:
        return Model()

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in sums], pa.string()), pa.array([n for _, n in sums], pa.int32()), *(pa.array([v[k] for v in sums.values()], pa.int64()) for k in (1, 0))], ["term", "times", "a", "b"])

        for batch in batches:
            for i, t, y in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if i in kept:
                    for term in candidate_terms(words_of(t)):
                        sums.setdefault(term, [0, 0])[y] += 1
                if len(sums) > 200_000:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    least = max(3, math.ceil(0.006 * n[1]))
    rate = F.lit(0.9) * (F.col("a") / n[1] + F.col("b") / n[0])
    terms = (
        sample.mapInArrow(tally, "term string, times int, a long, b long").groupBy("term", "times").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .where((F.col("a") >= least) & (F.col("a") / n[1] >= rate))
    )
    counted = terms.collect()
    by_times = {k: {r["term"]: (r["a"], r["b"]) for r in counted if r["times"] == k} for k in (1, *REPEATS)}
    weights = choose_terms(by_times[1], n[1], n[0], least)
    repeated: dict[str, tuple[int, float]] = {}
    for k in REPEATS:
        repeated |= {t: (k, w) for t, w in choose_terms(by_times[k], n[1], n[0], least, begun=[*weights, *repeated]).items()}

    def misspellings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, got = Automaton(weights, [(t, k) for t in weights for k in KINDS]).near, Counter()

        def counted(word: str) -> set[tuple[str, int]]:
            """What a word is near to; of long terms with an edit inside only the one that it is scored for."""
            hits = near(word)
            inside = {(t, k) for t, k in hits if k == INNER and is_long(t)}
            return hits - inside | ({min(inside)} if inside else set())

        for b in batches:
            for i, t, y in zip(*(b.column(k).to_pylist() for k in range(3))):
                if i in kept:
                    got.update((*hit, y) for hit in {hit for w in set(SPELLED.findall((t or "").lower())) for hit in counted(w)})
        keys = list(got)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[j] for k in keys], pa.int64()) for j in (1, 2)), pa.array([got[k] for k in keys], pa.int64())], ["term", "kind", "toxic", "n"])

    near = {(r["term"], r["kind"], r["toxic"]): r["s"] for r in sample.mapInArrow(misspellings, "term string, kind long, toxic long, n long").groupBy("term", "kind", "toxic").agg(F.sum("n").alias("s")).collect()}
    # a term whose near forms are ordinary words can't be looked for with an edit of that kind; where
    # they mostly are (other first letters, short terms) their rows must be as clean of them as of terms
    fuzzy = frozenset(
        (t, k) for t in weights for k in KINDS
        if near.get((t, k, 0), 0) / n[0] <= (0.5 if is_long(t) and k != FIRST else 0.02) * near.get((t, k, 1), 0) / n[1]
    )
    model = Model(weights, fuzzy, repeated)

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.measure(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], ["id", "toxic", "x", "n"])

    rows = [r for r in sorted(sample.mapInArrow(measured, f"id {kind}, toxic int, x double, n long").collect()) if r["id"] in kept]
    y = np.array([float(r["toxic"]) for r in rows])
    per = np.array([counts[int(v)] / n[int(v)] for v in y])
    model.bias, model.slope, model.per_length = _curve(np.log1p([[r["x"], r["n"]] for r in rows]), y, per)
    return model


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.7).

    Whole texts; a null or empty text scores as one without hits. Row by row, so
    repeated rows are all scored alike and an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64()), pa.array([int(s >= THRESHOLD) for s in got], pa.int32())], ["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model predicts toxic, every column as it was.

    Null and empty texts stay, as they hold no evidence. Row by row, so repeated rows go or
    stay alike and an empty table gives no rows. Only the text passes through Python, so
    other columns may have any name or type.
    """

    @F.arrow_udf("boolean")
    def is_clean(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) < THRESHOLD for t in texts], pa.bool_())

    return docs.where(is_clean(docs[f"`{text_col}`"]))
