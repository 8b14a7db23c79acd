"""Quality rules: text statistics and a learned decision list, built-in functions only.

The statistics are array expressions over the words of one row, so nothing is
shuffled. The list is learned by sequential covering on a bounded sample of
labelled rows: a rule is grown as a conjunction of thresholds by information gain
on one part of the sample, pruned on the other, emitted, and the rows it covers
leave. The emitted list is one ordered CASE expression over the statistics.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_characters, words

#: Most labelled rows that the list is learned from, taken in the order of a hash of the id.
SAMPLE_ROWS = 6_000
BASE_MIN_WORDS = 50
NOT_BLANK = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are sorted by hash, so equal ones are neighbours; the start positions of
    those with an equal neighbour, in order, each cover up to three words of their own.
    """

    def windows(hs: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hs) - 3),
            lambda i: F.xxhash64(F.get(hs, i), F.get(hs, i + 1), F.get(hs, i + 2)),
        )

    def starts(ws: Column) -> Column:
        return F.array_sort(F.transform(
            F.filter(ws, lambda x, k: (F.get(ws, k - 1)["h"] == x["h"]) | (F.get(ws, k + 1)["h"] == x["h"])),
            lambda x: x["i"],
        ))

    def covered(at: Column) -> Column:
        steps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
        return F.when(F.size(at) > 0, F.aggregate(steps, F.lit(3), lambda n, x: n + x)).otherwise(F.lit(0))

    def count(ws: Column) -> Column:
        # a hash set tells texts that repeat no window, and for them nothing is sorted
        unique = F.size(F.array_distinct(ws)) == F.size(ws)
        placed = F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(unique, F.lit(0)).otherwise(_let(F.array_sort(placed), lambda s: _let(starts(s), covered)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= 4, _let(hashes, lambda hs: _let(windows(hs), count))).otherwise(F.lit(0))


def text_stats(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and the base statistics of every row; a null text has none of anything.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) and
    ``base_failed``: under 50 words, or more than half of the words repeated.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(NOT_BLANK))
    measured = docs.select(
        *[F.col(c) for c in keep],
        _let(words(text), lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            _repeat_words(ws).cast("long").alias("n_repeat_words"),
        )).alias("_s"),
        count_characters(text, SYMBOLS).alias("n_symbols"),
        _let(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")).alias("n_dup_lines"),
    )
    flat = measured.select(*keep, F.col("_s.n_words"), F.col("_s.word_chars"), "n_symbols", "n_dup_lines", F.col("_s.n_repeat_words"))
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return flat.withColumn("base_failed", failed)


def features() -> dict[str, Column]:
    """Rates that rules put thresholds on, from the columns of ``text_stats``."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / n,
        "symbol_rate": F.col("n_symbols") / n,
        "dup_line_rate": F.col("n_dup_lines") / n,
        "repeat_rate": F.col("n_repeat_words") / n,
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction: ``terms`` are (feature, ">=" or "<", threshold); covered rows are low quality."""

    terms: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def column(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, at in self.terms:
            out = out & (columns[name] >= at if op == ">=" else columns[name] < at)
        return out


def _mask(x: np.ndarray, names: Sequence[str], terms) -> np.ndarray:
    m = np.ones(len(x), bool)
    for name, op, at in terms:
        v = x[:, names.index(name)]
        m &= v >= at if op == ">=" else v < at
    return m


def _best_term(x: np.ndarray, bad: np.ndarray, names: Sequence[str]):
    """The threshold with the largest FOIL gain over the rows that the rule covers now."""
    p0, n0 = bad.sum(), len(bad)
    base = math.log2(p0 / n0)
    best = (1e-9, None)
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v, b = x[order, j], bad[order]
        cut = np.flatnonzero(v[1:] != v[:-1]) + 1
        if not len(cut):
            continue
        low_p = np.cumsum(b)[cut - 1].astype(float)
        for op, p, n in (("<", low_p, cut.astype(float)), (">=", p0 - low_p, n0 - cut.astype(float))):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / n) - base), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (name, op, float((v[cut[k] - 1] + v[cut[k]]) / 2)))
    return best[1]


def learn_rules(
    x: np.ndarray,
    low: np.ndarray,
    names: Sequence[str] = FEATURES,
    min_precision: float = 0.8,
    min_covered: int = 5,
    max_rules: int = 12,
    max_terms: int = 4,
) -> list[Rule]:
    """Sequential covering with grow and prune parts (two rows of three grow, one prunes)."""
    x, low = np.asarray(x, float).reshape(-1, len(names)), np.asarray(low, bool)
    left, rules = np.ones(len(low), bool), []
    part = np.arange(len(low)) % 3 < 2
    while len(rules) < max_rules:
        grow, prune = left & part, left & ~part
        terms: list[tuple[str, str, float]] = []
        now = grow.copy()
        while len(terms) < max_terms and low[now].any() and not low[now].all():
            term = _best_term(x[now], low[now], names)
            if term is None:
                break
            terms.append(term)
            now &= _mask(x, names, [term])
        if not terms:
            break

        def worth(ts) -> float:
            m = prune & _mask(x, names, ts)
            return (low[m].sum() - (~low[m]).sum()) / max(1, m.sum())

        while len(terms) > 1 and worth(terms[:-1]) >= worth(terms):
            terms.pop()
        hit = left & _mask(x, names, terms)
        good = low[hit].mean() if hit.any() else 0.0
        if hit.sum() < min_covered or good < min_precision:
            break
        rules.append(Rule(tuple(terms), float(good), int(hit.sum())))
        left &= ~hit
    return rules


def verdict(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(kept, rule number) as ordered conditional expressions; 0 is base_failed, null no rule."""
    columns = features()
    kept, number = F.when(F.col("base_failed"), F.lit(False)), F.when(F.col("base_failed"), F.lit(0))
    for k, rule in enumerate(rules, 1):
        kept, number = kept.when(rule.column(columns), F.lit(False)), number.when(rule.column(columns), F.lit(k))
    return kept.otherwise(F.lit(True)), number


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn rules from at most ``sample_rows`` labelled rows with ``doc_id, quality``.

    Rows without a label or an id are not used; no labels give no rules. Of rows that
    repeat an id the one whose text has the smallest hash counts. The sample is bounded, so
    its ids may be broadcast and its statistics collected.
    """
    some = (
        labels.where("doc_id is not null and quality is not null")
        .select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = docs.select("doc_id", "text")
    found = rows.join(F.broadcast(some), rows["doc_id"] == some["_id"]).withColumn("_h", F.xxhash64("text"))
    stats = text_stats(found, keep=("doc_id", "_q", "_h"))
    named = features()
    # base_failed is looked at here: as a filter it would be pushed below the join and computed for every row
    row = F.struct("_h", *[named[n].alias(n) for n in FEATURES], "base_failed")
    labelled = stats.groupBy("doc_id", "_q").agg(F.min(row).alias("r")).select("doc_id", "_q", *[f"r.{n}" for n in FEATURES], "r.base_failed").collect()
    table = sorted(tuple(r[:-1]) for r in labelled if not r["base_failed"])
    if not table:
        return []
    return learn_rules(np.array([r[2:] for r in table]), np.array([r[1] == 0 for r in table]))


def judge(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The statistics, ``kept`` and the number of the rule that rejected, of every row."""
    kept, number = verdict(rules)
    return text_stats(docs).withColumns({"kept": kept, "rule": number})
