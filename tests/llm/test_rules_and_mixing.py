import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from helpers import EDGES, LONG, docs, rows
from pyspark.sql import functions as F

from strandline.llm import mixing, quality


def brute_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if windows[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics_match_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab #|é\n\t\x0b "), 80)) for _ in range(60)]
    texts += ["a b c a b c", "a a a a", "a b a b a b", "x y z", "a b c d", "l1\nl1\n \n \nl2\nl1"]
    data = [r[:2] for r in EDGES if r[0] != 6] + list(enumerate(texts, 100)) + [(6, "w1 w2 w3 w4 " * 2_000)]
    got = Counter((r["doc_id"], *(r[n] for n in NAMES)) for r in rows(quality.text_stats(docs(spark, data))))
    assert got == Counter((i, *brute_stats(t)) for i, t in data)


def test_base_rule(spark):
    data = [(1, " ".join(f"w{i}" for i in range(50))), (2, " ".join(f"w{i}" for i in range(49))), (3, "a b c " * 40), (4, None)]
    assert {r["doc_id"]: r["base_failed"] for r in rows(quality.text_stats(docs(spark, data)))} == {1: False, 2: True, 3: True, 4: True}


def test_covering_finds_a_conjunction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(quality.FEATURES)))
    low = (x[:, 2] > 0.7) & (x[:, 4] < 0.4) | (x[:, 0] < 0.05)
    rules = quality.learn_rules(x, low)
    said = np.zeros(len(x), bool)
    for r in rules:
        said |= quality._mask(x, quality.FEATURES, r.terms)
    assert len(rules) >= 2 and (said == low).mean() > 0.97
    assert quality.learn_rules(x[:0], low[:0]) == []
    assert quality.learn_rules(x, np.zeros(3000, bool)) == []
    assert quality.learn_rules(x, rng.random(3000) < 0.3, min_precision=0.95) == []


def test_learned_list_holds_on_rows_it_did_not_see(spark):
    rng = np.random.default_rng(3)
    data, labels = [], []
    for i in range(400):
        junk = i % 4 == 0
        data.append((i, " ".join(f"w{rng.integers(1e6)}" + ("#$%" if junk else "") for _ in range(60))))
        labels.append((i, int(not junk), 0))
    df = docs(spark, data)
    table = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality.fit(df, table.where("doc_id < 200 or doc_id is null"))
    got = {r["doc_id"]: r["kept"] for r in rows(quality.judge(df, rules))}
    assert all(got[i] == (i % 4 != 0) for i in range(400))
    assert quality.fit(df, table.where("false")) == [] and quality.judge(df.where("false"), rules).count() == 0
    assert all(r["kept"] for r in rows(quality.judge(df, [])))


def test_the_query_against_brute_force(spark):
    """Every verdict of the table from the learned list's terms, applied one by one to statistics counted in Python."""
    from strandline.llm import queries

    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    documents, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rules = quality.fit(documents, labels)
    assert rules
    want = {}
    for r in rows(documents):
        n, chars, symbols, dup, repeat = stats = brute_stats(r["text"])
        of = dict(zip(quality.FEATURES, (n, *(v / max(n, 1) for v in (chars, symbols, dup, repeat)))))
        failed = n < 50 or 100 * repeat > 50 * n
        hit = any(all(of[name] >= at if op == ">=" else of[name] < at for name, op, at in rule.terms) for rule in rules)
        want[r["doc_id"]] = (*stats, failed, not failed and not hit)
    got = {r["doc_id"]: (*(r[n] for n in NAMES), r["base_failed"], r["kept"]) for r in rows(queries.op2_quality_rules(spark, folder))}
    assert got == want


def brute_targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        part = {s: left * w[s] / sum(w[f] for f in free) for s in free} if free else {}
        over = [s for s in free if part[s] > most * sizes[s]]
        if not over:
            return {**full, **part}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 500, "c": 3, "d": 700, None: 50}, {"a": 5}, {"a": 0, "b": 0}, {"é": 3, "z": 4, "Z": 900}])
def test_targets_match_the_sharing_process(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in rows(mixing.source_targets(df))}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_and_emit(spark):
    data = [(i, "w " * (i % 7 + 1), "abc"[i % 3]) for i in range(3000)] + [(5000, None, "a"), (None, "x y", None), (5001, "", None), (5002, "p q", None), (5002, "p q", None)]
    df = docs(spark, data)
    got = rows(mixing.mix(df))
    assert len(got) == len(data)
    taken, target = Counter(), {}
    source = {i: s for i, _, s in data}
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] in {0, r["size"], 2 * r["size"]} and r["size"] == len((dict((i, t) for i, t, _ in data)[r["doc_id"]] or "").split())
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] + 4 for s in target)
    assert Counter(map(str, rows(mixing.mix(df)))) == Counter(map(str, got))
    out = mixing.emit(df)
    assert out.columns == df.columns
    copies = Counter(r["doc_id"] for r in rows(out))
    per = Counter()
    for r in got:
        per[r["doc_id"]] += r["copies"]
    assert copies == +per
    assert mixing.mix(df.where(F.lit(False))).count() == 0 and mixing.emit(df.where(F.lit(False))).count() == 0


def test_uniform_numbers(spark):
    u = [r["u"] for r in rows(spark.range(4000).select(mixing.uniform(F.col("id")).alias("u")))]
    assert 0 <= min(u) and max(u) < 1 and np.mean(u) == pytest.approx(0.5, abs=0.02)


def test_every_source_of_the_table_comes_near_its_target(spark):
    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    got = mixing.mix(documents).join(documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert all(abs(r["taken"] - r["target"]) <= 0.05 * r["target"] for r in rows(got))


def test_mixing_stands_very_long_texts_and_clashing_names(spark):
    df = docs(spark, [(i, LONG if i == 3 else "w " * i, "ab"[i % 2]) for i in range(40)])
    got = {r["doc_id"]: r for r in rows(mixing.mix(df))}
    assert got[3]["size"] == 30_001 and got[3]["taken"] in (0, 30_001, 60_002)
    out = rows(mixing.emit(df))
    assert Counter(r["doc_id"] for r in out) == +Counter({i: r["copies"] for i, r in got.items()})
    assert all(r["copies"] == r["_row"] == r["a.b"] == 7 for r in out)


def test_labelled_ids_that_repeat_count_once(spark):
    """However many rows repeat a labelled id, the sample has one of them, the same on every run."""
    rng = np.random.default_rng(6)
    good = [" ".join(f"w{rng.integers(0, 5000)}" for _ in range(80)) for _ in range(40)]
    bad = [" ".join("#$" if k % 3 else f"w{rng.integers(0, 5000)}" for k in range(80)) for _ in range(40)]
    own = list(enumerate(good + bad)) + [(1, t) for t in bad] * 5
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(80)], "doc_id long, quality int")
    frame = docs(spark, own)
    rules = quality.fit(frame.repartition(7), labels)
    assert rules and rules == quality.fit(frame.repartition(3), labels)
    assert sum(r.covered for r in rules) <= 80
