import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import EDGES, LONG, rows
from helpers import docs as edges

from strandline.llm import lexical, personal, whitening
from strandline.llm.queries import queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    split = [(i, plain_terms(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    out = []
    for item, text in items:
        scored = []
        for i, words in split:
            score = 0
            for t in set(plain_terms(text)):
                df, tf = sum(t in w for _, w in split), words.count(t)
                if tf:
                    m = 10 + 90 * len(words) * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def listed(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_terms():
    for text in ("", "A-b C_d", "Ünï-cödé ÀB x9\x00y\x7fz", "中文 a😀b\t\r\n0"):
        assert [t.decode() for t in lexical.terms_of(text.encode())] == plain_terms(text)


@pytest.mark.parametrize("shard_postings, block_terms", [(1, 1), (7, 5), (1 << 19, 1 << 18)])
def test_search_against_brute_force(spark, shard_postings, block_terms):
    """Ties across shards, repeated rows and ids, rows without an id, long and empty texts, repeated and empty queries."""
    draw = random.Random(5)
    texts = [" ".join(draw.choice("alpha Beta gamma delta éta zeta".split()) for _ in range(draw.randint(0, 9))) for _ in range(60)]
    own = [(k % 50, t) for k, t in enumerate(texts)] + [(100 + k, "same text here") for k in range(30)] + [(None, "same text here"), (7, None), (8, ""), (9, LONG)]
    items = [(1, "alpha beta"), (2, "Same here"), (3, None), (4, "nothing knows this"), (5, "ÉTA éta zeta zeta"), (6, "word end"), (6, "delta")]
    frame = edges(spark, own).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", asked_rank())
    got = lexical.search(lexical.build(frame, shard_postings=shard_postings), asked, block_terms=block_terms)
    assert listed(got) == sorted(brute_search(own, items))


def test_a_group_of_rows_holds_one_shard(spark):
    """Spark holds a group at once, so a file's shards must not share one."""
    index = lexical.build(edges(spark, EDGES * 9).repartition(2), shard_postings=7)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.shards.inputFiles()]
    assert any(f.num_rows > 9 for f in files) and all(f.num_row_groups == f.num_rows for f in files)


def asked_rank():
    from pyspark.sql import functions as F

    return F.lit("clashes")


def test_search_of_nothing(spark):
    asked = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    none = edges(spark, EDGES).where("false")
    assert listed(lexical.search(lexical.build(none), asked)) == []
    assert listed(lexical.search(lexical.build(edges(spark, [(1, None), (2, " -- ")])), asked)) == []
    assert listed(lexical.search(lexical.build(edges(spark, EDGES)), asked.where("false"))) == []


# --- personal data ---------------------------------------------------------------------------------------------------


def brute_base(text):
    """The patterns as they are written, by plain searching."""
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub(r"\D", "", s)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15),
    }
    return ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, (p, good) in checks.items() for m in re.finditer(p, text) if good(m[0]))


def test_base_matches_against_plain_patterns():
    draw = random.Random(3)
    found = 0
    for _ in range(6000):
        text = "".join(draw.choice(["@", ".", "a", "Z9", "-", "+", " ", "1", "255", "0", "é", "(", ")", "4111 1111 1111 1111", "1.2.3.4", "x@y.zz", "+1 (826) 555-4081", "\n", "%"]) for _ in range(draw.randint(0, 14)))
        want = brute_base(text)
        assert personal.written(personal.base_spans(text)[0]) == want, text
        found += bool(want)
    assert found > 2000


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "1 " * 100_000, "a." * 100_000 + "@", "@" * 200_000, "+1" * 100_000, "1.1" * 80_000, "a@b" * 80_000):
        good, _ = personal.base_spans(text)
        assert len(personal.found_in([text], personal.Model())) == 1 and isinstance(good, list)


def windows(seed, n=1500):
    draw = random.Random(seed)
    return [" ".join("".join(draw.choice("aeionrst") for _ in range(draw.randint(2, 9))) + draw.choice(["", "", "", ",", "."]) for _ in range(60)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return personal.learn(windows(1))


def test_accuracy_on_windows_not_learned_from(model):
    x, y, _ = personal.examples(windows(2))
    chance = model.chances(x)
    for kind in range(4):
        own = x[:, 0] == kind
        taken = chance[own] >= model.least[kind]
        right = y[own] > 0
        assert (taken & right).sum() >= 0.9 * right.sum() and (taken & right).sum() >= 0.95 * taken.sum(), personal.KINDS[kind]


def test_base_spans_stay_and_clean_texts_stay_clean(model):
    for text in windows(3, 300):
        assert personal.found_in([text], model) == [([], [])]
    text = "contact: ann [at] example [dot] org or ann@example.org, tel (017) 555-7713, cards 4111111111111111 5500005555555559 end"
    base, both = personal.found_in([text], model)[0]
    assert set(base) <= set(both)
    said = {text[s:e] for _, s, e in both}
    assert {"ann@example.org", "ann [at] example [dot] org", "(017) 555-7713", "4111111111111111", "5500005555555559"} <= said


def test_spans_of_edges(spark, model):
    own = [*EDGES, (20, "mail me@example.org"), (20, "mail me@example.org"), (21, "😀 10.0.0.1")]
    got = rows(personal.spans_table(edges(spark, own), model))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["spans"]) for r in got) == sorted((i is None, i or 0, brute_base(t or "")) for i, t, *_ in own)
    assert {r["base_sha256"] for r in got if not r["spans"]} == {"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}
    assert rows(personal.spans_table(edges(spark, own).where("false"), model)) == []
    clean = {r["doc_id"]: r["text"] for r in rows(personal.redact(edges(spark, own), model))}
    assert clean[20] == "mail [email]" and clean[21] == "😀 [ip]" and clean[3] is None and clean[4] == ""


def test_learning_from_nothing(spark):
    none = personal.fit(edges(spark, [(1, None), (2, "")]))
    assert none.least == (None,) * 4
    assert personal.written(personal.found_in(["a@b.cd (017) 555-7713"], none)[0][1]) == "email:0:6"


# --- whitening -----------------------------------------------------------------------------------------------------------


def vectors(spark, own, parts=4):
    return spark.createDataFrame(own, "vec_id long, embedding array<float>").withColumns({c: asked_rank() for c in ("id", "n", "whitened", "component", "a.b", "v")}).repartition(parts)


def brute_whitening(own):
    x = np.floor(1024 * np.array([v for _, v in own], np.float32).astype(float)).astype(np.int64) + 100_000
    c = x - x.mean(axis=0)
    e, axes = np.linalg.eigh(c.T @ c / len(x))
    e, axes = e[::-1][:8], axes[:, ::-1][:, :8]
    dev = [sum(int(v) ** 2 for v in r) for r in (len(x) * x.astype(object) - x.sum(axis=0))]
    return e, c @ axes / np.sqrt(e), dev, np.trace(c.T @ c / len(x))


@pytest.mark.parametrize("size, parts, fan", [(64, 9, 2), (5, 3, 16), (12, 1, 2)])
def test_whitening_against_a_dense_solution(spark, size, parts, fan, monkeypatch):
    rng = np.random.default_rng(4)
    own = [(k, (rng.normal(size=size) * np.linspace(1, 3, size)).tolist()) for k in range(300)]
    monkeypatch.setattr(whitening.fit, "__defaults__", (*whitening.fit.__defaults__[:-1], fan))
    got = rows(whitening.components_table(vectors(spark, own, parts)))
    e, white, dev, trace = brute_whitening(own)
    assert len(got) == len(own) * min(8, size)
    for r in got:
        k, j = r["vec_id"], r["component"] - 1
        assert abs(abs(r["whitened"]) - abs(white[k, j])) < 1e-9 and r["deviation"] == dev[k] and r["n"] == 300
        assert abs(r["explained"] / (e[j] / trace) - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_what_whitening_leaves_out(spark):
    rng = np.random.default_rng(1)
    good = [(k, rng.normal(size=3).tolist()) for k in range(40)] + [(7, [0.5, 0.25, 1.0]), (7, [0.5, 0.25, 1.0]), (None, [1.0, 2.0, 3.0])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [math.nan, 1.0, 1.0]), (53, [1.0, -math.inf, 1.0]), (54, [1.0]), (55, [])]
    got = rows(whitening.components_table(vectors(spark, good + bad)))
    assert len(got) == 3 * len(good) and {r["vec_id"] for r in got} == {i for i, _ in good} and {r["n"] for r in got} == {len(good)}


def test_whitening_without_variance(spark):
    for own in ([], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(9)], [(1, None)]):
        df = whitening.components_table(vectors(spark, own))
        assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and rows(df) == []
    flat = rows(whitening.components_table(vectors(spark, [(k, [float(k), 2.0 * k, 5.0]) for k in range(20)])))
    assert {r["component"] for r in flat} == {1} and flat[0]["identity_error"] < 1e-9


def test_summaries_merge_without_loss():
    rng = np.random.default_rng(2)
    x = whitening.steps(rng.normal(size=(500, 16)))
    parts = [whitening.summary(p) for p in np.split(x, [1, 3, 200, 201])]
    for order in (parts, parts[::-1]):
        held = order[0]
        for p in order[1:]:
            held = whitening.merged(held, p)
        c = x - x.mean(axis=0)
        assert held.n == 500 and held.sums == x.sum(axis=0).tolist() and np.abs(held.root.T @ held.root - c.T @ c).max() < 1e-12 * np.abs(c.T @ c).max()


def test_deviations_are_exact():
    x = whitening.steps(np.array([[3.4e38, 1.0], [-3.4e38, 2.0]]))
    s = whitening.summary(x)
    d = whitening.deviations(x, 10**9, [10**9 * v for v in s.sums])
    assert d.dtype == object and whitening._squares(d) == [None, None]
    assert whitening._squares(np.array([[3, 4]])) == [25] and whitening._squares(np.array([[3 * 10**9, 1]])) == [9 * 10**18 + 1]


def test_whole_tables_are_registered():
    assert {"op11_lexical_search", "op12_pii", "op13_whitening"} <= set(queries())
