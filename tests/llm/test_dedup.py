import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from helpers import EDGES, LONG, docs, rows
from pyspark.sql import functions as F

from strandline.llm import common, exact_dedup, line_dedup, simhash
from strandline.llm.components import components


def brute_exact(data):
    groups = defaultdict(list)
    for i, t in data:
        groups[t or ""].append(i)
    out = []
    for i, t in data:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep if len(g) > 1 else i, len(g), i == keep if len(g) > 1 else True))
    return Counter(out)


@pytest.mark.parametrize("most_bytes", [0, None])
def test_exact_edges_and_brute_force(spark, most_bytes):
    """With a filter of the survivors and without one."""
    rng = random.Random(1)
    data = [r[:2] for r in EDGES] + [(i, rng.choice("abcd") * rng.randint(0, 3)) for i in range(100, 200)] + [(300, LONG), (301, LONG[:-1] + "D")]
    df = docs(spark, data)
    got = rows(exact_dedup.exact_groups(df, most_bytes=most_bytes, carry={"sha": F.sha2(F.coalesce("text", F.lit("")), 256)}))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == brute_exact(data)
    assert {r["sha"] for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in data}


def test_exact_empty_and_dropping(spark):
    df = docs(spark, EDGES)
    assert exact_dedup.exact_groups(df.where(F.lit(False))).count() == 0
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    # of repeats of a kept row one stays, and rows without an id go as a row with one has their text
    assert sorted((r["doc_id"] or 0) for r in rows(kept)) == [2, 4, 5, 6, 7, 8, 9]


def test_dropping_goes_by_row_where_ids_repeat(spark):
    data = [(5, "a"), (9, "a"), (5, "b"), (5, "b"), (None, "c"), (None, "c"), (None, "d"), (3, "d"), (4, "e"), (4, "f")]
    df = docs(spark, data)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and kept.schema == df.schema
    assert Counter((r["doc_id"], r["text"]) for r in rows(kept)) == Counter([(9, "a"), (5, "b"), (None, "c"), (3, "d"), (4, "e"), (4, "f")])
    assert exact_dedup.drop_copies(df.where(F.lit(False))).count() == 0


def brute_fingerprint(text):
    words = [bytes(w) for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    rng = random.Random(2)
    for n in (0, 1, 3, 4, 5, 60):
        text = "\t".join(rng.choice(["A", "b", "É", "c,", "İ"]) for _ in range(n))
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def brute_components(nodes):
    """nodes: (id, fp); the smallest id reachable over links of at most four bits."""
    label = {i: i for i, _ in nodes}
    changed = True
    while changed:
        changed = False
        for i, a in nodes:
            for j, b in nodes:
                if (a ^ b).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near_fingerprints(n, seed=3):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        a = rng.choice(out)
        for _ in range(rng.randint(1, 6)):
            a ^= 1 << rng.randrange(64)
        out.append(a)
    return sorted(set(out))


@pytest.mark.parametrize("chunk, blocks", [(3, None), (16_384, None), (16_384, 8)])
def test_links_lose_nothing(spark, chunk, blocks):
    """Also where every key is dealt out in chunks."""
    fps = near_fingerprints(240)
    nodes = list(enumerate(fps))
    df = spark.createDataFrame([(f.to_bytes(8, "big"), i) for i, f in nodes], "fp binary, node long")
    roots = {r["node"]: r["root"] for r in rows(components(simhash.links(df, simhash.Narrow(blocks=blocks), chunk=chunk)))}
    assert {i: roots.get(i, i) for i, _ in nodes} == brute_components(nodes)


def test_forest_spans_every_group():
    fps = np.array(near_fingerprints(300, 5), np.uint64)
    a, b = simhash.forest(fps[:, None])
    assert (np.bitwise_count(fps[a] ^ fps[b]) <= 4).all()
    label = list(range(len(fps)))
    for x, y in zip(a.tolist(), b.tolist()):
        old, new = max(label[x], label[y]), min(label[x], label[y])
        label = [new if v == old else v for v in label]
    assert dict(enumerate(label)) == brute_components([(i, int(f)) for i, f in enumerate(fps)])
    assert len(a) == len(fps) - len(set(label))


def test_near_duplicates_edges(spark):
    base = " ".join(f"w{i}" for i in range(400))
    data = [r[:2] for r in EDGES] + [(20, base), (21, base.replace("w200", "changed")), (22, base.upper()), (23, " ".join(reversed(base.split())))]
    df = docs(spark, data)
    got = rows(simhash.near_duplicates(df))
    assert len(got) == len(data)
    want = brute_components([(i, brute_fingerprint(t)) for i, t in data if i is not None])
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]
    assert Counter(r["fingerprint"] for r in got) == Counter(f"{brute_fingerprint(t):016x}" for _, t in data)
    kept = simhash.drop_near_copies(df, form=simhash.Narrow())
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in rows(kept)} == {None, *want.values()}
    assert simhash.near_duplicates(df.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("most_bytes", [0, common.MOST_FILTER_BYTES])
def test_near_copies_go_by_row_where_ids_repeat(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(common, "MOST_FILTER_BYTES", most_bytes)
    x, y, z = (" ".join(f"{c}{i}" for i in range(400)) for c in "xyz")
    # id 2 has a near copy of id 1's text and one of its own, with a near copy at id 3; id 4 has two near texts and a repeated row
    data = [(1, x), (2, x.upper()), (2, y), (3, y.upper()), (4, z), (4, z.upper()), (4, z), (None, x), (5, None), (5, ""), (5, "other words"), (5, "other words")]
    df = docs(spark, data)
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and kept.schema == df.schema
    got = Counter((r["doc_id"], r["text"] and r["text"].lower()) for r in rows(kept))
    empty = [t for i, t in got if i == 5 and not t]
    assert len(empty) == 1 and got == Counter([(1, x), (2, y), (4, z), (None, x), (5, empty[0]), (5, "other words")])
    assert simhash.drop_near_copies(df.where(F.lit(False))).count() == 0


def test_ids_link_nothing_and_keep_their_type(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(100)) for c in "xy")
    data = [("2", x), ("5", x), ("5", y), ("9", y)]
    got = rows(simhash.near_duplicates(spark.createDataFrame(data, "doc_id string, text string")))
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [("2", "2"), ("5", "2"), ("5", "5"), ("9", "5")]
    assert len(rows(simhash.drop_near_copies(spark.createDataFrame(data, "doc_id string, text string")))) == 2


def shingles5(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_wide_form_finds_pairs_of_a_similarity_of_four_fifths(spark):
    """Recall against all pairs by their five-word shingles, and no link between unrelated texts."""
    rng = random.Random(9)
    data, similar = [], []
    for i in range(0, 400, 2):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(80, 400))]
        other = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 45))):
            other[rng.randrange(len(words))] = "changed"
        data += [(i, " ".join(words)), (i + 1, " ".join(other))]
        a, b = shingles5(data[-2][1]), shingles5(data[-1][1])
        if len(a & b) / len(a | b) >= 0.8:
            similar.append(i)
    got = {r["doc_id"]: r["component_id"] for r in rows(simhash.near_duplicates(docs(spark, data), form=simhash.Wide()))}
    assert all(c in (i, i - i % 2) for i, c in got.items())
    assert len(similar) > 100 and sum(got[i + 1] == i for i in similar) >= 0.9 * len(similar)


def test_keys_follow_the_number_of_fingerprints():
    assert [simhash.Narrow().fitted(n).blocks for n in (0, 1 << 20, 1 << 34, 1 << 40)] == [6, 6, 7, 8]
    assert [simhash.Wide().fitted(n).part for n in (0, 1 << 20, 1 << 30, 1 << 40)] == [16, 16, 22, 32]
    few, many = simhash.Wide().fitted(10), simhash.Wide().fitted(1 << 30)
    assert few.n_keys < many.n_keys
    fps = np.random.default_rng(1).integers(0, 1 << 63, (50, 4)).astype(np.uint64)
    assert (few.keys(fps) < 1 << 16).all() and few.keys(fps).shape == (50, few.n_keys)
    # a fingerprint without differing bits shares every key, one with a bit more nearly every one
    other = fps.copy()
    other[:, 2] ^= np.uint64(1)
    assert ((few.keys(fps) != few.keys(other)).sum(axis=1) <= few.n_keys // 16 + 1).all()


def test_filter_tells_what_it_holds(spark):
    keys = spark.range(0, 50_000).select((F.col("id") * 7).alias("k"))
    held = common.Filter.of(keys, F.col("k"))
    tested, hit = held.test(spark.range(0, 350_000), F.col("id"))
    got = {r["m"]: (r["n"], r["y"]) for r in tested.groupBy((F.col("id") % 7 == 0).alias("m")).agg(F.count("*").alias("n"), F.sum(hit.cast("int")).alias("y")).collect()}
    assert got[True] == (50_000, 50_000) and got[False][1] < 0.02 * got[False][0]
    assert common.Filter.of(keys, F.col("k"), 1 << 15) is None


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5), (1, 0)]
    got = {r["node"]: r["root"] for r in rows(components(spark.createDataFrame(edges, "u long, v long")))}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 50)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_runs(data):
    """Every run of two lines or more, of any length, that stands earlier, by its plain definition."""
    data = sorted(set(data), key=lambda r: (r[0] is None, r[0] or 0))
    places = [(d, a, (t or "").split("\n")) for d, (_, t) in enumerate(data) for a in range(len((t or "").split("\n")))]
    first, gone = {}, defaultdict(set)
    for d, a, ls in places:
        for n in range(2, len(ls) - a + 1):
            run = tuple(ls[a : a + n])
            e, b = first.setdefault(run, (d, a))
            if (e, b) != (d, a) and (e != d or b + n <= a):
                gone[d] |= set(range(a, a + n))
    return {r: "\n".join(x for k, x in enumerate((r[1] or "").split("\n")) if k not in gone[d] or r[0] is None) for d, r in enumerate(data)}


def test_line_dedup_finds_every_repeated_run(spark):
    """Also runs of two lines, among other neighbours each time, and exact copies of whole documents."""
    rng = random.Random(6)
    passages = [[f"passage {p} line {k}" for k in range(rng.randint(2, 5))] for p in range(15)]
    data = []
    for i in range(40):
        ls = []
        for p in rng.sample(passages, 3):
            ls += [*(f"own {i} {rng.random()}" for _ in range(rng.randint(1, 3))), *p]
        data.append((i, "\n".join(ls)))
    data += [(200 + i, t) for i, t in data[:5]]  # copies
    data += [(300, "b\nc\nd\ne"), (301, "a\nb\nc\nx\nd\ne"), (302, "a\na\na\na\na"), (303, "x\na\na\na"), (304, "\n\n\n"), (305, ""), (306, None), (307, "one"), (308, "one\n"), (309, "one\n")]
    data += [(None, "b\nc"), (310, "q\nr\ns"), (310, "t\nb\nc\nu"), (310, "q\nr\ns"), (311, "b\nc")]
    got = rows(line_dedup.drop_repeated_runs(docs(spark, data)))
    want = brute_runs(data)
    assert Counter((r["doc_id"], r["clean_text"]) for r in got) == Counter((i, want[i, t]) for i, t in data)
    by = {r["doc_id"]: r for r in got}
    assert all(by[200 + i]["clean_text"] == "" for i in range(5))
    assert [by[i]["clean_text"] for i in (301, 302, 303, 308, 309, 311)] == ["a\nx", "a\na", "x", "one\n", "", ""]
    assert (by[301]["n_lines"], by[301]["n_removed_lines"], by[301]["n_removed_chunks"]) == (6, 4, 2)
    assert line_dedup.drop_repeated_runs(docs(spark, data).where(F.lit(False))).count() == 0


def test_line_dedup_of_very_long_texts(spark):
    """Tens of thousands of lines, all of them repeated but one in the middle, and one line of megabytes."""
    lines = [f"line {k} {k * 7919 % 1000}" for k in range(40_000)]
    changed = [*lines[:20_000], "another", *lines[20_001:]]
    data = [(1, "\n".join(lines)), (2, "\n".join(changed)), (3, LONG * 10), (4, LONG * 10 + "\n" + LONG * 10)]
    got = {r["doc_id"]: r for r in rows(line_dedup.drop_repeated_runs(docs(spark, data)))}
    assert got[2]["clean_text"] == "another" and got[2]["n_removed_chunks"] == 2
    assert all(got[i]["n_removed_lines"] == 0 for i in (1, 3, 4))


def test_the_query_removes_every_repeated_run(spark):
    from pathlib import Path

    from strandline.llm import queries
    from strandline.llm.common import table

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    data = [(r["doc_id"], r["text"]) for r in rows(table(spark, folder, "documents"))]
    want = {i: hashlib.sha256(t.encode()).hexdigest() for (i, _), t in brute_runs(data).items()}
    assert {r["doc_id"]: r["clean_sha256"] for r in rows(queries.op9_line_dedup(spark, folder))} == want
