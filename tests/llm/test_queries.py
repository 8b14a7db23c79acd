import hashlib
import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from helpers import EDGES, rows
from helpers import docs as edges

import corpus_pipeline
from strandline.llm import bpe, exact_dedup, mixing, queries, simhash, sql, toxicity
from strandline.llm.common import settle, table

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, str(DATA))
    names = sorted(df.columns)
    found = c.execute(sql.oracle_sql()[name])
    at = {d[0]: k for k, d in enumerate(found.description)}
    assert sorted(at) == names
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr) == sorted((tuple(plain(r[at[n]]) for n in names) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql()) - {"op6_licenses", "op13_whitening"}))
def test_query_has_a_row_per_document(spark, name):
    got = queries.queries()[name](spark, str(DATA))
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(r["doc_id"] for r in table(spark, str(DATA), "documents").select("doc_id").collect())


def test_whitening_of_the_whole_table(spark):
    got = rows(queries.queries()["op13_whitening"](spark, str(DATA)))
    own = table(spark, str(DATA), "embeddings").orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r["embedding"] for r in own], np.float32).astype(float)) + 100_000
    c = x - x.mean(axis=0)
    e, axes = np.linalg.eigh(c.T @ c / len(x))
    white = np.abs(c @ axes[:, ::-1][:, :8] / np.sqrt(e[::-1][:8]))
    place = {r["vec_id"]: k for k, r in enumerate(own)}
    assert len(got) == 8 * len(own) and all(abs(abs(r["whitened"]) - white[place[r["vec_id"]], r["component"] - 1]) < 1e-8 and r["identity_error"] < 1e-4 for r in got)


@pytest.mark.parametrize("sf, recall, wrong", [("sf0.01", 0.83, 0), ("sf0.1", 0.93, 1)])
def test_toxicity_on_held_out_labels(spark, sf, recall, wrong):
    """The shares that the README states, on labels of rows that nothing was learned from."""
    folder = str(DATA.parent / sf)
    told = {r["doc_id"]: r for r in rows(queries.queries()["op10_toxicity"](spark, folder)) if r["held_out"]}
    labels = [(told[r["doc_id"]]["predicted"], r["toxic"]) for r in rows(table(spark, folder, "labels")) if r["doc_id"] in told and r["toxic"] is not None]
    toxic = [p for p, y in labels if y == 1]
    assert sum(toxic) >= recall * len(toxic) and sum(p for p, y in labels if y == 0) <= wrong


def test_personal_data_of_the_whole_table(spark):
    """Base matches by the plain patterns, and no base span missing among all."""
    from test_search_personal_whitening import brute_base

    texts = {r["doc_id"]: r["text"] or "" for r in rows(table(spark, str(DATA), "documents"))}
    found = 0
    for r in rows(queries.queries()["op12_pii"](spark, str(DATA))):
        base = brute_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [base.count(f"{k}:") for k in ("email", "ip", "card", "phone")]
        found += bool(base)
    assert found


def test_pipeline_against_brute_force(spark):
    """Each stage by its plain definition, one after the other."""
    docs = {r["doc_id"]: r for r in rows(table(spark, str(DATA), "documents"))}
    model = toxicity.fit(table(spark, str(DATA), "documents"), table(spark, str(DATA), "labels"))
    left = {i: r for i, r in docs.items() if model.score(r["text"]) < toxicity.THRESHOLD}
    last = {}
    for i, r in left.items():
        last[r["text"]] = max(i, last.get(r["text"], i))
    left = {i: left[i] for i in last.values()}
    form = simhash.Wide().fitted(len(left))
    prints = {i: simhash.print_of(r["text"], form.shingle, form.width) for i, r in left.items()}
    keys = {i: set(enumerate(form.keys(np.frombuffer(p, ">u8").astype(np.uint64)[None])[0].tolist())) for i, p in prints.items()}
    label = {i: i for i in left}
    near = {(i, j) for i in left for j in left if (int.from_bytes(prints[i]) ^ int.from_bytes(prints[j])).bit_count() <= form.bits and keys[i] & keys[j]}
    changed = True
    while changed:
        changed = False
        for i in left:
            for j in left:
                if (i, j) in near and label[j] < label[i]:
                    label[i], changed = label[j], True
    left = {i: r for i, r in left.items() if label[i] == i}
    frame = spark.createDataFrame(list(left.values()), table(spark, str(DATA), "documents").schema)
    copies = {r["doc_id"]: r["copies"] for r in rows(mixing.mix(frame))}
    with bpe.encoder(*queries.vocabulary()) as enc:
        want = sorted((i, enc.encode(r["text"])) for i, r in left.items() for _ in range(copies[i]))
    got = rows(corpus_pipeline.run(spark, str(DATA)))
    assert sorted((r["doc_id"], r["ids"]) for r in got) == want and all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert len(want) > 100


def test_stages_stand_edges(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing columns, an empty table."""
    for df in (edges(spark, EDGES), edges(spark, EDGES).where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, str(DATA))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == df.columns, name
            df = settle(out)
        assert "ids" in df.columns


def test_stages_keep_the_columns(spark):
    docs = table(spark, str(DATA), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.columns == docs.columns, name
    assert exact_dedup.drop_copies(docs).count() < docs.count()
