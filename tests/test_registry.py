import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from strandline.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    if name not in registry.oracle_sql():
        assert got
        return
    found = duck.execute(registry.oracle_sql()[name])
    at = {d[0]: k for k, d in enumerate(found.description)}
    assert sorted(at) == names
    want = sorted((tuple(plain(r[at[n]]) for n in names) for r in found.fetchall()), key=repr)
    assert got == want


def test_kernel_mask_equals_the_relational_one(spark):
    """Two tiers, one result: the rectangle of every frame lies on the recovered body."""
    rows = registry.queries()["px_inscribe"](spark, str(DATA)).collect()
    assert all(r["rect_width"] == pytest.approx(2 * r["rect_height"], abs=1e-5) for r in rows if r["rect_width"] is not None)
    assert sorted(r["f"] for r in rows if r["rect_width"] is None) == [9, 19]
    assert len(rows) == spark.read.parquet(f"{DATA}/nation.parquet").count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
