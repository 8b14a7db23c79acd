import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandline.operators import graph, kernels, runs
from strandline.operators import pixels as px


def table(spark, path, masks):
    """Pixel rows of masks by name, read from a file."""
    parts = [{"f": pa.array([f] * m.size), "y": pa.array(np.indices(m.shape)[0].ravel()), "x": pa.array(np.indices(m.shape)[1].ravel()), "m": pa.array((m > 0).ravel() * np.int64(255))} for f, m in masks.items()]
    pq.write_table(pa.concat_tables([pa.table(p) for p in parts]), path)
    return spark.read.parquet(str(path))


def labels(mask):
    found, _ = kernels.label_runs(mask > 0)
    first = {k: min(y * mask.shape[1] + x for y, x in zip(*np.nonzero(found == k))) for k in range(1, found.max() + 1)}
    return {(y, x, first[found[y, x]]) for y, x in zip(*np.nonzero(found))}


def got(df, f):
    return {(r["y"], r["x"], r["label"]) for r in df.where(F.col("f") == f).collect()}


@pytest.mark.parametrize("tile", [1, 2, 5, 64])
def test_tiles_don_t_change_components(spark, tmp_path, tile):
    rng = np.random.default_rng(tile)
    masks = {f: (rng.random((13, 17)) < p).astype(np.uint8) for f, p in enumerate((0.05, 0.3, 0.45, 0.6, 0.0, 1.0))}
    found = px.components(table(spark, tmp_path / "p.parquet", masks), 17, tile)
    for f, m in masks.items():
        assert got(found, f) == labels(m), (tile, f)


def serpent(n):
    """One path through every other row, from end to end and back: some n * n / 2 pixels long."""
    m = np.zeros((n, n), np.uint8)
    m[::2] = 1
    for k, y in enumerate(range(1, n - 1, 2)):
        m[y, -1 if k % 2 == 0 else 0] = 1
    return m


def test_large_frames_take_few_rounds(spark, tmp_path, monkeypatch):
    """Frames of 512 x 512, one a single path of 130,000 pixels: tables written grow with the logarithm of its length."""
    settled = []
    monkeypatch.setattr(graph, "settle", lambda df, replaces=None, own=graph.settle: settled.append(1) or own(df, replaces))
    rng = np.random.default_rng(4)
    masks = {0: serpent(512), 1: (rng.random((512, 512)) < 0.4).astype(np.uint8)}
    found = px.components(table(spark, tmp_path / "p.parquet", masks), 512)
    assert got(found, 0) == {(int(y), int(x), 0) for y, x in zip(*np.nonzero(masks[0]))}
    want, _ = kernels.label_runs(masks[1] > 0)
    rows = found.where("f = 1").collect()
    by_label = {}
    for r in rows:
        by_label.setdefault(r["label"], set()).add(int(want[r["y"], r["x"]]))
    assert len(rows) == masks[1].sum() and all(len(s) == 1 for s in by_label.values()) and len(by_label) == want.max()
    assert len(settled) < 120  # a pixel a round would be tens of thousands


def test_chains_and_stars_of_labels(spark):
    edges = [(0, k, k + 1) for k in range(300)] + [(1, 1000, k) for k in range(300)] + [(2, k, k) for k in range(3)] + [(3, 5, 6), (3, 6, 5), (3, 5, 6)]
    found = graph.components(spark.createDataFrame(edges, "f int, u long, v long"))
    roots = {(r["f"], r["node"]): r["root"] for r in found.collect()}
    assert len(roots) == 301 + 301 + 3 + 2
    assert {roots[0, k] for k in range(301)} == {0} and {roots[1, k] for k in [*range(300), 1000]} == {0}
    assert [roots[2, k] for k in range(3)] == [0, 1, 2] and roots[3, 6] == 5
    assert graph.components(spark.createDataFrame([], "f int, u long, v long")).count() == 0


def frames(spark, masks, channels=1):
    rows = [(str(k), k, *m.shape, channels, m.astype(np.uint8).tobytes()) for k, m in enumerate(masks)]
    return spark.createDataFrame(rows, "video string, frame_idx long, height int, width int, channels int, pixels binary")


@pytest.mark.parametrize("threshold", [0, 48, 200])
def test_runs_against_pixels(spark, threshold):
    """Every byte value, rows that are all on or all off, a single pixel, nothing at all."""
    rng = np.random.default_rng(threshold)
    gray = [rng.integers(0, 256, (7, 9)), np.zeros((3, 4)), np.full((3, 4), 255), np.eye(5) * 255, np.arange(256).reshape(16, 16), np.pad([[255]], 2), (rng.random((40, 60)) < 0.5) * 255]
    told = runs.moments(runs.of_frames(frames(spark, gray), threshold)).withColumns({
        "area": runs.area(), "s": runs.integral_at(F.lit(2), F.lit(1)), "inside": runs.is_inside(F.lit(1), F.lit(1), F.lit(2), F.lit(1)), "flat": runs.is_inside(F.lit(1), F.lit(1), F.lit(0), F.lit(9)),
    })
    for r in told.collect():
        on = gray[r["frame_idx"]] > threshold
        ys, xs = np.nonzero(on)
        assert [(y, x) for y, a, b in r["runs"] for x in range(a, b)] == list(zip(ys.tolist(), xs.tolist()))
        assert all(a < b for _, a, b in r["runs"]) and r["area"] == on.sum() and r["s"] == on[:2, :3].sum() and r["inside"] == on[1, 1:3].all() and r["flat"]
        if not len(xs):
            assert r["cx"] is r["cy"] is r["angle"] is None
            continue
        assert (r["cx"], r["cy"]) == pytest.approx((xs.mean(), ys.mean()))
        want = kernels.pca_axis(on)[2]
        assert r["angle"] == (want if want is None else pytest.approx(want, abs=1e-9))


def test_runs_stay_in_their_row(spark):
    """No exchange and no Python in the plan; colour frames are refused."""
    masks = runs.of_frames(frames(spark, [np.ones((2, 2))]))
    plan = runs.moments(masks)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    with pytest.raises(Exception, match="gray"):
        runs.of_frames(frames(spark, [np.ones((2, 3))], channels=3)).collect()
