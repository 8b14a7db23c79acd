import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from strandline.operators import timeseries as ts
from strandline.plans import registry


def series(spark, values, video="a"):
    rows = [(video, k, None if v is None else float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "video string, frame_idx long, x double")


def column(df, name="x"):
    return [r[name] for r in df.orderBy("video", "frame_idx").collect()]


@pytest.mark.parametrize("chunk", [None, 2, 5])
@pytest.mark.parametrize("values,filled,flags", [
    ([0, None, 10], [0, 5, 10], [False, True, False]),
    ([None, 5, None], [5, 5, 5], [True, False, True]),
    ([None, None, float("nan"), 4, None, None, 10], [4, 4, 4, 4, 6, 8, 10], [True, True, True, False, True, True, False]),
    ([7], [7], [False]),
])
def test_gaps_are_filled_linearly_and_flat_at_the_ends(spark, values, filled, flags, chunk):
    out = ts.fill_gaps(series(spark, values), ["video"], "frame_idx", ["x"], chunk_rows=chunk)
    assert column(out) == pytest.approx(filled)
    assert column(out, "is_interpolated") == flags


@pytest.mark.parametrize("chunk", [None, 16])
def test_random_gaps_match_numpy(spark, chunk):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    gone = rng.random(200) < 0.4
    out = ts.fill_gaps(series(spark, [None if g else v for v, g in zip(x, gone)]), ["video"], "frame_idx", ["x"], chunk_rows=chunk)
    assert column(out) == pytest.approx(np.interp(np.arange(200), np.flatnonzero(~gone), x[~gone]))


def test_a_row_is_valid_as_a_whole(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 9.0, None), ("a", 2, 2.0, 2.0)], "video string, frame_idx long, x double, y double")
    out = ts.fill_gaps(df, ["video"], "frame_idx", ["x", "y"])
    assert column(out, "x") == [0, 1, 2]


def test_a_series_without_valid_rows(spark):
    df = series(spark, [None, None])
    assert column(ts.fill_gaps(df, ["video"], "frame_idx", ["x"])) == [None, None]
    with pytest.raises(Exception, match="no valid row"):
        ts.fill_gaps(df, ["video"], "frame_idx", ["x"], on_empty="raise").collect()


def test_pose_needs_both_likelihoods_and_coordinates(spark):
    rows = [("a", 0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0), ("a", 1, 50.0, 50.0, 0.2, 9.0, 9.0, 1.0), ("a", 2, 2.0, 2.0, 0.9, 2.0, 2.0, 0.9), ("a", 3, None, 1.0, 0.99, 1.0, 1.0, 0.99), ("a", 4, 8.0, 8.0, float("nan"), 8.0, 8.0, 1.0)]
    df = spark.createDataFrame(rows, "video string, frame_idx long, tail_x double, tail_y double, tail_likelihood double, neck_x double, neck_y double, neck_likelihood double")
    out = ts.fill_pose(df, ["video"], "frame_idx")
    assert column(out, "tail_x") == [0, 1, 2, 2, 2]
    assert column(out, "is_interpolated") == [False, True, False, True, True]


@pytest.mark.parametrize("window", [1, 3, 4, 9])
@pytest.mark.parametrize("chunk", [None, 7])
def test_rolling_median_matches_pandas(spark, window, chunk):
    x = np.random.default_rng(2).normal(size=60)
    out = ts.rolling_median(series(spark, x), ["video"], "frame_idx", ["x"], window, chunk_rows=chunk)
    assert column(out) == pytest.approx(pd.Series(x).rolling(window, center=True, min_periods=1).median().tolist())


def test_median_drops_an_outlier(spark):
    assert column(ts.rolling_median(series(spark, [0, 0, 0, 0, 100, 0, 0, 0, 0]), ["video"], "frame_idx", ["x"], 3)) == [0] * 9
    with pytest.raises(ValueError):
        ts.rolling_median(series(spark, [1]), ["video"], "frame_idx", ["x"], 0)


@pytest.mark.parametrize("sigma", [1e-3, 1.5, 2.0, 20.0])
@pytest.mark.parametrize("chunk", [None, 90])
def test_gaussian_matches_a_padded_convolution(spark, sigma, chunk):
    x = np.random.default_rng(3).normal(size=50)
    w = np.array(ts.gaussian_weights(sigma))
    want = np.convolve(np.pad(x, len(w) // 2, mode="edge"), w, "valid")
    out = ts.gaussian_smooth(series(spark, x), ["video"], "frame_idx", ["x"], sigma, chunk_rows=chunk)
    assert column(out) == pytest.approx(want)


def test_gaussian_weights():
    assert len(ts.gaussian_weights(2.0)) == 17 and sum(ts.gaussian_weights(2.0)) == pytest.approx(1)
    with pytest.raises(ValueError):
        ts.gaussian_weights(-1)


def test_smoother_choice(spark):
    df = series(spark, [0, 3, 0])
    assert column(ts.smooth(df, ["video"], "frame_idx", ["x"], window=3)) == [1.5, 0, 1.5]
    assert column(ts.smooth(df, ["video"], "frame_idx", ["x"])) == column(ts.gaussian_smooth(df, ["video"], "frame_idx", ["x"], 2.0))
    with pytest.raises(ValueError, match="mutually exclusive"):
        ts.smooth(df, ["video"], "frame_idx", ["x"], window=3, sigma=1.0)


def test_a_chain_is_one_exchange(spark):
    df = series(spark, range(10))
    out = ts.smooth(ts.fill_gaps(df, ["video"], "frame_idx", ["x"]), ["video"], "frame_idx", ["x"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_jitter_and_numbering(spark):
    df = spark.createDataFrame([("a", 5, 0.0, 0.0), ("a", 7, 3.0, 4.0), ("b", 1, 1.0, 1.0)], "video string, t long, x double, y double")
    assert {(r["video"], r["frame_idx"], r["t"]) for r in ts.number_rows(df, ["video"], ["t"]).collect()} == {("a", 0, 5), ("a", 1, 7), ("b", 0, 1)}
    got = {r["video"]: (r["mean_step"], r["max_step"]) for r in ts.jitter(df, ["video"], "t", "x", "y").collect()}
    assert got == {"a": (5, 5), "b": (None, None)}
    assert ts.uniform_subsample(df, "t", 5).count() == 1
    assert ts.fill_gaps(df.where(F.lit(False)).withColumnRenamed("t", "frame_idx"), ["video"], "frame_idx", ["x"]).count() == 0


@pytest.mark.parametrize("chunk", [None, 2000])
def test_long_series_take_time_in_proportion(spark, chunk):
    """A form that looks ahead row by row takes some 40 s for the longer one."""
    import time

    def seconds(n):
        df = spark.range(n).select(F.lit("a").alias("video"), F.col("id").alias("frame_idx"), F.when(F.col("id") % 50 == 0, F.col("id") * 1.0).alias("x"))
        began = time.perf_counter()
        got = ts.fill_gaps(df, ["video"], "frame_idx", ["x"], chunk_rows=chunk).agg(F.sum("x"), F.count("*")).first()
        assert got[1] == n and got[0] == pytest.approx(sum(min(k, (n - 1) // 50 * 50) for k in range(n)))
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 5 and seconds(80_000) < 10


def in_partitions(df):
    """All rows, and how many are in the fullest partition."""
    rows = df.withColumn("_partition", F.spark_partition_id()).toPandas()
    return rows, rows.groupby("_partition").size().max()


@pytest.fixture
def orders(spark, tmp_path):
    """120,000 orders with keys that begin at 7 and skip a stretch; every third one is missing as a value."""
    n = F.col("id")
    key = n + 7 + F.when(n >= 50_000, 1_000_000).otherwise(0)
    spark.range(120_000).select(key.alias("o_orderkey"), (n * 7919 % 1009 * 1.0).alias("o_totalprice"), F.when(n % 3 == 0, "F").otherwise("O").alias("o_orderstatus")).write.parquet(f"{tmp_path}/orders.parquet")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield str(tmp_path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_no_task_fills_a_whole_long_series(spark, orders):
    out = registry.queries()["ts_gap_fill_long"](spark, orders)
    rows = spark.read.parquet(f"{orders}/orders.parquet").orderBy("o_orderkey").toPandas()
    good = (rows.o_orderstatus != "F").to_numpy()
    want = np.interp(rows.o_orderkey, rows.o_orderkey[good], rows.o_totalprice[good])
    got, most = in_partitions(out)
    got = got.sort_values("frame_idx")
    assert (got.frame_idx.to_numpy() == rows.o_orderkey.to_numpy()).all()
    assert np.allclose(got.filled, want, atol=1e-4) and (got.is_interpolated.to_numpy() == ~good).all()
    assert most < len(rows)


def test_no_task_numbers_a_whole_long_series(spark, orders):
    out = registry.queries()["ts_roll_median1001"](spark, orders)
    rows = spark.read.parquet(f"{orders}/orders.parquet").orderBy("o_orderkey").toPandas()
    value = rows.o_totalprice.where(rows.o_orderstatus != "F")
    want = value.rolling(1001, center=True, min_periods=1).median()
    got, _ = in_partitions(out)
    got = got.sort_values("frame_idx")
    assert (got.frame_idx.to_numpy() == rows.o_orderkey.to_numpy()).all()
    assert np.allclose(got.smooth, want, atol=1e-4)
    s = spark.read.parquet(f"{orders}/orders.parquet").select(F.lit(0).alias("k"), F.col("o_orderkey").alias("t"))
    numbered, most = in_partitions(ts.number_long(s, ["k"], "t", ts.CHUNK_ROWS, "at"))
    assert numbered.sort_values("t")["at"].tolist() == list(range(len(rows))) and most < len(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number() windowspecdefinition(_piece" in plan


@pytest.mark.parametrize("window", [4, 101])
def test_medians_by_pieces(spark, window):
    """Positions below 0 and far apart, and a series without a name."""
    rng = np.random.default_rng(4)
    at = sorted({int(v) for v in rng.integers(-900, 900, 300)} | {10**9, 10**9 + 1})
    rows = [(v, t, float(rng.integers(0, 9))) for v in (None, "b") for t in at]
    got = ts.rolling_median(spark.createDataFrame(rows, "video string, t long, x double"), ["video"], "t", ["x"], window, piece_rows=50)
    assert got.columns == ["video", "t", "x"]
    for v in (None, "b"):
        want = pd.Series([x for w, _, x in rows if w == v]).rolling(window, center=True, min_periods=1).median()
        assert [r["x"] for r in got.where(F.col("video").eqNullSafe(v)).orderBy("t").collect()] == want.tolist()


def test_chunks_keep_series_without_a_name(spark):
    df = spark.createDataFrame([(v, i, None if i in (2, 3) else float(i)) for v in (None, "b") for i in range(6)], "video string, frame_idx long, x double")
    got = ts.fill_gaps(df, ["video"], "frame_idx", ["x"], chunk_rows=2).collect()
    assert sorted((str(r["video"]), r["frame_idx"], r["x"]) for r in got) == sorted((v, i, float(i)) for v in ("None", "b") for i in range(6))


def test_changes_flags_and_modes(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 1.0), ("a", 2, 9.0), ("a", 3, None), ("a", 4, 9.0), ("b", 5, 3.0)], "video string, frame_idx long, x double")
    assert sorted((r["video"], r["frame_idx"]) for r in ts.changed_subsample(df, ["video"], "frame_idx", ["x"], 5.0).collect()) == [("a", 0), ("a", 2), ("b", 5)]
    flags = spark.createDataFrame([(True, None), (None, None), (False, True)], "a boolean, b boolean")
    assert [r["f"] for r in flags.select(ts.either(F.col("a"), F.col("b")).alias("f")).collect()] == [True, False, True]
    assert {r["video"]: (r["any_valid"], r["n_valid"]) for r in ts.validity(df, ["video"], "x").collect()} == {"a": (True, 4), "b": (True, 1)}
    posed = spark.createDataFrame([("b",), ("b",)], "video string")
    assert {(r["video"], r["mode"]) for r in ts.with_mode(df, posed, ["video"]).collect()} == {("a", "axis"), ("b", "pose")}


def test_weighted_draws_follow_their_weights(spark):
    """Over many seeds the first draw of a series falls on a row as often as its weight says."""
    weights = [1.0, 2.0, 5.0, 0.0, None, 12.0]
    rows = [(s, i, w) for s in range(3000) for i, w in enumerate(weights)]
    df = spark.createDataFrame(rows, "s long, i long, w double")
    drawn = ts.weighted_subsample(df, ["s"], "i", "w", 1)
    counts = {r["i"]: r["count"] for r in drawn.groupBy("i").count().collect()}
    assert set(counts) == {0, 1, 2, 5} and sum(counts.values()) == 3000
    for i in counts:
        p = weights[i] / 20
        assert abs(counts[i] - 3000 * p) < 5 * (3000 * p * (1 - p)) ** 0.5
    pick = lambda d, **o: sorted(tuple(r) for r in ts.weighted_subsample(d, ["s"], "i", "w", 3, **o).where("s < 50").collect())
    one = pick(df)
    assert one == pick(df.repartition(7)) == pick(df, most_held=10) and one != pick(df, seed=1) and len(one) == 150
    assert len(ts.weighted_subsample(df, ["s"], "i", "w", 99).where("s = 1").collect()) == 4
    assert ts.weighted_subsample(df.where("false"), ["s"], "i", "w", 3).count() == 0


def test_change_weights(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 4.0), (1, 2, None), (1, 3, 4.0), (2, 0, 9.0)], "s long, i long, v double")
    assert [r["weight"] for r in ts.change_weight(df, ["s"], "i", ["v"], 0.5).orderBy("s", "i").collect()] == [0.5, 3.5, 0.5, 0.5, 0.5]


@pytest.mark.parametrize("window", [65, 100, 1001])
def test_wide_medians(spark, window):
    """Gaps, ties and short series; chunks given and not, the same either way."""
    rng = np.random.default_rng(window)
    rows = [(s, 3 * i, i, None if rng.random() < 0.2 else float(rng.integers(0, 50)), "k") for s, n in ((1, 1), (2, 40), (3, 1500)) for i in range(n)] + [(4, 0, 0, None, "k")]
    df = spark.createDataFrame(rows, "s long, t long, i long, v double, note string").repartition(5)
    back, ahead = window // 2, (window - 1) // 2
    by_series = {}
    for s, _, i, v, _ in rows:
        by_series.setdefault(s, []).append(v)
    want = {}
    for s, vs in by_series.items():
        for i in range(len(vs)):
            near = [v for v in vs[max(0, i - back) : i + ahead + 1] if v is not None]
            want[s, i] = float(np.median(near)) if near else None
    for out in (ts.rolling_median(df, ["s"], "t", ["v"], window, "_m"), ts.rolling_median(df, ["s"], "i", ["v"], window, "_m", chunk_rows=128)):
        assert out.columns == [*df.columns, "v_m"]
        assert {(r["s"], r["i"]): r["v_m"] for r in out.collect()} == want
    assert ts.rolling_median(df.where("false"), ["s"], "t", ["v"], window).count() == 0


def test_time_hardly_grows_with_the_window():
    import time

    x = np.random.default_rng(1).normal(size=60_000)
    took = []
    for half in (50, 500, 5000):
        began = time.process_time()
        ts.sliding_medians(x, np.zeros(len(x), bool), np.arange(len(x)), half, half)
        took.append(time.process_time() - began)
    assert took[2] < 4 * took[0]
