import pytest

from strandline.operators import timeseries as ts
from strandline.streaming import gaps


def test_stream_equals_batch(spark, tmp_path):
    values = {"a": [None, 1.0, None, None, 4.0, 5.0, None, 9.0], "b": [2.0, None, 3.0, 3.5, None, None, None, 6.0]}
    rows = [(v, k, x) for v, xs in values.items() for k, x in enumerate(xs)]
    schema = "video string, frame_idx long, value double"
    for n, (a, b) in enumerate([(0, 3), (3, 6), (6, 8)]):
        spark.createDataFrame([r for r in rows if a <= r[1] < b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"n={n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "n=*"))
    query = gaps.fill_gaps(stream).writeStream.format("memory").queryName("filled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    # a state that waits for its time-out would keep the query running on batches without data
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        running = query.start()
        assert running.awaitTermination(90) and running.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {(r["video"], r["frame_idx"]): (r["value"], r["is_interpolated"]) for r in spark.table("filled").collect()}
    batch = ts.fill_gaps(spark.createDataFrame(rows, schema), ["video"], "frame_idx", ["value"])
    want = {(r["video"], r["frame_idx"]): (r["value"], r["is_interpolated"]) for r in batch.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in want)
