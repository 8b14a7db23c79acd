import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import embeddings as emb
from strandline.operators import frames as frame_ops
from strandline.plans import pipelines, registry
from strandline.schema import CORNERS
from strandline.sources import encoders, frames, mp4, ranges, tables

BOX = [4.0, 2.0, 20.0, 2.0, 20.0, 10.0, 4.0, 10.0]


def stack(path, n, seed=1, shape=(24, 32, 3)):
    data = np.random.default_rng(seed).integers(0, 256, (n, *shape)).astype(np.uint8)
    np.save(path, data)
    return data


def boxes(spark, rows):
    """Geometry of (video, frame_idx, is_interpolated)."""
    return spark.createDataFrame([(*r[:2], *BOX, r[2]) for r in rows], "video string, frame_idx long, " + ", ".join(f"{c} double" for c in CORNERS) + ", is_interpolated boolean")


def listed(df):
    return sorted((r["video"], r["frame_idx"], r["height"], r["width"], r["channels"], bytes(r["pixels"])) for r in df.collect())


def test_ranges_cover_every_frame_once(spark, tmp_path):
    stack(tmp_path / "a.npy", 10)
    stack(tmp_path / "b.npy", 1)
    stack(tmp_path / "c.npy", 0)
    got = ranges.frame_ranges(spark, [tmp_path / f"{v}.npy" for v in "abc"], frames=4).orderBy("video", "first").collect()
    assert [(r["video"], r["part"], r["first"], r["last"], r["bytes"]) for r in got] == [("a", 0, 0, 4, 4 * 2304), ("a", 1, 4, 8, 4 * 2304), ("a", 2, 8, 10, 2 * 2304), ("b", 0, 0, 1, 2304)]
    assert ranges.frame_ranges(spark, []).count() == 0


def test_ranges_make_what_frame_tables_make(spark, tmp_path):
    paths = [tmp_path / "a.npy", tmp_path / "b.npy"]
    for k, p in enumerate(paths):
        stack(p, 9, seed=k)
    found = boxes(spark, [("a", k, k % 2 == 1) for k in range(9)] + [("b", 3, False), ("b", 70, False), ("none", 0, False)])
    table, parts = frames.read_frames(spark, paths), ranges.frame_ranges(spark, paths, frames=4)
    assert listed(frame_ops.crop_ranges(parts, found, (16, 8))) == listed(frame_ops.crop_frames(table, found, (16, 8)))
    assert listed(frame_ops.draw_ranges(parts, found)) == listed(frame_ops.draw_frames(table, found))
    assert listed(frame_ops.crop_ranges(parts, found.where("false"), (16, 8))) == []


def test_pixels_cross_no_exchange(spark, tmp_path):
    """What a plan exchanges is told by the columns below its exchanges."""
    stack(tmp_path / "a.npy", 3)
    parts, found = ranges.frame_ranges(spark, [tmp_path / "a.npy"]), boxes(spark, [("a", k, False) for k in range(3)])

    def exchanged(df):
        plan = df._jdf.queryExecution().executedPlan()
        out, todo = [], [plan]
        while todo:
            node = todo.pop()
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                todo.append(node.executedPlan())
            children = node.children()
            todo += [children.apply(k) for k in range(children.size())]
            if "Exchange" in node.nodeName():
                out.append(re.sub(r"#\d+L?", "", node.output().mkString(" ")).split())
        return out

    made = [frame_ops.crop_ranges(parts, found, (16, 8)), frame_ops.draw_ranges(parts, found), frame_ops.inscribe_ranges(parts), pipelines.write_overlays(parts, found, tmp_path / "o", encoders.encode_npy)]
    for df in made:
        names = exchanged(df)
        assert names and all("pixels" not in n for n in names)
    # the form over frame tables does exchange them, so the test can tell
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert any("pixels" in n for n in exchanged(frame_ops.crop_frames(frames.read_frames(spark, [tmp_path / "a.npy"]), found, (16, 8))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_made_videos_keep_order_and_rate(spark, tmp_path):
    data = stack(tmp_path / "a.npy", 11)
    parts = ranges.frame_ranges(spark, [tmp_path / "a.npy"], frames=3)
    found = boxes(spark, [("a", k, False) for k in range(11) if k != 5])
    (done,) = pipelines.write_crops(parts, found, pipelines.Settings(height=8), tmp_path / "out", encoders.encode_npy).collect()
    assert done["n_frames"] == 10 and (np.load(done["path"]) == data[[k for k in range(11) if k != 5], 2:10, 4:20]).all()
    seen = tmp_path / "fps"

    def encode(path, width, height, channels, fps, pixels):
        seen.write_text(f"{fps} {width} {height} {channels} {sum(1 for _ in pixels)}")
        return encoders.encode_npy(path, width, height, channels, fps, iter([]))

    encoders.write_made(parts, found, CORNERS, frame_ops.cropping((16, 8)), tmp_path / "rate", encoder=encode).collect()
    assert seen.read_text() == "24.0 16 8 3 10"


def test_a_failing_encoder_leaves_nothing(spark, tmp_path):
    stack(tmp_path / "a.npy", 2)

    def fail(path, width, height, channels, fps, pixels):
        open(path, "wb").write(next(pixels))
        raise OSError("no room")

    parts = ranges.frame_ranges(spark, [tmp_path / "a.npy"])
    for write in (lambda: pipelines.write_overlays(parts, boxes(spark, [("a", 0, False)]), tmp_path / "o", fail), lambda: encoders.write_videos(frames.read_frames(spark, [tmp_path / "a.npy"]), tmp_path / "o", encoder=fail)):
        with pytest.raises(Exception, match="no room"):
            write().collect()
        assert list((tmp_path / "o").iterdir()) == []


POSE = "scorer,m,m,m,m,m,m\nbodyparts,neck,neck,neck,tail,tail,tail\ncoords,x,y,likelihood,x,y,likelihood\n"


def test_pose_rows_must_be_those_of_the_frames(spark, tmp_path):
    blob = np.zeros((3, 60, 120), np.uint8)
    blob[:, 15:45, 20:100] = 100
    np.save(tmp_path / "a.npy", blob)
    line = "{},80,30,1,20,30,1\n"
    parts = ranges.frame_ranges(spark, [tmp_path / "a.npy"], frames=2)

    def both(indices):
        (tmp_path / "a.csv").write_text(POSE + "".join(line.format(k) for k in indices))
        pose = tables.read_pose(spark, tmp_path / "a.csv")
        return pipelines.geometry_of(parts, pose), pipelines.geometry(frames.read_frames(spark, [tmp_path / "a.npy"]), pose)

    by_range, by_table = (sorted(map(tuple, df.collect())) for df in both([0, 1, 2]))
    assert by_range == by_table and len(by_range) == 3
    for indices, said in (([0, 1, 1], "repeat or skip"), ([0, 1, 3], "repeat or skip"), ([1, 2, 3], "repeat or skip"), ([0, 1], "3 frames and 2 pose rows"), ([0, 1, 2, 2], "3 frames and 4 pose rows")):
        for df in both(indices):
            with pytest.raises(Exception, match=said):
                df.collect()


# --- sample tables ---------------------------------------------------------------------------------------------------


def recording(path, n, key=0):
    path.write_bytes(registry._mp4(n, key))
    return [bytes([k % 256]) * (5 + (key + 3 * k) % 11) for k in range(n)]


@pytest.mark.parametrize("n", [1, 3, 4, 5, 13, 300])
def test_samples_are_where_the_table_says(tmp_path, n):
    want = recording(tmp_path / "a.mp4", n, key=n)
    got = mp4.samples(str(tmp_path / "a.mp4"))
    data = (tmp_path / "a.mp4").read_bytes()
    assert [data[a : a + s] for a, s in zip(got.offset, got.size)] == want
    assert got.starts.tolist() == list(range(0, n, 6)) and got.ticks.tolist() == [100 * k for k in range(n)]
    assert got.shown.tolist() == [100 * k + 200 * (k % 2) for k in range(n)] and got.rate == 12.5


def test_other_forms_of_sample_tables(tmp_path):
    """Long boxes, 64-bit places, one size for all, no keyframe table, and tables that don't agree."""
    box = lambda kind, body: struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body
    table = lambda form, *rows: bytes(4) + struct.pack(">I", len(rows)) + b"".join(struct.pack(form, *r) for r in rows)

    def file(places):
        stbl = box(b"stts", table(">II", (2, 10), (1, 30))) + box(b"stsz", struct.pack(">III", 0, 7, 3)) + box(b"stsc", table(">III", (1, 2, 1))) + box(b"co64", table(">Q", *places))
        track = box(b"tkhd", bytes(76) + struct.pack(">II", 8 << 16, 6 << 16)) + box(b"mdia", box(b"mdhd", b"\1" + bytes(19) + struct.pack(">IQ", 100, 50)) + box(b"hdlr", bytes(8) + b"vide") + box(b"minf", box(b"stbl", stbl)))
        (tmp_path / "a.mp4").write_bytes(box(b"moov", box(b"trak", track)))
        return mp4.samples(str(tmp_path / "a.mp4"))

    got = file([(1 << 33,), (1 << 34,)])
    assert got.offset.tolist() == [1 << 33, (1 << 33) + 7, 1 << 34] and got.size.tolist() == [7] * 3
    assert got.ticks.tolist() == [0, 10, 20] and got.keyframe.all() and (got.width, got.height, got.scale, got.rate) == (8, 6, 100, 6.0)
    with pytest.raises(OSError, match="3 samples and places for 2"):
        file([(1,)])


def test_recordings_are_decoded_from_keyframes(spark, tmp_path):
    """A stand-in decoder that needs every sample from a keyframe on: each frame holds the sum of what came since."""
    want = [len(s) for s in recording(tmp_path / "v.mp4", 40)]

    def decode(samples):
        total = None
        for data in samples:
            total = len(data) if data[0] % 6 == 0 else total + len(data)
            yield np.full((2, 3), total, np.uint8)

    reader = mp4.seeking(decode, lambda s: 6)
    sums = [sum(want[k - k % 6 : k + 1]) for k in range(40)]
    for start, stop in ((0, 40), (7, 9), (12, 13), (39, 99), (5, 5)):
        assert [int(f[0, 0]) for f in reader.read(str(tmp_path / "v.mp4"), start, stop)] == sums[start:stop]
    frames.register_decoder(".mp4", reader)
    try:
        parts = ranges.frame_ranges(spark, [tmp_path / "v.mp4"], frames=8)
        assert [(r["first"], r["last"]) for r in parts.orderBy("first").collect()] == [(0, 6), (6, 12), (12, 24), (24, 30), (30, 40)]
        read = frames.read_frames(spark, [tmp_path / "v.mp4"], partition_bytes=48)
        assert read.rdd.getNumPartitions() == 5
        assert [r["pixels"][0] for r in read.orderBy("frame_idx").collect()] == sums
        made = ranges.make_frames(parts, spark.createDataFrame([("v", 9), ("v", 25)], "video string, frame_idx long"), [], lambda k, f, row: f if row else None)
        assert [(r["frame_idx"], r["pixels"][0]) for r in made.orderBy("frame_idx").collect()] == [(9, sums[9]), (25, sums[25])]
    finally:
        del frames.FrameSource.decoders[".mp4"]


def test_long_recordings_are_indexed_in_batches(spark, tmp_path):
    recording(tmp_path / "a.mp4", 40_000)
    got = mp4.sample_index(spark.createDataFrame([(str(tmp_path / "a.mp4"),)], "path string"))
    assert got.count() == 40_000 and got.where("keyframe").count() == -(-40_000 // 6)


# --- clusters ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_spread_centres_cost_no_more(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    first, spread = (emb.cost(table, seeds(table, "vec_id", "embedding", 10)) for seeds in (emb.first_rows, emb.spread_rows))
    assert spread <= first


def test_spread_centres_find_far_groups(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(50, 4)) + 40 * np.eye(4)[k % 4] * (1 + k // 4) for k in range(8)])
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["cluster"] for r in emb.clusters(table, "vec_id", k=8, rounds=3, seeds=emb.spread_rows).collect()}
    assert got.pop(999) is None and [len({got[k] for k in range(50 * g, 50 * g + 50)}) for g in range(8)] == [1] * 8 and len(set(got.values())) == 8
    assert emb.spread_rows(table.where("false"), "vec_id", "embedding", 3).size == 0
    assert emb.clusters(table.where("false"), "vec_id", k=3).count() == 0
    same = table.where("vec_id = 1").unionAll(table.where("vec_id = 1"))
    assert len(emb.spread_rows(same, "vec_id", "embedding", 3)) == 1
    assert table.where(F.col("embedding").isNull()).count() == 1
