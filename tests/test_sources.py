import os
import stat
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import cli
from strandline.plans import registry
from strandline.sources import encoders, files, frames, mp4, sinks, tables, videos
from strandline.schema import CORNERS


def stack(path, n=7, shape=(6, 8, 3), seed=1):
    data = np.random.default_rng(seed).integers(0, 256, (n, *shape)).astype(np.uint8)
    np.save(path, data)
    return data


def test_recordings_are_read_by_ranges_of_frames(spark, tmp_path):
    data = stack(tmp_path / "a.npy")
    gray = stack(tmp_path / "b.npy", 3, (5, 4))
    read = frames.read_frames(spark, [tmp_path / "a.npy", tmp_path / "b.npy"], partition_bytes=2 * 6 * 8 * 3)
    assert read.rdd.getNumPartitions() >= 4
    got = {(r["video"], r["frame_idx"]): r for r in read.collect()}
    assert len(got) == 10
    for k in range(7):
        r = got["a", k]
        assert (r["height"], r["width"], r["channels"]) == (6, 8, 3) and bytes(r["pixels"]) == data[k].tobytes()
    assert all(bytes(got["b", k]["pixels"]) == gray[k].tobytes() and got["b", k]["channels"] == 1 for k in range(3))
    assert frames.read_frames(spark, []).count() == 0


def test_only_named_recordings_are_opened(spark, tmp_path):
    stack(tmp_path / "a.npy")
    (tmp_path / "broken.npy").write_bytes(b"nothing")
    paths = [tmp_path / "a.npy", tmp_path / "broken.npy"]
    read = frames.read_frames(spark, paths, only={"a", "none"})
    assert read.where("video = 'a' and frame_idx < 2").count() == 2 and read.count() == 7
    with pytest.raises(Exception):
        frames.read_frames(spark, paths).count()


def test_only_stacks_of_bytes_are_frames(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((2, 3, 3)))
    with pytest.raises(Exception, match="uint8"):
        frames.read_frames(spark, [tmp_path / "a.npy"]).count()


def test_files_open_by_uri(tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    for path in (str(tmp_path / "x"), f"file:{tmp_path}/x", f"file://{tmp_path}/x"):
        with files.opened(path) as f:
            f.seek(0, 2)
            assert f.tell() == 3


def test_files_open_on_other_file_systems(monkeypatch):
    from pyarrow import fs

    memory = fs._MockFileSystem()
    with memory.open_output_stream("x.bin") as f:
        f.write(b"abcdef")
    monkeypatch.setattr(fs, "FileSystem", types.SimpleNamespace(from_uri=lambda uri: (memory, uri.split("//")[1])))
    with files.opened("store://x.bin") as f:
        f.seek(2)
        assert f.read(3) == b"cde"
    with pytest.raises(RuntimeError), files.written("store://x.bin") as f:
        f.write(b"ha")
        raise RuntimeError
    with files.written("store://y.bin") as f:
        f.write(b"new")
    with files.opened("store://x.bin") as x, files.opened("store://y.bin") as y:
        assert (x.read(), y.read()) == (b"abcdef", b"new")


def test_half_a_file_never_takes_the_place_of_a_whole_one(tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("whole")
    with pytest.raises(RuntimeError), files.written(path) as f:
        f.write(b"ha")
        raise RuntimeError
    assert path.read_text() == "whole" and os.listdir(tmp_path) == ["a.csv"]
    with files.written(f"file:{path}") as f:
        f.write(b"new")
    assert path.read_text() == "new" and os.listdir(tmp_path) == ["a.csv"]


def test_geometry_files_hold_whole_series(spark, tmp_path):
    """Also where a series spans many batches."""
    rows = spark.range(25_000).select(F.lit("v").alias("video"), F.col("id").alias("frame_idx"), *[F.lit(1.5).alias(c) for c in CORNERS], F.lit(False).alias("is_interpolated"))
    tables.write_geometry(rows.unionAll(rows.withColumn("video", F.lit("w")).limit(3)), tmp_path)
    lines = (tmp_path / "v.csv").read_text().splitlines()
    assert len(lines) == 25_001 and [int(x.split(",")[0]) for x in lines[1:]] == list(range(25_000))
    assert sorted(os.listdir(tmp_path)) == ["v.csv", "w.csv"]


@pytest.fixture
def cv2(monkeypatch):
    """The part of OpenCV's interface that is used, over .npy files."""
    module = types.ModuleType("cv2")

    class VideoCapture:
        def __init__(self, path):
            self.frames = list(np.load(path)) if os.path.exists(path) else None

        def isOpened(self):
            return self.frames is not None

        def read(self):
            return (True, self.frames.pop(0)) if self.frames else (False, None)

        def release(self):
            self.frames = None

    class VideoWriter:
        def __init__(self, path, code, fps, size, color):
            assert code == "mp4v"
            self.path, self.size, self.frames = path, size, []

        def write(self, frame):
            assert frame.shape[1::-1] == self.size
            self.frames.append(frame)

        def release(self):
            with open(self.path, "wb") as f:
                np.save(f, np.stack(self.frames))

    module.VideoCapture, module.VideoWriter, module.VideoWriter_fourcc = VideoCapture, VideoWriter, lambda *c: "".join(c)
    module.__spec__ = types.SimpleNamespace(name="cv2")
    monkeypatch.setitem(sys.modules, "cv2", module)


def test_opencv_reads_and_writes(cv2, tmp_path):
    data = stack(tmp_path / "a.npy")
    os.rename(tmp_path / "a.npy", tmp_path / "a.mp4")
    assert all((a == b).all() for a, b in zip(frames.decode_opencv(str(tmp_path / "a.mp4")), data, strict=True))
    with pytest.raises(OSError, match="no video"):
        next(frames.decode_opencv(str(tmp_path / "none.mp4")))
    reader = frames.FrameReader([str(tmp_path / "a.mp4")], {}, True)
    (part,) = reader.partitions()
    assert sum(b.num_rows for b in reader.read(part)) == 7
    path = encoders.encode_opencv(str(tmp_path / "b.mp4"), 8, 6, 3, 24.0, (f.tobytes() for f in data))
    assert (np.load(path) == data).all() and encoders.best_encoder() is encoders.encode_opencv
    gray = encoders.encode_opencv(str(tmp_path / "g.mp4"), 8, 6, 1, 24.0, iter([bytes(48)]))
    assert np.load(gray).shape == (1, 6, 8)


def test_without_opencv(tmp_path):
    with pytest.raises(OSError, match="OpenCV"):
        next(frames.decode_opencv("x.mp4"))
    with pytest.raises(OSError, match="OpenCV"):
        encoders.encode_opencv("x.mp4", 1, 1, 1, 1.0, iter([]))
    assert encoders.best_encoder() is encoders.encode_npy


def test_ffmpeg_gets_the_frames(spark, tmp_path, monkeypatch):
    """A program of that name that keeps what it is given."""
    program = tmp_path / "bin" / "ffmpeg"
    program.parent.mkdir()
    program.write_text('#!/bin/sh\nfor last; do :; done\necho "$@" > "$(dirname "$0")/args"\ncase "$last" in *fail*) exit 3;; esac\ncat > "$last"\n')
    program.chmod(program.stat().st_mode | stat.S_IEXEC)
    monkeypatch.setenv("PATH", f"{program.parent}:{os.environ['PATH']}")
    encode = encoders.best_encoder(23)
    assert encode(str(tmp_path / "x.mp4"), 4, 2, 3, 12.5, iter([b"a" * 24, b"b" * 24])) == str(tmp_path / "x.mp4")
    assert (tmp_path / "x.mp4").read_bytes() == b"a" * 24 + b"b" * 24
    said = (program.parent / "args").read_text()
    for words in ("-pix_fmt bgr24", "-s 4x2", "-r 12.5", "-c:v libx264", "-crf 23"):
        assert words in said
    with pytest.raises(RuntimeError, match="code 3"):
        encode(str(tmp_path / "fail.mp4"), 4, 2, 1, 12.5, iter([]))


def test_probes_and_names_of_written_videos(spark, tmp_path):
    data = stack(tmp_path / "a.npy", 2)
    read = frames.read_frames(spark, [tmp_path / "a.npy"])
    (done,) = encoders.write_videos(read, tmp_path / "out", "_x").collect()
    assert done["path"] == str(tmp_path / "out" / "a_x.npy") and os.listdir(tmp_path / "out") == ["a_x.npy"]
    assert (np.load(done["path"]) == data).all()
    videos.register_probe(".npy", lambda path: (2, 1.0, 8, 6))
    try:
        listed = spark.createDataFrame([(str(tmp_path / "a.npy"),)], "path string")
        assert tuple(videos.video_info(listed).first())[1:] == (2, 1.0, 8, 6)
    finally:
        videos._probes.clear()


def test_commands_of_other_packages(monkeypatch, capsys):
    def add(commands):
        commands.add_parser("hello").set_defaults(handler=lambda args: print("hello there"))

    plugin = types.SimpleNamespace(load=lambda: add)
    monkeypatch.setattr(cli, "entry_points", lambda group: [plugin] if group == cli.PLUGINS else [])
    cli.main(["hello"])
    assert "hello there" in capsys.readouterr().out


def test_the_command_line_ships_the_package(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(cli, "ship", seen.append)
    assert cli._session() is not None and len(seen) == 1


def test_files_are_committed_together(spark, tmp_path):
    """A failing task leaves nothing and touches nothing; rows that aren't dealt by video are refused."""
    one = tables.write_geometry
    rows = spark.range(6).select(F.concat(F.lit("v"), (F.col("id") % 3).cast("string")).alias("video"), F.col("id").alias("frame_idx"), *[F.lit(1.5).alias(c) for c in CORNERS], F.lit(False).alias("is_interpolated"))
    one(rows, tmp_path)
    before = {p.name: p.read_text() for p in tmp_path.iterdir()}
    assert sorted(before) == ["v0.csv", "v1.csv", "v2.csv"]
    with pytest.raises(Exception, match="no luck"):
        one(rows.withColumn("frame_idx", F.when(F.col("video") == "v2", F.raise_error(F.lit("no luck")).cast("long")).otherwise(F.col("frame_idx") + 10)), tmp_path)
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == before
    with pytest.raises(Exception, match="without a video"):
        one(rows.withColumn("video", F.when(F.col("video") != "v1", F.col("video"))), tmp_path)
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == before
    one(rows.withColumn("frame_idx", F.col("frame_idx") + 10), tmp_path)
    assert {p.name for p in tmp_path.iterdir()} == set(before) and "10," in (tmp_path / "v1.csv").read_text() + (tmp_path / "v0.csv").read_text()


def test_two_tasks_can_t_write_one_video(tmp_path):
    import pyarrow as pa

    form = sinks.csv_form("x\n", ["x"])
    writer = sinks.VideoFilesWriter(str(tmp_path), ".csv", form)
    batch = lambda *names: pa.RecordBatch.from_pylist([{"video": n, "x": k} for k, n in enumerate(names)])
    with pytest.raises(ValueError, match="in one place"):
        writer.write(iter([batch("a", "b"), batch("a")]))
    writer.abort([None])
    assert list(tmp_path.iterdir()) == []
    got = [writer.write(iter([batch("a", "a"), batch("a", "b")])), writer.write(iter([batch("c")])), None]
    retried = writer.write(iter([batch("c")]))
    with pytest.raises(ValueError, match="two tasks wrote"):
        writer.commit([*got, retried])
    assert [p.name for p in tmp_path.iterdir()] == [writer.drafts.split("/")[-1]]
    writer.commit(got)
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"a.csv": "x\n0\n1\n0\n", "b.csv": "x\n1\n", "c.csv": "x\n0\n"}


def test_stacks_of_frames(spark, tmp_path):
    data = stack(tmp_path / "a.npy", 20)
    sinks.save_stacks(frames.read_frames(spark, [tmp_path / "a.npy"]), tmp_path / "out")
    assert (np.load(tmp_path / "out" / "a.npy") == data).all() and os.listdir(tmp_path / "out") == ["a.npy"]
    odd = frames.read_frames(spark, [tmp_path / "a.npy"]).withColumn("pixels", F.when(F.col("frame_idx") == 3, F.col("pixels")).otherwise(F.unhex(F.lit("00"))))
    with pytest.raises(Exception, match="differ in size"):
        sinks.save_stacks(odd, tmp_path / "odd")
    assert os.listdir(tmp_path / "odd") == []


def test_names_are_listed_by_the_executors(spark, tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / f"{k % 2}").mkdir(exist_ok=True)
        (tmp_path / f"{k % 2}" / f"session-1_cuttle-{k}.mp4").write_bytes(registry._mp4(k, k))
    monkeypatch.setattr(videos, "listing", None)
    found = videos.find_videos(spark, [tmp_path / "0", f"file:{tmp_path}/1"])
    assert sorted(r["stem"] for r in found.collect()) == [f"session-1_cuttle-{k}" for k in range(6)]
    assert mp4.sample_index(found).count() == sum(range(6))
    assert videos.find_videos(spark, []).count() == 0


def test_a_task_fills_its_own_folder(tmp_path):
    def fill(text):
        with files.filled(f"{tmp_path}/a") as folder:
            with files.created(f"{folder}/x") as f:
                f.write(text)

    fill(b"one")
    fill(b"two")
    with pytest.raises(RuntimeError), files.filled(f"{tmp_path}/b"):
        raise RuntimeError
    assert os.listdir(tmp_path) == ["a"] and (tmp_path / "a" / "x").read_bytes() == b"one"


def test_an_outline_is_what_the_samples_say(tmp_path):
    for n in (0, 1, 5, 8, 49):
        (tmp_path / "a.mp4").write_bytes(registry._mp4(n, n))
        got = mp4.samples(str(tmp_path / "a.mp4"))
        assert mp4.outline(str(tmp_path / "a.mp4")) == (len(got), got.rate, got.width, got.height)


def test_a_manifest_is_written_by_all_its_tasks(spark, tmp_path):
    tables.write_manifest(spark.range(30).repartition(3), tmp_path / "m")
    assert len(list((tmp_path / "m").glob("part-*"))) == 3 and spark.read.parquet(str(tmp_path / "m")).count() == 30
