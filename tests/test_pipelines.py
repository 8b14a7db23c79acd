import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import cli, config
from strandline.operators import inventory as inv
from strandline.plans import pipelines, results
from strandline.schema import CORNERS, MANIFEST
from strandline.sources import encoders, frames, tables, videos


def mp4(path, n=5, fps=10, size=(32, 24)):
    """A file with the boxes that metadata is read from, and no media."""
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    tkhd = box(b"tkhd", bytes(76) + struct.pack(">II", size[0] << 16, size[1] << 16))
    mdhd = box(b"mdhd", bytes(12) + struct.pack(">II", fps * 100, n * 100) + bytes(4))
    hdlr = box(b"hdlr", bytes(8) + b"vide" + bytes(13))
    stbl = box(b"stbl", box(b"stts", struct.pack(">IIII", 0, 1, n, 100)) + box(b"stsz", struct.pack(">III", 0, 1, n)))
    path.write_bytes(box(b"ftyp", b"isom") + box(b"moov", box(b"trak", tkhd + box(b"mdia", mdhd + hdlr + box(b"minf", stbl)))))


def blob(x0=20):
    f = np.zeros((60, 120, 3), np.uint8)
    f[15:45, x0 : x0 + 80] = 100
    return f


POSE = "scorer,m,m,m,m,m,m,m,m,m\nbodyparts,neck,neck,neck,fin,fin,fin,tail,tail,tail\ncoords,x,y,likelihood,x,y,likelihood,x,y,likelihood\n"


def test_manifest(spark, tmp_path):
    for name in ("session-10_cuttle-2", "session-02_cuttle-1", "session-3_cuttle-1", "session-x_cuttle-1"):
        mp4(tmp_path / f"{name}.mp4")
    mp4(tmp_path / "other.mp4")
    (tmp_path / "session-10_cuttle-2.txt").write_text("5\n\n3\n3\n")
    (tmp_path / "session-02_cuttle-1.txt").write_text("")
    manifest, warnings = pipelines.build_manifest(spark, tmp_path)
    rows = manifest.collect()
    assert manifest.schema == MANIFEST or [f.name for f in manifest.schema] == [f.name for f in MANIFEST]
    assert [(r["session_id"], r["fish_id"], r["n_blank_frames"], r["blank_frames_path"] is None) for r in rows] == [(2, 1, 0, False), (10, 2, 3, False), (3, 1, None, True)]
    assert {(r["n_frames"], r["fps"], r["width"], r["height"]) for r in rows} == {(5, 10.0, 32, 24)}
    assert sorted(w["warning"].split(" ")[0] for w in warnings.collect()) == ["index", "no", "unexpected"]
    s = inv.summary(manifest).first()
    assert tuple(s) == (3, 3, 15, 3)


def test_empty_and_missing_folders(spark, tmp_path):
    manifest, _ = pipelines.build_manifest(spark, tmp_path)
    assert manifest.count() == 0 and manifest.columns == MANIFEST.names
    assert tuple(inv.summary(manifest).first()) == (0, 0, 0, 0)
    with pytest.raises(FileNotFoundError):
        pipelines.build_manifest(spark, tmp_path / "none")


def test_unreadable_video_fails(spark, tmp_path):
    (tmp_path / "session-1_cuttle-1.mp4").write_bytes(b"")
    with pytest.raises(Exception, match="no video track"):
        pipelines.build_manifest(spark, tmp_path)[0].collect()


def test_pose_files(spark, tmp_path):
    (tmp_path / "v.csv").write_text(POSE + "0,1,2,0.9,7,7,7,3,4,0.8\n1,,2,0.9,7,7,7,3,nan,0.8\n")
    rows = tables.read_pose(spark, tmp_path / "v.csv").orderBy("frame_idx").collect()
    assert rows[0].asDict() == {"video": "v", "frame_idx": 0, "tail_x": 3.0, "tail_y": 4.0, "tail_likelihood": 0.8, "neck_x": 1.0, "neck_y": 2.0, "neck_likelihood": 0.9}
    assert rows[1]["neck_x"] is None and rows[1]["tail_y"] is None
    (tmp_path / "w.csv").write_text(POSE.replace("tail", "head") + "0,1,2,0.9,7,7,7,3,4,0.8\n")
    with pytest.raises(Exception, match="no column tail_x"):
        tables.read_pose(spark, tmp_path / "w.csv").collect()


def test_blank_lines_and_bad_lines(spark, tmp_path):
    (tmp_path / "session-1_cuttle-1.txt").write_text("1\nx\n")
    with pytest.raises(Exception):
        videos.blank_indices(spark, videos.blank_files(spark, tmp_path)).collect()


def test_geometry_fills_blank_frames_and_round_trips(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.stack([blob(), np.zeros_like(blob()), blob(30)]))
    np.save(tmp_path / "b.npy", np.stack([blob()]))
    source = frames.read_frames(spark, [tmp_path / "a.npy", tmp_path / "b.npy"])
    assert source.count() == 4 and frames.read_frames(spark, [tmp_path / "a.npy"], metadata_only=True).where("pixels is null").count() == 3
    found = pipelines.geometry(source, settings=pipelines.Settings(window=1))
    rows = {(r["video"], r["frame_idx"]): r for r in found.collect()}
    assert [rows["a", k]["is_interpolated"] for k in range(3)] == [False, True, False]
    for c in CORNERS:
        assert rows["a", 1][c] == pytest.approx((rows["a", 0][c] + rows["a", 2][c]) / 2)
    tables.write_geometry(found, tmp_path / "out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.csv", "b.csv"]
    assert (tmp_path / "out" / "a.csv").read_text().splitlines()[0] == ",".join(["frame_idx", *CORNERS, "is_interpolated"])
    back = {(r["video"], r["frame_idx"]): r for r in tables.read_geometry(spark, tmp_path / "out" / "a.csv", tmp_path / "out" / "b.csv").collect()}
    assert back["a", 1]["is_interpolated"] is True and back["b", 0]["corner_br_x"] == pytest.approx(rows["b", 0]["corner_br_x"])
    crops = pipelines.crops(source, found, pipelines.Settings(height=20))
    assert {(r["width"], r["height"], r["channels"]) for r in crops.collect()} == {(40, 20, 3)}
    drawn = pipelines.overlay(source, found)
    paths = {r["video"]: (r["path"], r["n_frames"]) for r in encoders.write_videos(drawn, tmp_path / "v", "_overlay").collect()}
    stack = np.load(paths["a"][0])
    assert stack.shape == (3, 60, 120, 3) and paths["a"][1] == 3
    assert (stack[0] == (0, 255, 0)).all(-1).any() and (stack[1] == (0, 165, 255)).all(-1).any()


def test_pose_geometry_and_length_mismatch(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.stack([blob(), blob()]))
    pose = POSE + "0,80,30,1,0,0,0,20,30,1\n1,80,30,0.1,0,0,0,20,30,1\n"
    (tmp_path / "a.csv").write_text(pose)
    source = frames.read_frames(spark, [tmp_path / "a.npy"])
    found = pipelines.geometry(source, tables.read_pose(spark, tmp_path / "a.csv")).orderBy("frame_idx").collect()
    assert [r["is_interpolated"] for r in found] == [False, True]
    assert max(r["corner_tr_x"] for r in found) < 82  # corners are cut to whole pixels, so a box may gain up to a pixel per side
    (tmp_path / "a.csv").write_text(pose + "2,80,30,1,0,0,0,20,30,1\n")
    with pytest.raises(Exception, match="2 frames and 3 pose rows"):
        pipelines.geometry(source, tables.read_pose(spark, tmp_path / "a.csv")).collect()


def test_all_blank_video_fails(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((2, 20, 20), np.uint8))
    with pytest.raises(Exception, match="no valid row"):
        pipelines.geometry(frames.read_frames(spark, [tmp_path / "a.npy"])).collect()


def test_settings():
    assert pipelines.Settings().mark != pipelines.Settings(sigma=1.0).mark
    assert pipelines.Settings(aspect=2.5, height=1).crop_size == (2, 1)
    with pytest.raises(ValueError):
        pipelines.Settings(window=3, sigma=1.0)


def test_config(tmp_path):
    path = tmp_path / "x" / "c.yaml"
    with pytest.raises(FileNotFoundError, match="does not exist"):
        config.load_config(path)
    one = config.Config(tmp_path / "d", tmp_path / "r")
    config.save_config(one, path)
    assert config.load_config(path) == one
    path.write_text("data_dir: /d\n")
    with pytest.raises(ValueError, match="does not say results_dir"):
        config.load_config(path)
    path.write_text("")
    with pytest.raises(ValueError):
        config.load_config(path)


def answers(monkeypatch, *said):
    left = list(said)
    monkeypatch.setattr("builtins.input", lambda _: left.pop(0))


def test_cli_setup(tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(config, "DEFAULT_PATH", tmp_path / "c.yaml")
    answers(monkeypatch, "")
    with pytest.raises(SystemExit) as e:
        cli.main(["setup"])
    assert e.value.code == 1
    answers(monkeypatch, str(tmp_path), str(tmp_path / "r"))
    cli.main(["setup"])
    assert config.load_config(tmp_path / "c.yaml").results_dir == tmp_path / "r"
    answers(monkeypatch, "n")
    with pytest.raises(SystemExit) as e:
        cli.main(["setup"])
    assert e.value.code == 0


def test_cli_ingest(spark, tmp_path, capsys):
    data = tmp_path / "d"
    data.mkdir()
    run = ["ingest", "--data-dir", str(data), "--results-dir", str(tmp_path / "r")]
    cli.main(run)
    assert "holds no recordings" in capsys.readouterr().out
    assert not (tmp_path / "r").exists()
    mp4(data / "session-1_cuttle-1.mp4")
    cli.main(run)
    assert "1 recordings of 1 sessions, 5 frames" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "r" / "manifests" / "ingest.parquet")).count() == 1
    with pytest.raises(SystemExit):
        cli.main(["ingest", "--data-dir", str(tmp_path / "none"), "--results-dir", str(tmp_path)])
    with pytest.raises(SystemExit):
        cli.main([])


def test_cli_inscribe_and_overlay(spark, tmp_path, capsys):
    np.save(tmp_path / "a.npy", np.stack([blob(), blob()]))
    base = ["--data-dir", str(tmp_path), "--results-dir", str(tmp_path / "r"), "--video-path", str(tmp_path / "a.npy")]
    cli.main(["inscribe", *base, "--canonical-height", "20", "--smoothing-window"])
    assert np.load(tmp_path / "r" / "aligned" / "a.npy").shape == (2, 20, 40, 3)
    cli.main(["overlay", *base])
    assert np.load(tmp_path / "r" / "aligned" / "a_overlay.npy").shape == (2, 60, 120, 3)
    first = (tmp_path / "r" / "aligned" / "a.csv").stat().st_mtime_ns
    cli.main(["overlay", *base])
    assert (tmp_path / "r" / "aligned" / "a.csv").stat().st_mtime_ns == first
    cli.main(["overlay", *base, "--smoothing-sigma", "1.0"])
    assert (tmp_path / "r" / "aligned" / "a.csv").stat().st_mtime_ns != first
    with pytest.raises(SystemExit) as e:
        cli.main(["inscribe", *base, "--smoothing-window", "3", "--smoothing-sigma", "1"])
    assert e.value.code == 2
    with pytest.raises(SystemExit):
        cli.main(["inscribe", *base[:4], "--pose-path", str(tmp_path / "p.csv")])


def test_ffmpeg_is_asked_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(encoders.shutil, "which", lambda _: None)
    with pytest.raises(OSError, match="ffmpeg"):
        encoders.ffmpeg_encoder()("x", 1, 1, 1, 1.0, iter([]))


def test_results_are_reused_by_content(spark, tmp_path, capsys):
    """Another recording or pose file under the same name is computed again, and only its own recording is."""
    data, out = tmp_path / "d", tmp_path / "r" / "aligned"
    (tmp_path / "r" / "pose").mkdir(parents=True)
    data.mkdir()
    frames.register_decoder(".mp4", frames.decode_npy)
    videos.register_probe(".mp4", lambda path: (2, 24.0, 120, 60))
    save = lambda name, x0: np.save(open(data / name, "wb"), np.stack([blob(x0), blob(x0)]))
    run = ["overlay", "--data-dir", str(data), "--results-dir", str(tmp_path / "r"), "--pose-dir", str(tmp_path / "r" / "pose")]

    def computed(*more):
        capsys.readouterr()
        cli.main([*run, *more])
        return {line.split("/")[-1] for line in capsys.readouterr().out.splitlines() if line.endswith(".csv")}

    names = ["session-1_cuttle-1", "session-1_cuttle-2"]
    try:
        for n in names:
            save(f"{n}.mp4", 20)
        assert computed() == {f"{n}.csv" for n in names} and computed() == set()
        save(f"{names[0]}.mp4", 24)
        assert computed() == {f"{names[0]}.csv"} and computed() == set()
        pose = tmp_path / "r" / "pose" / f"{names[1]}.csv"
        pose.write_text(POSE + "0,80,30,1,0,0,0,20,30,1\n1,80,30,1,0,0,0,20,30,1\n")
        assert computed() == {f"{names[1]}.csv"} and computed() == set()
        pose.write_text(POSE + "0,82,30,1,0,0,0,20,30,1\n1,80,30,1,0,0,0,20,30,1\n")
        assert computed() == {f"{names[1]}.csv"}
        pose.unlink()
        assert computed() == {f"{names[1]}.csv"}
        assert computed("--thresh", "3") == {f"{n}.csv" for n in names}
        (out / f"{names[0]}.csv").unlink()
        assert computed("--thresh", "3") == {f"{names[0]}.csv"}
    finally:
        del frames.FrameSource.decoders[".mp4"]
        videos._probes.clear()


def test_digests_are_of_blocks(spark, tmp_path):
    import hashlib

    (tmp_path / "a").write_bytes(b"abcdefg")
    (tmp_path / "b").write_bytes(b"")
    got = {r["path"].split("/")[-1]: r["digest"] for r in results.digests(spark, [tmp_path / "a", tmp_path / "b"], block_bytes=3).collect()}
    of = lambda *parts: hashlib.sha256("".join(hashlib.sha256(p).hexdigest() for p in parts).encode()).hexdigest()
    assert got == {"a": of(b"abc", b"def", b"g"), "b": of(b"")}


def test_warnings_open_every_recording_once(spark, tmp_path):
    mp4(tmp_path / "session-1_cuttle-1.mp4")
    _, warnings = pipelines.build_manifest(spark, tmp_path)
    plan = warnings._jdf.queryExecution().executedPlan().toString()
    assert sum("MapInPandas" in line and "fps" in line for line in plan.split("\n")) == 1
    assert [tuple(r) for r in warnings.collect()] == [(f"{tmp_path}/session-1_cuttle-1.mp4", "no blank-frames file")]
