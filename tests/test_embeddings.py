import numpy as np
import pytest

from strandline.operators import embeddings as emb


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")


def test_projection_is_along_the_principal_axes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)) * [5, 3, 1, 0.5, 0.1] + [1, 2, 3, 4, 5]
    got = np.array([(r["x"], r["y"]) for r in emb.project(table(spark, x)).orderBy("vec_id").collect()])
    away = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(away, full_matrices=False)
    axes = [a * np.sign(a[abs(a).argmax()]) for a in axes[:2]]
    assert got == pytest.approx(away @ np.array(axes).T, abs=1e-4)


def test_clusters_are_those_of_lloyds_iteration(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(40, 3)) + c for c in (0, 6, -6)]).astype(np.float32).astype(float)
    rng.shuffle(x)
    centres = x[:4].copy()
    for _ in range(6):
        near = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        for k in range(4):
            if (near == k).any():
                centres[k] = x[near == k].mean(0)
    want = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
    got = [r["cluster"] for r in emb.clusters(table(spark, x), "vec_id", k=4, rounds=6).orderBy("vec_id").collect()]
    assert got == want.tolist()


def test_vectors_meet_their_frames(spark):
    frames = spark.createDataFrame([(1, 0, 5, "a"), (1, 0, 6, "b")], "session long, fish long, frame_idx long, path string")
    vectors = spark.createDataFrame([(1, 0, 6, [1.0]), (2, 0, 6, [1.0])], "session long, fish long, frame_idx long, embedding array<double>")
    assert [r["path"] for r in emb.with_frames(vectors, frames, ["session", "fish", "frame_idx"]).collect()] == ["b"]
