"""Rigid registration: the voxel grid against all distances, frames that start from the one before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.functions.pose import POSE
from trajlake.operators import solve
from trajlake.plans import catalog


@pytest.mark.parametrize("kind", ["box", "sheet", "line", "one place", "far queries"])
def test_voxel_grid_finds_the_nearest(kind):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(700, 3))
    points[:, {"sheet": [2], "line": [1, 2]}.get(kind, [])] = 0.5
    if kind == "one place":
        points[:] = 1.0
    at = rng.normal(size=(300, 3)) * (50 if kind == "far queries" else 1.5)
    near, gap = solve.VoxelGrid(points).nearest(np.concatenate([at, points[:50]]))
    d = ((np.concatenate([at, points[:50]])[:, None] - points[None]) ** 2).sum(2)
    assert (near == d.argmin(1)).all() and np.allclose(gap, d.min(1))


def turned(model, step_deg, n):
    out = []
    for f in range(n):
        a = np.radians(step_deg * f)
        r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
        out += [("c", f, i, *map(float, r @ p + [0.1 * f, 0, -0.05 * f])) for i, p in enumerate(model)]
    return out


def angle(r):
    return np.degrees(2 * np.arctan2(np.linalg.norm([r.qx, r.qy, r.qz]), r.qw))


@pytest.fixture(scope="module")
def scene():
    rng = np.random.default_rng(9)
    # Long and lopsided, so that a turn shows.
    return rng.normal(size=(150, 3)) * [3.0, 1.0, 0.4] + (rng.random((150, 1)) < 0.3) * [2.0, 1.5, 0.0]


def frames_of(spark, scene, step, n):
    clouds = spark.createDataFrame(turned(scene, step, n), "clip string, frame int, point_id bigint, x double, y double, z double").repartition(5)
    model = spark.createDataFrame([("c", i, *map(float, p)) for i, p in enumerate(scene)], "clip string, point_id bigint, x double, y double, z double")
    return model, clouds


def test_a_chain_follows_a_turn_that_no_single_frame_can(spark, scene):
    model, clouds = frames_of(spark, scene, 5.0, 25)
    chained = {r.frame: r for r in solve.register_frames(model, clouds, ["clip"], "frame", chain=True).collect()}
    assert sorted(chained) == list(range(25)) and all(angle(r) == pytest.approx(5.0 * f, abs=1e-3) for f, r in chained.items())
    alone = {r.frame: r for r in solve.register_frames(model, clouds, ["clip"], "frame").collect()}
    assert abs(angle(alone[24]) - 120) > 5


def test_chained_and_alone_agree_on_small_motions(spark, scene):
    model, clouds = frames_of(spark, scene, 0.5, 6)
    a, b = ({r.frame: r for r in solve.register_frames(model, clouds, ["clip"], "frame", chain=c).collect()} for c in (True, False))
    assert a.keys() == b.keys() and all([a[f][c] for c in POSE] == pytest.approx([b[f][c] for c in POSE], abs=1e-6) for f in a)


def test_frames_without_a_fit_break_no_chain(spark, scene):
    model, clouds = frames_of(spark, scene, 5.0, 12)
    clouds = clouds.where("frame <> 5 or point_id < 3").unionByName(clouds.where("frame = 1").withColumn("clip", F.lit("no model")))
    out = {r.frame: r for r in solve.register_frames(model, clouds, ["clip"], "frame", chain=True).collect()}
    assert sorted(out) == [f for f in range(12) if f != 5] and angle(out[11]) == pytest.approx(55.0, abs=1e-3)
    assert solve.register_frames(model, clouds.limit(0), ["clip"], "frame", chain=True).count() == 0


@pytest.mark.parametrize("chain", [False, True])
def test_clouds_beyond_the_cap_are_fitted_whole(spark, chain):
    model, clouds = frames_of(spark, np.random.default_rng(4).normal(size=(4500, 3)), 5.0, 2)
    out = {r.frame: r for r in solve.register_frames(model, clouds, ["clip"], "frame", most=None, chain=chain).collect()}
    assert sorted(out) == [0, 1] and all(r.n == 3600 and r.rmse == pytest.approx(0, abs=1e-9) and angle(r) == pytest.approx(5.0 * f, abs=1e-6) for f, r in out.items())


@pytest.mark.parametrize("query", ["i2_register_frames", "i2_register_chained"])
def test_queries_register_every_point(spark, tmp_path, query):
    rng = np.random.default_rng(5)
    rows = [(i, 3, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(4100, 10)) * 0.125)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.n for r in catalog.queries()[query](spark, str(tmp_path)).collect()} == {3280.0}


def test_a_crowded_grid_narrows_its_cells():
    points = np.concatenate([np.random.default_rng(6).normal(size=(3000, 3)) * 0.01, [[10.0, 10.0, 10.0]]])
    grid = solve.VoxelGrid(points)
    sizes = np.unique(grid._grid(0)[0], return_counts=True)[1].astype(float)
    assert (sizes**2).sum() <= 4 * len(points)
