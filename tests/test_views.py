"""Nearest and covered pixels against the pairs of cameras and points that view_pixels forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.operators import aggs, joins, views
from trajlake.plans import catalog

KEYS = ["clip", "frame", "px", "py"]


def scene(spark, seed, n_cameras, n_points, spread):
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(n_cameras, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    t = rng.normal(size=(n_cameras, 3)) * spread
    cams = [(i % 3, i, *map(float, t[i]), *map(float, q[i])) for i in range(n_cameras)] + [(0, 900, None, *[0.0] * 6)]
    points = rng.normal(size=(n_points, 3)) * spread
    # Some points share a place, and some are where a camera is.
    points[: n_points // 10] = points[n_points // 2]
    points[-n_cameras:] = t
    cloud = [(i, *map(float, p)) for i, p in enumerate(points)] + [(9000, None, 0.0, 0.0), (9001, float("nan"), 0.0, 0.0)]
    pose = "tx double, ty double, tz double, qw double, qx double, qy double, qz double"
    return spark.createDataFrame(cams, f"clip int, frame bigint, {pose}"), spark.createDataFrame(cloud, "point_id bigint, x double, y double, z double")


@pytest.mark.parametrize(("spread", "splat", "ring", "most"), [(0.12, 0, 1, 1 << 20), (0.12, 1, 0, 700), (1.5, 0, 1, 1 << 20), (4.0, 1, 2, 1500)])
def test_nearest_and_covered_pixels_are_those_of_all_pairs(spark, monkeypatch, spread, splat, ring, most):
    monkeypatch.setattr(views, "PART_POINTS", most)
    monkeypatch.setattr(views, "TURN", 3)
    cams, cloud = scene(spark, splat + ring, 40, 3000, spread)
    given = dict(fx=20.0, width=32, height=24, far=4.0, splat=splat, fill_ring=ring)
    real = cloud.where("x is not null and not isnan(x)")
    pairs = joins.view_pixels(cams, real, **given).cache()
    want = {tuple(r) for r in aggs.nearest_depth(pairs, KEYS, "depth", "point_id").collect()}
    pixels, once = views.nearest_pixels(cams, cloud, **given)
    assert once == (most > 3000)
    got = [tuple(r) for r in (pixels if once else aggs.nearest_depth(pixels, KEYS, "depth", "point_id")).collect()]
    assert len(got) == len(want) > 1000 and set(got) == want
    every = views.widened(views.visible_points(cams, cloud, 20.0, 32, 24, far=4.0, splat=splat), 32, 24, splat + ring)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, pairs.collect()))
    counts = {(r.clip, r.frame): r["count"] for r in pairs.select(KEYS).distinct().groupBy("clip", "frame").count().collect()}
    assert {(r.clip, r.frame): r.n_pixels for r in views.covered_pixels(cams, cloud, **given).collect()} == counts


def test_no_points_and_no_cameras(spark):
    cams, cloud = scene(spark, 5, 5, 50, 0.1)
    for a, b in ((cams.limit(0), cloud), (cams, cloud.limit(0))):
        assert views.nearest_pixels(a, b, 20.0, 32, 24)[0].count() == views.covered_pixels(a, b, 20.0, 32, 24).count() == views.visible_points(a, b, 20.0, 32, 24).count() == 0


@pytest.mark.parametrize("name", ["d13_view_pixels", "e20_view_coverage", "e28_nearest_depth"])
def test_queries_join_no_blocks(spark, monkeypatch, name):
    def no_blocks(*_, **__):
        raise AssertionError("cameras were joined with blocks")

    monkeypatch.setattr(joins, "view_pixels", no_blocks)
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").where(F.col("clip") < 3).count() > 0


@pytest.mark.parametrize("most", [1 << 20, 700])
def test_rows_of_a_camera_go_by_pixel(spark, monkeypatch, most):
    monkeypatch.setattr(views, "PART_POINTS", most)
    cams, cloud = scene(spark, 3, 20, 2000, 0.12)
    order = {}
    for r in views.visible_points(cams, cloud, 20.0, 32, 24, far=4.0, splat=1).withColumn("part", F.spark_partition_id()).collect():
        order.setdefault((r.part, r.clip, r.frame), []).append((r.u, r.v))
    assert sum(map(len, order.values())) > 1000 and len({p for seen in order.values() for p in seen}) > 100
    assert all(seen == sorted(seen) for seen in order.values())
