"""Behaviours of the reference that small tables show."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.functions.pose import POSE
from trajlake.operators import aggs, gates, joins, project, sample, seq, solve
from trajlake.sources import capture, export


def flags(spark, values):
    return spark.createDataFrame([("a", i, bool(v)) for i, v in enumerate(values)], "clip string, frame int, closed boolean")


@pytest.mark.parametrize(
    ("before", "after"),
    [([0, 0, 1, 0, 0, 0], [0, 0, 0, 0, 0, 0]), ([0, 0, 0, 1, 1, 1, 0, 0], [0, 0, 0, 1, 1, 1, 0, 0]), ([0, 0, 0, 0, 1, 1], [0, 0, 0, 0, 1, 1]), ([1, 0, 0, 0, 1, 0, 0, 0], [1, 0, 0, 0, 0, 0, 0, 0])],
)
def test_short_runs(spark, before, after):
    out = seq.absorb_short_runs(flags(spark, before), "closed", 3, ["clip"], "frame").orderBy("frame").collect()
    assert [int(r.closed) for r in out] == after


def test_blur_gate_cap(spark):
    rows = [("a", i, 100.0 if i < 20 else 1.0) for i in range(21)] + [("b", i, 10.0 + (i % 2) * 90) for i in range(30)] + [("c", i, None if i == 0 else 50.0) for i in range(20)]
    df = spark.createDataFrame(rows, "clip string, frame int, sharpness double")
    kept = {r.clip: r.n for r in gates.blur_gate(df, 0.3, 1.0, 0.15, ["clip"], "frame").where("keep").groupBy("clip").agg(F.count("*").alias("n")).collect()}
    assert kept == {"a": 20, "b": 26, "c": 19}


def test_near_duplicates_compare_with_last_kept(spark):
    rows = [("a", 0, 0), ("a", 1, 1), ("a", 2, 3), ("a", 3, 7), ("a", 4, 0)]
    df = spark.createDataFrame(rows, "clip string, frame bigint, phash bigint")
    assert [r.frame for r in gates.drop_near_duplicates(df, 2, ["clip"], "frame").orderBy("frame").collect()] == [0, 2, 4]
    assert gates.drop_near_duplicates(df, 0, ["clip"], "frame").count() == 5


@pytest.mark.parametrize(("demo", "ref", "verdict"), [(436.0, 572.0, "PASS"), (126.0, 700.0, "FAIL"), (212.0, 549.0, "MARGINAL"), (100.0, 0.0, "FAIL")])
def test_preflight(spark, demo, ref, verdict):
    df = spark.createDataFrame([(demo, ref)], "d double, r double")
    assert gates.preflight_verdict(df, "d", "r").first().verdict == verdict


def test_rate_map(spark):
    df = spark.range(5).select(joins.rate_map(F.col("id"), 20, 30, F.lit(100), "half_up").alias("m"))
    assert sorted(r.m for r in df.collect()) == [0, 2, 3, 5, 6]
    clamp = spark.range(5).select(joins.rate_map(F.col("id"), 20, 30, F.lit(3), "half_even").alias("m"))
    assert max(r.m for r in clamp.collect()) == 2


def poses(spark, rows):
    return spark.createDataFrame(rows, "clip string, frame bigint, tx double, ty double, tz double, qw double, qx double, qy double, qz double, valid boolean")


def test_pose_gap_fill_slerps(spark):
    s = float(np.sqrt(0.5))
    rows = [("a", 0, 9.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, False), ("a", 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, True), ("a", 2, 9.0, 9.0, 9.0, 1.0, 0.0, 0.0, 0.0, False), ("a", 3, 2.0, 0.0, 0.0, s, 0.0, 0.0, s, True), ("a", 4, 9.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, False), ("b", 0, 5.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, False)]
    out = {(r.clip, r.frame): r for r in seq.fill_pose_gaps(poses(spark, rows), ["clip"], "frame").collect()}
    assert out["a", 0].tx == 0 and out["a", 4].tx == 2 and out["a", 2].tx == 1
    assert out["a", 2].qz == pytest.approx(np.sin(np.pi / 8)) and out["b", 0].tx is None


def test_smoothing_matches_numpy(spark):
    rng = np.random.default_rng(3)
    q = rng.normal(size=(9, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    t = rng.normal(size=(9, 3))
    df = poses(spark, [("a", i, *map(float, t[i]), *map(float, q[i]), True) for i in range(9)] + [("b", i, float(i), 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, True) for i in range(2)])
    out = [r for r in seq.smooth_poses(df, 5, ["clip"], "frame").orderBy("clip", "frame").collect()]
    for i in range(1, 9):
        if q[i] @ q[i - 1] < 0:
            q[i:] *= -1
    for i in range(9):
        m = q[max(0, i - 2) : i + 3].mean(0)
        assert out[i].tx == pytest.approx(t[max(0, i - 2) : i + 3, 0].mean())
        assert [out[i][c] for c in POSE[3:]] == pytest.approx(list(m / np.linalg.norm(m)))
    assert [r.tx for r in out[9:]] == [0.0, 1.0]


def test_resample_counts(spark):
    rows = [("a", i, 2.0 * i / 60, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, True) for i in range(61)] + [("b", 0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, True)]
    df = poses(spark, rows).withColumns({"width": F.col("tx"), "flag": F.col("valid")})
    out = seq.resample(df, 60.0, 15.0, ["clip"], "frame").orderBy("clip", "k").collect()
    assert len(out) == 17 and out[15].tx == pytest.approx(2.0) and out[1].width == pytest.approx(2 / 15)


def test_scripted_grasp_has_one_grasp_and_one_release(spark):
    rows = []
    for i in range(120):
        x = 0.0 if i < 45 else min(0.3, 0.3 * (i - 45) / 45)
        gap = 0.085 if i < 30 or i >= 95 else 0.085 - 0.05 * min(1, (i - 30) / 12)
        rows.append(("a", i, gap, x, 0.0, 0.5, x + 0.01, 0.0, 0.5, True, True))
    df = spark.createDataFrame(rows, "clip string, frame bigint, width double, hx double, hy double, hz double, ox double, oy double, oz double, hand_valid boolean, obj_valid boolean")
    df = seq.adaptive_thresholds(seq.motion_coupling(seq.contact(df), 60.0, ["clip"], "frame"), "width", ["clip"], 0.06, 0.08, 0.015)
    for mode in ("frame", "last_frame"):
        out = aggs.grasp_summary(seq.grasp_state(df, "width", F.col("close_at"), F.col("open_at"), ["clip"], "frame", contact_mode=mode), ["clip"], "frame", "width").first()
        assert out.transitions == 2 and out.onset < out.release


def test_even_sample_and_cap(spark):
    df = spark.range(100).select(F.lit("a").alias("g"), F.col("id"))
    assert [r.id for r in sample.even_sample(df, 5, ["g"], "id").orderBy("id").collect()] == [0, 24, 49, 74, 99]
    assert [r.id for r in sample.even_sample(df, 1, ["g"], "id").collect()] == [0]
    assert sample.even_sample(df, 200, ["g"], "id").count() == 100
    a, b = (sorted(r.id for r in sample.seeded_cap(df, 10, 5, ["g"], "id").collect()) for _ in range(2))
    assert a == b and len(a) == 10


def test_sim3_recovers_scale_rotation_translation(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(size=(20, 3))
    r = solve.nearest_rotation(rng.normal(size=(3, 3)))
    q = 0.4 * p @ r.T + [1, 2, 3]
    rows = [("a", *map(float, x), *map(float, y)) for x, y in zip(p, q, strict=True)] + [("few", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double, u double, v double, w double")
    out = solve.fit_sim3(df, ["g"]).collect()
    assert len(out) == 1 and out[0].s == pytest.approx(0.4) and out[0].rmse < 1e-6 and [out[0].tx, out[0].ty, out[0].tz] == pytest.approx([1, 2, 3])


def test_icp_residual_of_moved_model(spark):
    rng = np.random.default_rng(7)
    p = rng.normal(size=(60, 3))
    model = spark.createDataFrame([("a", i, *map(float, x)) for i, x in enumerate(p)], "clip string, point_id bigint, x double, y double, z double")
    cloud = model.withColumn("frame", F.lit(1)).withColumn("x", F.col("x") + 0.5)
    out = solve.register_frames(model, cloud, ["clip"], "frame", trim=0.0).first()
    assert out.rmse < 1e-6 and out.tx == pytest.approx(0.5) and out.n == 60


def test_dominant_marker_is_never_an_average(spark):
    df = spark.createDataFrame([("s", 0)] * 114 + [("s", 17)] * 8, "run string, id int")
    out = aggs.dominant_marker(df, ["run"], "id", 3).first()
    assert (out.marker_id, out.n_detections, out.ignored) == (0, 114, [17])
    assert aggs.dominant_marker(df, ["run"], "id", 3, configured=5).first().marker_id is None
    assert aggs.dominant_marker(df, ["run"], "id", 200).first().marker_id is None


def test_nearest_layer_and_ties(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 0, "far"), (1, 1, 1.0, 1, "late"), (1, 1, 1.0, 0, "early")], "px int, py int, d double, layer int, v string")
    assert aggs.nearest_depth(df, ["px", "py"], "d", "v", "layer").first().v == "early"


def test_asof_ties_go_to_the_earlier(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 10.0), ("b", 0.0)], "g string, t double")
    right = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", 4.0)], "g string, t double")
    out = {(r.g, r.t): r.r_t for r in joins.asof_nearest(left, right, "t", ["g"], tolerance=1.0).collect()}
    assert out == {("a", 1.0): 0.0, ("a", 10.0): None, ("b", 0.0): None}


def test_near_hash_pairs(spark):
    rows = [(1, 0), (2, 7), (3, -1), (4, 1 << 62)]
    df = spark.createDataFrame(rows, "id bigint, h bigint")
    assert {(r.a, r.b) for r in joins.near_hashes(df, "id", "h", 3).collect()} == {(1, 2), (1, 4)}


def test_intrinsics(spark):
    df = spark.createDataFrame([(1920, 1080, 26.0), (1920, 1080, None), (1920, 1080, 0.5)], "width int, height int, focal_35mm double")
    out = project.derive_intrinsics(df, 0.8).collect()
    assert out[0].fx == pytest.approx(26 / 36 * 1920) and [r.source for r in out[1:]] == ["fallback_guess"] * 2 and out[1].self_calibrate


def test_npz_and_sparse_model_readers(spark, tmp_path):
    for k in range(2):
        buf = io.BytesIO()
        np.savez(buf, positions=np.arange(6.0).reshape(2, 3) + k, widths=np.array([np.nan, 0.1]), closed=np.array([0, 1]), timestamps=np.array([0.0, 0.1]))
        (tmp_path / f"e{k}.npz").write_bytes(buf.getvalue())
    out = capture.read_episode_arrays(spark, str(tmp_path)).orderBy("source_file", "k").collect()
    assert len(out) == 4 and out[0].width_m is None and out[3].closed and out[2].tx == 1.0
    model = tmp_path / "model"
    model.mkdir()
    (model / "cameras.bin").write_bytes(struct.pack("<QiiQQ4d", 1, 1, 1, 640, 480, 500, 500, 320, 240))
    (model / "images.bin").write_bytes(struct.pack("<Qi7di", 1, 3, 1, 0, 0, 0, 1, 2, 3, 1) + b"f.jpg\0" + struct.pack("<Q2dq", 1, 5.0, 6.0, 7))
    (model / "points3D.bin").write_bytes(struct.pack("<QQ3d3BdQ2i", 1, 7, 1, 2, 3, 255, 0, 0, 0.5, 1, 3, 0))
    t = capture.read_sparse_model(spark, str(model))
    assert t["cameras"].first().params == [500, 500, 320, 240] and t["images"].first().name == "f.jpg" and t["points"].first().r == 1.0
    assert [tuple(r)[:5] for r in t["observations"].collect()] == [(3, 0, 5.0, 6.0, 7)]


def test_training_table_refuses_late_frames(spark, tmp_path):
    rows = [(c, k, k / 10 + late) for c, late in (("a", 0.0), ("b", 0.001), (None, 5.0)) for k in range(3)]
    df = spark.createDataFrame(rows, "clip string, k int, t double").withColumns({"x": F.lit(1.0), "task": F.lit("t"), "ok": F.lit(True)})

    def write(name, df):
        export.write_training_table(df, str(tmp_path / name), ["clip"], "k", "t", 10.0, ["x"], ["x"], "task", "ok")

    with pytest.raises(ValueError, match="timestamps"):
        write("late", df)
    assert not (tmp_path / "late" / "data").exists()
    with pytest.raises(ValueError, match="timestamps"):
        write("null", df.withColumn("t", F.when(F.col("k") > 0, F.col("t"))))
    write("good", df.where("clip is null or clip = 'a'"))
    assert spark.read.parquet(str(tmp_path / "good" / "data")).count() == 3
    write("empty", df.limit(0))


def test_bundles_are_bounded(spark, tmp_path):
    rows = [("a", k, k / 10, 1.0, 2.0, float(k), None if k == 1 else 0.5, k == 2) for k in range(5)]
    df = spark.createDataFrame(rows, "clip string, frame int, t_s double, tx double, ty double, tz double, width_m double, closed boolean")
    export.write_episode_arrays(df, str(tmp_path), most=2)
    assert sorted(p.name for p in tmp_path.glob("*")) == ["a-0.npz", "a-1.npz", "a-2.npz"]
    back = capture.read_episode_arrays(spark, str(tmp_path)).orderBy("t_s").collect()
    assert [(r.k, r.tz, r.width_m, r.closed) for r in back] == [(k % 2, float(k), None if k == 1 else 0.5, k == 2) for k in range(5)]
