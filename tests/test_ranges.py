"""Large binary files in several tasks."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.sources import capture


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    rng = np.random.default_rng(4)
    folder = tmp_path_factory.mktemp("model")
    seen = {i: rng.integers(-1, 50, int(rng.integers(0, 400))) for i in range(60)}
    images = struct.pack("<Q", len(seen))
    for i, points in seen.items():
        name = f"{'long' * (400 if i == 7 else 1)}-{i}"
        images += struct.pack("<i7di", i, 1.0, 0.0, 0.0, 0.0, i / 2, 0.0, 0.0, 1) + name.encode() + b"\0" + struct.pack("<Q", len(points)) + b"".join(struct.pack("<ddq", i + k / 1000, -k, p) for k, p in enumerate(points))
    points = struct.pack("<Q", 3000) + b"".join(struct.pack("<Q3d3BdQ", k, k, -k, 0.5, k % 256, 0, 255, 0.1, k % 9) + b"\7" * 8 * (k % 9) for k in range(3000))
    (folder / "images.bin").write_bytes(images)
    (folder / "points3D.bin").write_bytes(points)
    (folder / "cameras.bin").write_bytes(struct.pack("<QiiQQ4d", 1, 1, 1, 640, 480, 500, 500, 320, 240))
    return folder, seen


@pytest.mark.parametrize("range_bytes", [1, 20_000, 1 << 30])
def test_sparse_model_in_ranges(spark, model, range_bytes):
    folder, seen = model
    t = capture.read_sparse_model(spark, str(folder), range_bytes if range_bytes > 1 else 2_000)
    got = {(r.image_id, r.kp): (r.u, r.v, r.point_id) for r in t["observations"].collect()}
    assert got == {(i, k): (i + k / 1000, -k, int(p) if p >= 0 else None) for i, v in seen.items() for k, p in enumerate(v)}
    images = {r.image_id: (r.name, r.tx) for r in t["images"].collect()}
    assert len(images) == 60 and images[7] == ("long" * 400 + "-7", 3.5)
    points = t["points"].orderBy("point_id").collect()
    assert [(r.point_id, r.x, r.y) for r in points] == [(k, k, -k) for k in range(3000)] and points[300].r == pytest.approx(44 / 255)
    assert t["cameras"].first().params == [500.0, 500.0, 320.0, 240.0]


def test_one_file_is_read_by_several_tasks(spark, model):
    folder, _ = model
    rows = capture.read_sparse_model(spark, str(folder), 10_000)["observations"]
    tasks = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 8


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
@pytest.mark.parametrize("shape", [(3,), (4, 4)])
def test_bundles_in_ranges(spark, tmp_path, save, shape):
    n = 500
    p = np.arange(n * int(np.prod(shape)), dtype=float).reshape(n, *shape)
    w = np.where(np.arange(n) % 3, np.arange(n) / 10, np.nan).astype(np.float32)
    save(tmp_path / "a.npz", positions=p, widths=w, closed=np.arange(n) % 2 == 0, timestamps=np.arange(n) / 60)
    out = capture.read_episode_arrays(spark, str(tmp_path), range_bytes=4_000)
    rows = out.orderBy("k").collect()
    assert [r.k for r in rows] == list(range(n)) and rows[3].width_m is None and rows[4].width_m == pytest.approx(0.4)
    assert [(r.tx, r.ty, r.tz) for r in rows] == [tuple(map(float, x[:3] if len(shape) == 1 else x[:3, 3])) for x in p]
    tasks = out.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 3 if save is np.savez else tasks == 1


def test_a_file_that_ends_too_soon(spark, model, tmp_path):
    folder, _ = model
    (tmp_path / "images.bin").write_bytes((folder / "images.bin").read_bytes()[:-5])
    with pytest.raises(Exception, match="ends at"):
        capture.read_sparse_model(spark, str(tmp_path))["images"].count()
