"""Sequences cut into parts give what whole ones give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.functions.pose import POSE
from trajlake.operators import joins, seq
from trajlake.operators.scan import Scan


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(6)
    rows = []
    for clip, n in (("a", 211), ("b", 40), (None, 97), ("c", 1), ("d", 2), ("e", 6)):
        q = rng.normal(size=(n, 4))
        q /= np.linalg.norm(q, axis=1)[:, None]
        for i in range(n):
            gone = clip == "a" and 50 < i < 150
            width = None if gone or rng.random() < 0.4 else float(rng.integers(0, 100))
            # Uneven in time: most of clip a lies in a hundredth of its span.
            t = float(i) if i < 200 else float(i * 100)
            rows.append((clip, i, t, width, bool(rng.random() < 0.8), *map(float, rng.normal(size=3)), *map(float, q[i]), bool(not gone and rng.random() < 0.5)))
    return spark.createDataFrame(rows, "clip string, frame bigint, t double, width double, closed boolean, tx double, ty double, tz double, qw double, qx double, qy double, qz double, valid boolean").repartition(5).cache()


def rows_of(df):
    return sorted((tuple(df.columns), *df.collect()), key=repr)


def same(a, b):
    assert a.columns == b.columns
    a, b = (sorted(d.collect(), key=lambda r: (str(r["clip"]), r["frame"])) for d in (a, b))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or u is not None and v is not None and u == pytest.approx(v, rel=1e-9, abs=1e-9) for u, v in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("stretch", [1, 7, 60])
@pytest.mark.parametrize(
    "run",
    [
        lambda d, s: seq.schmitt(d, "width", 20.0, 60.0, ["clip"], "frame", stretch=s),
        lambda d, s: seq.schmitt(d, "width", 20.0, 60.0, ["clip"], "frame", out="new", stretch=s),
        lambda d, s: seq.absorb_short_runs(d, "closed", 3, ["clip"], "t", stretch=s),
        lambda d, s: seq.fill_gaps(d, "width", ["clip"], "t", stretch=s),
        lambda d, s: seq.fill_pose_gaps(d, ["clip"], "t", stretch=s),
        lambda d, s: seq.smooth_poses(d, 5, ["clip"], "frame", stretch=s),
        lambda d, s: seq.smooth_poses(d, 31, ["clip"], "frame", stretch=s),
    ],
)
def test_parts_give_the_whole(frames, run, stretch):
    same(run(frames, stretch), run(frames, 1 << 30))


@pytest.mark.parametrize("stretch", [3, 40])
def test_asof_in_parts(frames, stretch):
    named = frames.where("clip is not null")
    left, right = named.select("clip", "frame", "t"), named.where("valid").select("clip", (F.col("t") + 0.4).alias("t"), F.col("frame").alias("of"))
    same(*(joins.asof_nearest(left, right, "t", ["clip"], tolerance=5.0, stretch=s) for s in (stretch, 1 << 30)))


@pytest.mark.parametrize("window", [2, 4, 5, 8, 31])
def test_means_of_any_width_match_numpy(frames, window):
    got = {(r.clip, r.frame): r for r in seq.smooth_poses(frames, window, ["clip"], "frame", stretch=20).collect()}
    by_clip = {}
    for r in sorted(frames.collect(), key=lambda r: r.frame):
        by_clip.setdefault(r.clip, []).append(r)
    for clip, rows in by_clip.items():
        n = len(rows)
        size = min(window, n)
        size = size if size % 2 else size + 1 if n >= window else size - 1
        for i in range(n):
            lo, hi = max(0, i - size // 2), min(n, i + size // 2 + 1)
            want = np.mean([r.tx for r in rows[lo:hi]]) if n >= 3 else rows[i].tx
            assert got[clip, i].tx == pytest.approx(want, abs=1e-9)
            assert n < 3 or np.linalg.norm([got[clip, i][c] for c in POSE[3:]]) == pytest.approx(1.0)


@pytest.mark.parametrize("stretch", [2, 1 << 30])
def test_rows_without_an_order_value_come_first(spark, stretch):
    df = spark.createDataFrame([("a", None, 1), ("a", 3.0, None), ("a", 1.0, None), ("a", 2.0, 5), ("a", float("inf"), None)], "g string, at double, v int")
    out = {r["at"]: r for r in Scan(df, ["g"], "at", stretch).last(up=F.col("v")).next(down=F.col("v")).total(n=F.lit(1)).previous(before=F.col("v")).following(after=F.col("v")).done("up", "down", "n", "before", "after").collect()}
    assert [tuple(out[k][c] for c in ("up", "down", "n")) for k in (None, 1.0, 2.0, 3.0, float("inf"))] == [(1, 1, 1), (1, 5, 2), (5, 5, 3), (5, None, 4), (5, None, 5)]
    assert out[1.0].before == 1 and out[2.0].after is None and out[1.0].after == 5 and out[None].before is None


def test_a_long_sequence_is_scanned_by_many_tasks(spark):
    df = spark.range(60_000).select(F.lit("a").alias("clip"), F.col("id").alias("frame"), F.when(F.col("id") % 1000 == 0, F.col("id").cast("double")).alias("v"))
    scan = Scan(df, ["clip"], "frame", 1000)
    sizes = [r["count"] for r in scan.df.groupBy("_part").count().collect()]
    assert len(sizes) >= 60 and max(sizes) <= 2000
    filled = seq.fill_gaps(df, "v", ["clip"], "frame", stretch=1000)
    assert filled.where(F.abs(F.col("v") - F.least(F.col("frame"), F.lit(59_000))) > 1e-6).count() == 0
