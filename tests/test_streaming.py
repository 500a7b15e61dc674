import datetime

import numpy as np
import pytest

from trajlake.operators import seq
from trajlake.streaming.grasps import ROCKSDB, stream_grasps, stream_schmitt

SCHEMA = "clip string, frame bigint, width double"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"c{i % 3}", i, None if i % 7 == 0 else float((i * 37) % 100)) for i in range(90)]
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], SCHEMA).coalesce(1).write.json(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{tmp_path}/in")
    q = stream_schmitt(stream, 20.0, 60.0).writeStream.format("memory").queryName("grasps").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        got = {(r.clip, r.frame): r.closed for r in spark.table("grasps").collect()}
    finally:
        q.stop()
    want = seq.schmitt(spark.createDataFrame(rows, SCHEMA), "width", 20.0, 60.0, ["clip"], "frame").collect()
    assert got == {(r.clip, r.frame): r.closed for r in want}


FRAME = "clip string, frame bigint, t timestamp, width double, hx double, hy double, hz double, ox double, oy double, oz double, hand_valid boolean, obj_valid boolean"


def hands(n=120):
    rng = np.random.default_rng(12)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for clip in ("a", "b", "c"):
        at = np.zeros(3)
        for i in range(n if clip != "c" else 2):
            at = at + rng.normal(size=3) * 0.02
            obj = at + rng.normal(size=3) * (0.01 if i // 7 % 2 else 0.08)
            width = None if rng.random() < 0.1 else float(rng.uniform(0, 0.12))
            rows.append((clip, i, start + datetime.timedelta(milliseconds=100 * i), width, *map(float, at), *map(float, obj), bool(rng.random() < 0.95), bool(rng.random() < 0.95)))
    return rows


def test_shuffled_and_late_frames_give_the_batch_result(spark, tmp_path):
    rows = hands()
    # Frames come up to three seconds out of order, in eight batches.
    rng = np.random.default_rng(1)
    order = sorted(range(len(rows)), key=lambda k: rows[k][1] + rng.uniform(-15, 15))
    for k in range(8):
        spark.createDataFrame([rows[i] for i in order[len(order) * k // 8 : len(order) * (k + 1) // 8]], FRAME).coalesce(1).write.json(f"{tmp_path}/in/{k}")
    far = rows[0][2] + datetime.timedelta(hours=1)
    for k in (8, 9):
        spark.createDataFrame([("late", k, far + datetime.timedelta(hours=k), 1.0, *[0.0] * 6, True, True)], FRAME).coalesce(1).write.json(f"{tmp_path}/in/{k}")
    batch = seq.motion_coupling(seq.contact(spark.createDataFrame(rows, FRAME)), 10.0, ["clip"], "frame")
    want = {(r.clip, r.frame): (r.contact, r.coupled, r.closed) for r in seq.grasp_state(batch, "width", 0.06, 0.08, ["clip"], "frame").collect()}
    assert len({v for v in want.values()}) > 4
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with pytest.raises(ValueError, match="providerClass"):
        stream_grasps(spark.readStream.schema(FRAME).json(f"{tmp_path}/in"), 0.06, 0.08, 10.0)
    spark.conf.set(key, ROCKSDB)
    try:
        stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{tmp_path}/in")
        q = stream_grasps(stream, 0.06, 0.08, 10.0, delay="5 seconds", idle="20 seconds").writeStream.format("memory").queryName("hands").option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
            got = spark.table("hands").where("clip <> 'late'").collect()
        finally:
            q.stop()
    finally:
        spark.conf.set(key, before)
    assert len(got) == len(rows)
    assert {(r.clip, r.frame): (r.contact, r.coupled, r.closed) for r in got} == want
