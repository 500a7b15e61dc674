"""Queries that write the given tables as binary bundles, sparse models and training episodes, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlake.functions.pose import POSE
from trajlake.plans.bindings import TRAJ, traj
from trajlake.plans.files import folder
from trajlake.plans.registry import query
from trajlake.plans.sequences import rounded
from trajlake.sources import capture, export


@query(f"""WITH {TRAJ} SELECT clip, frame, round(frame / 60.0, 6) AS t_s, round(tx, 6) + 0.0 AS tx, round(ty, 6) + 0.0 AS ty, round(tz, 6) + 0.0 AS tz,
    CASE WHEN frame % 4 <> 0 THEN round(ox, 6) + 0.0 END AS width_m, valid AS closed FROM traj""")
def a6_read_episode_arrays(spark, sf):
    path = folder(spark, "arrays")
    rows = traj(spark, sf).select("clip", "frame", (F.col("frame") / 60.0).alias("t_s"), "tx", "ty", "tz", F.when(F.col("frame") % 4 != 0, F.col("ox")).alias("width_m"), F.col("valid").alias("closed"))
    export.write_episode_arrays(rows, path)
    got = capture.read_episode_arrays(spark, path)
    name = [F.regexp_extract("source_file", r"(\d+)-(\d+)\.npz$", i) for i in (1, 2)]
    got = got.withColumns({"clip": name[0].cast("int"), "frame": name[1].cast("bigint") * export.BUNDLE_FRAMES + F.col("k")})
    return rounded(got.select("clip", "frame", "t_s", "tx", "ty", "tz", "width_m", "closed"), ["t_s", "tx", "ty", "tz", "width_m"])


@query(f"""WITH {TRAJ} SELECT vec_id::int AS image_id, 'f' || vec_id AS name, (CASE WHEN vec_id % 2 = 0 THEN 640 ELSE 1280 END)::bigint AS width, round(tz, 6) + 0.0 AS tz,
    k.kp::int AS kp, round(CASE k.kp WHEN 0 THEN tx ELSE ox END, 6) + 0.0 AS u, CASE k.kp WHEN 0 THEN round(oz, 6) + 0.0 END AS x FROM traj, (VALUES (0), (1)) AS k(kp)""")
def a7_read_sparse_model(spark, sf):
    path = folder(spark, "models")
    t = traj(spark, sf).withColumns({"model": F.concat_ws("-", "clip", F.floor(F.col("frame") / export.BUNDLE_FRAMES)), "image_id": F.col("vec_id").cast("int"), "camera_id": (F.col("vec_id") % 2 + 1).cast("int")})
    size = F.when(F.col("camera_id") == 1, 640).otherwise(1280)
    params = F.array(*[F.lit(x) for x in (500.0, 500.0, 320.0, 240.0)])
    cameras = t.select("model", "camera_id").distinct().select("*", F.lit(1).alias("kind"), size.alias("width"), F.lit(480).alias("height"), params.alias("params"))
    seen = [F.struct(F.col(u).alias("u"), F.col(v).alias("v"), p.cast("bigint").alias("point_id")) for u, v, p in (("tx", "ty", F.col("vec_id")), ("ox", "oy", F.lit(-1)))]
    images = t.select("model", "image_id", *POSE, "camera_id", F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("name"), F.array(*seen).alias("seen"))
    track = F.array(F.struct("image_id", F.lit(0).alias("kp")))
    points = t.select("model", F.col("vec_id").alias("point_id"), F.col("oz").alias("x"), F.col("ox").alias("y"), F.col("oy").alias("z"), *[F.lit(0.5).alias(c) for c in "rgb"], F.lit(0.1).alias("error"), track.alias("track"))
    export.write_sparse_models(cameras, images, points, path)
    got = {k: v.withColumn("model", F.regexp_extract("source_file", r"model=([^/]+)/", 1)) for k, v in capture.read_sparse_model(spark, path).items()}
    views = got["images"].join(got["cameras"].select("model", "camera_id", "width"), ["model", "camera_id"]).select("model", "image_id", "name", "width", "tz")
    rows = got["observations"].join(views, ["model", "image_id"]).join(got["points"].select("model", "point_id", "x"), ["model", "point_id"], "left")
    return rounded(rows.select("image_id", "name", "width", "tz", "kp", "u", "x"), ["tz", "u", "x"])


@query(f"""WITH {TRAJ} SELECT row_number() OVER (ORDER BY clip, frame) - 1 AS index, dense_rank() OVER (ORDER BY clip) - 1 AS episode_index, frame AS frame_index, round(frame / 60.0, 6) AS timestamp,
    dense_rank() OVER (ORDER BY clip % 3) - 1 AS task_index, round(tx, 6) + 0.0 AS state_x, CASE WHEN frame % 4 <> 0 THEN round(ox, 6) + 0.0 END AS action_width,
    frame = max(frame) OVER (PARTITION BY clip) AS done, frame = max(frame) OVER (PARTITION BY clip) AND clip % 2 = 0 AS success FROM traj""")
def p9_training_table(spark, sf):
    path = folder(spark, "training")
    rows = traj(spark, sf).withColumns({"t": F.col("frame") / 60.0, "width": F.when(F.col("frame") % 4 != 0, F.col("ox")), "task": F.concat(F.lit("task "), F.col("clip") % 3), "success": F.col("clip") % 2 == 0})
    export.write_training_table(rows, path, ["clip"], "frame", "t", 60.0, list(POSE), [*POSE, "width"], "task", "success")
    got = spark.read.parquet(f"{path}/data")
    got = got.select(
        "index", "episode_index", "frame_index", "timestamp", "task_index", F.get("`observation.state`", F.lit(0)).cast("double").alias("state_x"),
        F.get("action", F.lit(7)).cast("double").alias("action_width"), F.col("`next.done`").alias("done"), F.col("`next.success`").alias("success"),
    )
    return rounded(got, ["timestamp", "state_x", "action_width"])
