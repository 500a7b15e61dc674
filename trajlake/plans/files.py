"""Queries that write the given tables in the capture pipeline's file formats and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions.pose import POSE, cols, lits, rotate, upright
from trajlake.plans.bindings import SIG, TRAJ, sig, table, traj
from trajlake.plans.registry import query
from trajlake.plans.sequences import rounded
from trajlake.sources import capture

#: Frames of a manifest, about.
MANIFEST_FRAMES = 20_000


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        # Other machines don't see this one's temporary folders; they all see the warehouse.
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    elif not base:
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trajlake-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def _matrix(df: DataFrame) -> DataFrame:
    """``df`` with m, the row-major 4x4 of its pose."""
    axes = [rotate(cols(*POSE[3:]), lits(*v)) for v in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]
    rows = [x for i in range(3) for x in (axes[0][i], axes[1][i], axes[2][i], F.col(POSE[i]))]
    return df.withColumn("m", F.array(*rows, *lits(0, 0, 0, 1)))


def _json_files(df: DataFrame, spark: SparkSession, tag: str) -> str:
    """Writes the column ``value`` as text, each row a file of its own group ``clip``."""
    path = folder(spark, tag)
    df.repartition("clip").write.partitionBy("clip").text(path)
    return path


def _rounded_pose(df: DataFrame) -> DataFrame:
    df = df.withColumns(dict(zip(POSE[3:], upright(cols(*POSE[3:])), strict=True)))
    return rounded(rounded(df, POSE[:3]), POSE[3:], 4)


@query(f"WITH {SIG} SELECT clip::varchar AS clip_id, frame::int AS frame_idx, printf('%05d', frame) AS name, round(t, 6) AS t_s FROM sig")
def a1_read_manifest(spark, sf):
    frames = sig(spark, sf).groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("frame", "t"))).alias("f"))
    video = F.struct(F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(30.0).alias("fps"))
    clip = F.struct(F.lit("demo").alias("kind"), video.alias("video"), F.transform("f.frame", lambda x: F.format_string("%05d", x)).alias("frame_names"), F.col("f.t").alias("frame_times_s"))
    # A manifest holds the clips of a run: one file for each would be as many files as clips.
    files = table(spark, sf, "events").count() // MANIFEST_FRAMES + 1
    runs = frames.select(F.pmod(F.xxhash64("clip"), F.lit(files)).alias("run"), F.struct(F.col("clip").cast("string").alias("key"), clip.alias("value")).alias("clip"))
    runs = runs.groupBy("run").agg(F.map_from_entries(F.collect_list("clip")).alias("clips"))
    path = _json_files(runs.select(F.col("run").alias("clip"), F.to_json(F.struct(F.lit("run").alias("run_id"), "clips")).alias("value")), spark, "manifest")
    return rounded(capture.read_manifest(spark, path)[1].select("clip_id", "frame_idx", "name", "t_s"), ["t_s"])


_RQ = ", ".join(f"round(CASE WHEN qw < 0 THEN -{c} ELSE {c} END, 4) + 0.0 AS {c}" for c in POSE[3:])
_RT = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in POSE[:3])


@query(f"WITH {TRAJ} SELECT (row_number() OVER (PARTITION BY clip ORDER BY frame) - 1)::int AS idx, clip, round(frame / 60.0, 6) AS t_s, {_RT}, {_RQ} FROM traj WHERE valid")
def a2_read_device_poses(spark, sf):
    t = _matrix(traj(spark, sf)).withColumn("m", F.when(F.col("valid"), F.col("m")).otherwise(F.slice("m", 1, 12)))
    entry = F.struct("frame", (F.col("frame") / 60.0).alias("timestamp"), F.when(F.col("clip") % 2 == 0, F.col("m")).alias("transform"), F.when(F.col("clip") % 2 == 1, F.col("m")).alias("matrix"))
    rows = t.groupBy("clip").agg(F.array_sort(F.collect_list(entry)).alias("frames"))
    value = F.when(F.col("clip") % 3 == 0, F.to_json("frames")).otherwise(F.to_json(F.struct("frames")))
    got = capture.read_device_poses(spark, _json_files(rows.select("clip", value.alias("value")), spark, "device"))
    got = got.withColumn("clip", F.regexp_extract("source_file", r"clip=(\d+)", 1).cast("int"))
    return _rounded_pose(rounded(got.select("idx", "clip", "t_s", *POSE), ["t_s"]))


@query(f"WITH {TRAJ} SELECT 'c' || vec_id AS name, 640 AS width, 500.0::double AS fx, {_RT}, {_RQ} FROM traj")
def a3_read_cameras(spark, sf):
    rows4 = F.array(*[F.slice("m", 4 * i + 1, 4) for i in range(4)])
    cams = _matrix(traj(spark, sf)).groupBy("clip").agg(F.collect_list(F.struct(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("name"), rows4.alias("transform"))).alias("cameras"))
    intr = F.struct(F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(500.0).alias("fx"), F.lit(500.0).alias("fy"), F.lit(320.0).alias("cx"), F.lit(240.0).alias("cy"))
    got = capture.read_cameras(spark, _json_files(cams.select("clip", F.to_json(F.struct(intr.alias("intrinsics"), "cameras")).alias("value")), spark, "cameras"))
    return _rounded_pose(got.select("name", "width", "fx", *POSE))


@query(f"WITH {TRAJ} SELECT clip::varchar AS clip_id, frame::int AS frame_idx, 30.0::double AS fps, round(tx, 6) AS tx, valid AS held, CASE WHEN frame % 4 <> 0 THEN round(ox, 6) END AS width_m FROM traj")
def a4_read_truth(spark, sf):
    m = F.array(*[F.slice("m", 4 * i + 1, 4) for i in range(4)])
    row = F.struct("frame", m.alias("m"), "valid", F.when(F.col("frame") % 4 != 0, F.col("ox")).alias("w"))
    f = _matrix(traj(spark, sf)).groupBy("clip").agg(F.array_sort(F.collect_list(row)).alias("f"))
    demo = F.struct(F.lit(30.0).alias("fps"), F.col("f.m").alias("camera_poses"), F.col("f.m").alias("object_poses"), F.col("f.valid").alias("held"), F.col("f.w").alias("grasp_width_m"))
    value = F.to_json(F.struct(F.create_map(F.col("clip").cast("string"), demo).alias("demos")))
    got = capture.read_truth(spark, _json_files(f.select("clip", value.alias("value")), spark, "truth"))
    return rounded(got.select("clip_id", "frame_idx", "fps", F.col("camera.tx").alias("tx"), "held", "width_m"), ["tx", "width_m"])


@query(f"WITH {TRAJ} SELECT round(tx, 5) + 0.0 AS x, round(ty, 5) + 0.0 AS y, round(tz, 5) + 0.0 AS z, round(least(255, greatest(0, floor(abs(ox) * 255))) / 255, 5) AS r FROM traj")
def a5_ply_round_trip(spark, sf):
    path = folder(spark, "ply")
    color = [F.abs(F.col(c)).alias(n) for c, n in zip(("ox", "oy", "oz"), "rgb", strict=True)]
    capture.write_ply(traj(spark, sf).select(F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"), *color), path, 9)
    return rounded(capture.read_ply(spark, path).select("x", "y", "z", "r"), ["x", "y", "z", "r"], 5)


@query("SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1")
def a9_export_episodes(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).cast("string").alias("run_id"), F.col("l_suppkey").cast("string").alias("clip_id"), "l_quantity")
    keys = rows.select("run_id", "clip_id").distinct()
    status = keys.withColumn("rejected", F.col("clip_id").cast("int") % 7 == 0).withColumn("metric_scale", F.lit(0.06))
    path = folder(spark, "export")
    capture.export_episodes(rows, status, path)
    return spark.read.parquet(path).groupBy(F.col("clip_id").cast("bigint").alias("l_suppkey")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("SELECT o_custkey, count(*) AS episodes, max(o_orderstatus = 'F') AS rejected FROM orders GROUP BY 1")
def a10_write_status(spark, sf):
    path = folder(spark, "status")
    capture.write_status(table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("episodes"), F.max(F.col("o_orderstatus") == "F").alias("rejected")), path)
    return spark.read.schema("o_custkey bigint, episodes bigint, rejected boolean").json(path)


@query(f"WITH {TRAJ} SELECT 'clip-' || clip AS name, count(*) AS n FROM traj GROUP BY 1")
def a8_scan_frames(spark, sf):
    path = _json_files(traj(spark, sf).select("clip", F.col("vec_id").cast("string").alias("value")), spark, "frames")
    files = capture.scan_frames(spark, path, "*.txt")
    counts = spark.read.text(path).groupBy("clip").agg(F.count("*").alias("n"))
    found = files.select(F.regexp_extract("path", r"clip=(\d+)", 1).cast("int").alias("clip")).where("clip is not null").distinct()
    return counts.join(found, "clip", "left_semi").select(F.concat(F.lit("clip-"), F.col("clip").cast("string")).alias("name"), "n")
