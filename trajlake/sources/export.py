"""Writers of binary episode bundles, of sparse models, and of the episode table that trainers read."""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajlake.functions.pose import POSE

#: Frames of one clip that a bundle holds at most.
BUNDLE_FRAMES = 4096


def _store(path: str, name: str, data: bytes) -> None:
    """Writes a file under another name first, so that a task that is lost or runs twice leaves no half of it."""
    from pyarrow.fs import FileSystem

    fs, base = FileSystem.from_uri(path)
    target = f"{base}/{name}"
    fs.create_dir(target.rpartition("/")[0], recursive=True)
    part = f"{target}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, target)


def _file_each(df: DataFrame, by: list[str], path: str, name: Callable[[tuple], str], body: Callable[[pd.DataFrame], bytes]) -> None:
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        _store(path, name(key), body(f))
        return pd.DataFrame({"file": [name(key)]})

    df.groupBy(*by).applyInPandas(run, "file string").write.format("noop").mode("overwrite").save()


def write_episode_arrays(df: DataFrame, path: str, clip: str = "clip", frame: str = "frame", most: int = BUNDLE_FRAMES) -> None:
    """``clip``-``part``.npz of t_s, tx, ty, tz, width_m, closed: part holds the frames from ``most`` * part on, so a bundle is bounded."""

    def body(f: pd.DataFrame) -> bytes:
        f = f.sort_values(frame)
        out = io.BytesIO()
        np.savez(out, positions=f[["tx", "ty", "tz"]].to_numpy(float), widths=f["width_m"].to_numpy(float), closed=f["closed"].to_numpy(bool), timestamps=f["t_s"].to_numpy(float))
        return out.getvalue()

    rows = df.select(clip, F.floor(F.col(frame) / most).alias("_part"), frame, "t_s", "tx", "ty", "tz", F.col("width_m").cast("double").alias("width_m"), "closed")
    _file_each(rows, [clip, "_part"], path, lambda key: f"{key[0]}-{key[1]}.npz", body)


def write_sparse_models(cameras: DataFrame, images: DataFrame, points: DataFrame, path: str, model: str = "model") -> None:
    """A folder of cameras.bin, images.bin and points3D.bin for each ``model``; the format counts its rows, so one file is one task.

    cameras: camera_id, kind, width, height, params. images: image_id, qw to tz, camera_id, name, seen (array of u, v,
    point_id; -1 for none). points: point_id, x, y, z, r, g, b (0 to 1), error, track (array of image_id, kp).
    """

    def cameras_(f: pd.DataFrame) -> bytes:
        each = (struct.pack("<iiQQ", c.camera_id, c.kind, c.width, c.height) + np.asarray(c.params, "<f8").tobytes() for c in f.itertuples())
        return struct.pack("<Q", len(f)) + b"".join(each)

    def images_(f: pd.DataFrame) -> bytes:
        out = [struct.pack("<Q", len(f))]
        for c in f.itertuples():
            pose = [getattr(c, x) for x in (*POSE[3:], *POSE[:3])]
            seen = b"".join(struct.pack("<ddq", x["u"], x["v"], x["point_id"]) for x in c.seen)
            out.append(struct.pack("<i7di", c.image_id, *pose, c.camera_id) + c.name.encode() + b"\0" + struct.pack("<Q", len(c.seen)) + seen)
        return b"".join(out)

    def points_(f: pd.DataFrame) -> bytes:
        out = [struct.pack("<Q", len(f))]
        for c in f.itertuples():
            color = [min(255, max(0, round(255 * x))) for x in (c.r, c.g, c.b)]
            track = b"".join(struct.pack("<ii", x["image_id"], x["kp"]) for x in c.track)
            out.append(struct.pack("<Q3d3BdQ", c.point_id, c.x, c.y, c.z, *color, c.error, len(c.track)) + track)
        return b"".join(out)

    for df, name, body in ((cameras, "cameras", cameras_), (images, "images", images_), (points, "points3D", points_)):
        _file_each(df, [model], path, lambda key, name=name: f"{model}={key[0]}/{name}.bin", body)


def _ranked(rows: DataFrame, by: list[str], path: str, index: str, length: str | None = None) -> DataFrame:
    """``rows`` (distinct ``by``) with ``index``, their place in order of ``by``, and ``start``, the sum of ``length`` before them.

    Rows are sorted by range and written; then only one row a range is summed up in one place.
    """
    spark = rows.sparkSession
    ranges = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranges.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_length", F.col(length) if length else F.lit(1))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_range").agg(F.count("*").alias("_n"), F.sum("_length").alias("_sum"))
    sums = sums.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_sum")])
    within = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(F.broadcast(sums), "_range").withColumns({index: F.col("_n") + F.col("_at"), "start": F.col("_sum") + F.sum("_length").over(within) - F.col("_length")})
    return out.drop("_range", "_at", "_n", "_sum", "_length")


def write_training_table(df: DataFrame, path: str, by: list[str], order: str, time: str, fps: float, state: list[str], action: list[str], task: str, success: str, tolerance: float = 1e-4, chunk: int = 1000) -> None:
    """Frames in the schema that trainers read: ``path``/data, ``path``/meta/episodes and ``path``/meta/tasks.

    data, in folders of ``chunk`` episodes: index, episode_index, frame_index, timestamp, task_index,
    observation.state, action (absolute pose plus width, float32), next.done, next.success. Episodes are
    numbered by ``by``; rows with a null in it belong to none and are left out. A table in which some ``time`` is
    null or off frame_index / ``fps`` by more than ``tolerance`` seconds raises ValueError, as it wouldn't load; its frames aren't written.
    """
    at = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    frames = df.dropna(subset=by).withColumn("frame_index", (at - 1).cast("bigint"))
    off = F.coalesce(F.abs(F.col(time) - F.col("frame_index") / fps), F.lit(float("inf")))
    episodes = frames.groupBy(*by).agg(F.count("*").alias("length"), F.max(off).alias("off"), F.max(task).alias("task"), F.max(success).alias("success"))
    episodes = _ranked(episodes, by, f"{path}/ranked/episodes", "episode_index", "length")
    bad = episodes.where(F.col("off") > tolerance).select(*by, "off").head(1)
    if bad:
        raise ValueError(f"timestamps differ from their frames' by more than {tolerance} s: {bad[0]}")
    tasks = _ranked(episodes.where("task is not null").select("task").distinct(), ["task"], f"{path}/ranked/tasks", "task_index")
    tasks.select("task_index", "task").write.parquet(f"{path}/meta/tasks")
    named = episodes.join(tasks.select("task", "task_index"), "task", "left")
    named.select("episode_index", *by, "length", "start", "task", "task_index", "success").write.parquet(f"{path}/meta/episodes")

    written = df.sparkSession.read.parquet(f"{path}/meta/episodes").select(*by, "episode_index", "length", "start", "task_index", F.col("success").alias("_success"))
    floats = {name: F.array(*[F.col(c).cast("float") for c in columns]).alias(name) for name, columns in (("observation.state", state), ("action", action))}
    rows = frames.select(*by, "frame_index", F.col(time).cast("double").alias("timestamp"), *floats.values()).join(written, by)
    last = F.col("frame_index") == F.col("length") - 1
    rows = rows.select(
        F.floor(F.col("episode_index") / chunk).alias("chunk"), (F.col("start") + F.col("frame_index")).alias("index"), "episode_index", "frame_index", "timestamp", "task_index",
        "`observation.state`", "action", last.alias("next.done"), (last & F.col("_success")).alias("next.success"),
    )
    # By range, so that a long episode is spread and a task writes to few folders.
    rows.repartitionByRange("index").sortWithinPartitions("chunk", "index").write.partitionBy("chunk").parquet(f"{path}/data")
