"""Readers and writers of the capture pipeline's files. NaN becomes NULL on the way in."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions.pose import POSE, from_axes, upright
from trajlake.sources import ranges
from trajlake.sources.ranges import RANGE_BYTES

CLIP = "struct<kind:string,video:struct<width:int,height:int,fps:double,duration_s:double,rotation_deg:int,codec:string,focal_35mm:double>,requested_fps:double,effective_fps:double,extracted_count:int,frame_names:array<string>,frame_times_s:array<double>>"
MANIFEST = f"run_id string, clips map<string,{CLIP}>"


def _nan(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Clips and frames of manifests: a map of clips, and their parallel arrays zipped by position."""
    raw = spark.read.schema(MANIFEST).json(path, multiLine=True).select("run_id", F.explode("clips").alias("clip_id", "c"))
    clips = raw.select("run_id", "clip_id", "c.kind", "c.video.*", "c.requested_fps", "c.effective_fps", "c.extracted_count", F.size("c.frame_names").alias("frame_count"))
    frames = raw.select("run_id", "clip_id", F.posexplode(F.arrays_zip("c.frame_names", "c.frame_times_s")).alias("frame_idx", "f"))
    return clips, frames.select("run_id", "clip_id", "frame_idx", F.col("f.frame_names").alias("name"), F.col("f.frame_times_s").alias("t_s"))


def _pose_of(m: Column) -> list[Column]:
    """Pose columns of a row-major 4x4 matrix."""
    at = [[F.get(m, F.lit(4 * i + j)) for j in range(4)] for i in range(3)]
    axes = [tuple(at[i][j] for i in range(3)) for j in range(3)]
    values = [at[i][3] for i in range(3)] + list(upright(from_axes(*axes)))
    return [v.alias(n) for v, n in zip(values, POSE, strict=True)]


def read_device_poses(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """source_file, idx, t_s, pose from {"frames": [..]} or a bare list, with transform or matrix.

    Entries without 16 numbers are dropped; a missing timestamp counts the entries kept
    before; a file of under ``least`` usable entries is ignored.
    """
    entry = "array<struct<timestamp:double,transform:array<double>,matrix:array<double>>>"
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_file"), "value")
    bare = F.trim("value").startswith("[")
    entries = F.when(bare, F.from_json("value", entry)).otherwise(F.from_json("value", f"frames {entry}")["frames"])
    rows = text.select("source_file", entries.alias("e")).select("source_file", F.filter(F.transform("e", lambda x: F.struct(x["timestamp"].alias("t"), F.coalesce(x["transform"], x["matrix"]).alias("m"))), lambda x: F.size(x["m"]) == 16).alias("e"))
    rows = rows.where(F.size("e") >= least).select("source_file", F.posexplode("e").alias("idx", "x"))
    return rows.select("source_file", "idx", F.coalesce("x.t", F.col("idx").cast("double")).alias("t_s"), *_pose_of(F.col("x.m")))


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """source_file, name, width, height, fx, fy, cx, cy, pose of posed-camera lists."""
    schema = "intrinsics struct<width:int,height:int,fx:double,fy:double,cx:double,cy:double>, cameras array<struct<name:string,transform:array<array<double>>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).select(F.input_file_name().alias("source_file"), "intrinsics.*", F.explode("cameras").alias("c"))
    return raw.select("source_file", F.col("c.name").alias("name"), "width", "height", "fx", "fy", "cx", "cy", *_pose_of(F.flatten("c.transform")))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """clip_id, frame_idx, fps, camera and object poses, held, width_m of ground-truth files."""
    demo = "struct<fps:double,camera_poses:array<array<array<double>>>,object_poses:array<array<array<double>>>,held:array<boolean>,grasp_width_m:array<double>>"
    raw = spark.read.schema(f"demos map<string,{demo}>").json(path, multiLine=True).select(F.explode("demos").alias("clip_id", "d"))
    rows = raw.select("clip_id", "d.fps", F.posexplode(F.arrays_zip("d.camera_poses", "d.object_poses", "d.held", "d.grasp_width_m")).alias("frame_idx", "f"))
    cam = F.struct(*_pose_of(F.flatten("f.camera_poses"))).alias("camera")
    obj = F.struct(*_pose_of(F.flatten("f.object_poses"))).alias("object")
    return rows.select("clip_id", "frame_idx", "fps", cam, obj, F.col("f.held").alias("held"), _nan(F.col("f.grasp_width_m")).alias("width_m"))


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, r, g, b (0 to 1) of the vertices of ASCII point clouds.

    Lines of six numbers or more are vertices; those of a header aren't, as they begin with words.
    """
    parts = F.split(F.trim("value"), r"\s+")
    number = r"^\s*[-+0-9.eE]+(\s+[-+0-9.eE]+){5,}\s*$"
    rows = spark.read.text(path).where(F.col("value").rlike(number)).select(parts.alias("p"))
    return rows.select(*[F.get("p", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate("xyz")], *[(F.get("p", F.lit(i + 3)).try_cast("double") / 255.0).alias(c) for i, c in enumerate("rgb")]).where("x is not null")


def write_ply(cloud: DataFrame, path: str, decimals: int = 6) -> None:
    """One ASCII cloud a part file, each with a header of its own count. Colours are cut to whole 255ths, not rounded."""
    rows = cloud.select(F.spark_partition_id().alias("part"), *[F.format_string(f"%.{decimals}f", F.col(c).cast("double")).alias(c) for c in "xyz"], *[F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col(c) * 255).cast("int"))).cast("string").alias(c) for c in "rgb"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The header needs the count, so a part is held as text: one partition of vertices.
        lines: list[str] = []
        for f in batches:
            lines += f[list("xyzrgb")].agg(" ".join, axis=1).tolist()
        if lines:
            head = ["ply", "format ascii 1.0", f"element vertex {len(lines)}", *[f"property float {c}" for c in "xyz"], *[f"property uchar {c}" for c in ("red", "green", "blue")], "end_header"]
            yield pd.DataFrame({"value": head + lines})

    rows.mapInPandas(run, "value string").write.mode("overwrite").text(path)


def read_episode_arrays(spark: SparkSession, path: str, glob: str = "*.npz", position: str = "positions", width: str = "widths", closed: str = "closed", times: str = "timestamps", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """source_file, k, t_s, tx, ty, tz, width_m, closed of array bundles; NaN becomes NULL.

    A bundle of stored arrays is read by several tasks, some rows each; one that is compressed is one task's.
    """
    names = [position, width, closed, times]

    def index(file: str) -> Iterator[tuple[int, int]]:
        with ranges.opened(file) as f:
            bundle = ranges.Bundle(f)
            n = bundle.at[position][0][0]
            step = max(1, range_bytes // max(1, bundle.row_bytes(names))) if bundle.stored(names) else max(n, 1)
        yield from ((k, min(k + step, n)) for k in range(0, n, step))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, first, last in f.itertuples(index=False):
                with ranges.opened(name) as file:
                    bundle = ranges.Bundle(file)
                    p, w, c, t = (bundle.read(x, first, last) for x in names)
                p = p[:, :3] if p.ndim == 2 else p[:, :3, 3]
                out = pd.DataFrame({"source_file": name, "k": np.arange(first, last), "t_s": t, "tx": p[:, 0], "ty": p[:, 1], "tz": p[:, 2], "width_m": w, "closed": c.astype(bool)})
                yield out.astype({"width_m": object}).where(out.notna(), None)

    parts = ranges.in_ranges(ranges.listed(spark, path, glob), index, range_bytes)
    return parts.mapInPandas(run, "source_file string, k bigint, t_s double, tx double, ty double, tz double, width_m double, closed boolean")


#: Parameters of each camera model of the binary sparse-model format.
_MODEL_PARAMS = {0: 3, 1: 4, 2: 4, 3: 5, 4: 8, 5: 8, 6: 12, 7: 5, 8: 4, 9: 5, 10: 12}
#: A 3-D point of that format, up to its track; an image's 2-D point.
_POINT3 = np.dtype([("point_id", "<u8"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("error", "<f8")])
_POINT2 = np.dtype([("u", "<f8"), ("v", "<f8"), ("point_id", "<i8")])
#: Rows of observations that go to Spark at once.
_OBSERVATIONS = 200_000


def read_sparse_model(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> dict[str, DataFrame]:
    """cameras, images, observations (2-D points; a null point_id is none) and points of binary sparse models; tracks repeat observations and are skipped.

    A task for each file walks over its records' lengths; the records are then read in ranges of ``range_bytes``, by a task each.
    """

    def cameras(name: str, first: int, last: int) -> Iterator[pd.DataFrame]:
        with ranges.opened(name) as f:
            data = f.read()
        (n,), at, out = struct.unpack_from("<Q", data), 8, []
        for _ in range(n):
            camera, model, width, height = struct.unpack_from("<iiQQ", data, at)
            m = _MODEL_PARAMS[model]
            out.append({"camera_id": camera, "model": model, "width": width, "height": height, "params": list(struct.unpack_from(f"<{m}d", data, at + 24))})
            at += 24 + 8 * m
        yield pd.DataFrame(out, dtype=object)

    def images(name: str, first: int, last: int) -> Iterator[pd.DataFrame]:
        data, starts = ranges.records(name, first, last, ranges.next_image)
        out = []
        for at in starts:
            image, *pose, camera = struct.unpack_from("<i7di", data, at)
            out.append({"image_id": image, **dict(zip(("qw", "qx", "qy", "qz", "tx", "ty", "tz"), pose, strict=True)), "camera_id": camera, "name": data[at + 64 : data.index(b"\0", at + 64)].decode()})
        yield pd.DataFrame(out, dtype=object)

    def observations(name: str, first: int, last: int) -> Iterator[pd.DataFrame]:
        data, starts = ranges.records(name, first, last, ranges.next_image)
        held: list[pd.DataFrame] = []
        for at in starts:
            end = data.index(b"\0", at + 64)
            (n,) = struct.unpack_from("<Q", data, end + 1)
            p = np.frombuffer(data, _POINT2, n, end + 9)
            held.append(pd.DataFrame({"image_id": struct.unpack_from("<i", data, at)[0], "kp": np.arange(n, dtype=np.int32), "u": p["u"], "v": p["v"], "point_id": pd.Series(p["point_id"].astype(np.int64)).astype("Int64").mask(p["point_id"] < 0)}))
            if sum(map(len, held)) >= _OBSERVATIONS:
                yield pd.concat(held)
                held.clear()
        if held:
            yield pd.concat(held)

    def points(name: str, first: int, last: int) -> Iterator[pd.DataFrame]:
        data, starts = ranges.records(name, first, last, ranges.next_point)
        raw = np.frombuffer(data, np.uint8)[starts[:, None] + np.arange(_POINT3.itemsize)]
        p = np.ascontiguousarray(raw).view(_POINT3)[:, 0]
        out = {"point_id": p["point_id"].astype(np.int64)} | {c: p[c].astype(float) for c in "xyz"} | {c: p[c] / 255.0 for c in "rgb"}
        yield pd.DataFrame(out | {"error": p["error"].astype(float)})

    def table(name: str, parse: Callable[[str, int, int], Iterator[pd.DataFrame]], after: Callable | None, schema: str) -> DataFrame:
        def index(file: str) -> Iterator[tuple[int, int]]:
            return ranges.record_ranges(file, after, range_bytes) if after else iter([(0, 0)])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for file, first, last in f.itertuples(index=False):
                    for rows in parse(file, first, last):
                        if len(rows):
                            yield rows.assign(source_file=file)

        parts = ranges.in_ranges(ranges.listed(spark, path, f"{name}.bin"), index, range_bytes)
        return parts.mapInPandas(run, f"{schema}, source_file string")

    pose = ", ".join(f"{c} double" for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz"))
    return {
        "cameras": table("cameras", cameras, None, "camera_id int, model int, width bigint, height bigint, params array<double>"),
        "images": table("images", images, ranges.next_image, f"image_id int, {pose}, camera_id int, name string"),
        "observations": table("images", observations, ranges.next_image, "image_id int, kp int, u double, v double, point_id bigint"),
        "points": table("points3D", points, ranges.next_point, "point_id bigint, x double, y double, z double, r double, g double, b double, error double"),
    }


def scan_frames(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    """path, name, size of the image files under ``path``; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def export_episodes(df: DataFrame, status: DataFrame, path: str, scale: str = "metric_scale") -> None:
    """Accepted episodes by run and clip, with ``scale_applied`` so that nobody applies it twice."""
    from trajlake.operators.joins import accepted_only

    keys = ["run_id", "clip_id"]
    rows = accepted_only(df, status, keys).join(status.select(*keys, scale), keys).withColumn("scale_applied", F.lit(True))
    rows.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_status(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)
