"""Row-wise jobs over posed tables."""

from __future__ import annotations

from math import cos, radians, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajlake.functions.pose import POSE, add, cols, conj, cross, dot, from_axes, lits, named, norm, qmul, rotate, scale, sub, unit, upright


def derive_intrinsics(clips: DataFrame, ratio: float = 0.9) -> DataFrame:
    """``clips`` (width, height, focal_35mm) with fx, fy, cx, cy, fov_deg, source, self_calibrate, camera_model."""
    known = F.coalesce(F.col("focal_35mm") > 1, F.lit(False))
    fx = F.when(known, F.col("focal_35mm") / 36.0 * F.col("width")).otherwise(F.col("width") * ratio)
    return (
        clips.withColumn("fx", fx).withColumn("fy", F.col("fx")).withColumn("cx", F.col("width") / 2.0).withColumn("cy", F.col("height") / 2.0)
        .withColumn("fov_deg", F.degrees(2 * F.atan(F.col("width") / 2.0 / F.col("fx"))))
        .withColumn("source", F.when(known, F.lit("focal_35mm")).otherwise(F.lit("fallback_guess"))).withColumn("self_calibrate", ~known)
        .withColumn("camera_model", F.when(known, F.lit("PINHOLE")).otherwise(F.lit("SIMPLE_RADIAL")))
    )


def working_size(width: Column, height: Column, long_side: int, least: int = 32) -> tuple[Column, Column]:
    """Size whose long side is at most ``long_side``, no side under ``least``."""
    s = F.least(F.lit(1.0), F.lit(float(long_side)) / F.greatest(width, height))
    return tuple(F.greatest(F.lit(least), F.bround(x * s).cast("int")) for x in (width, height))


def scale_intrinsics(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Intrinsics of the same camera at another image size."""
    sx, sy = width / F.col("width"), height / F.col("height")
    return df.withColumns({"fx": F.col("fx") * sx, "fy": F.col("fy") * sy, "cx": F.col("cx") * sx, "cy": F.col("cy") * sy, "width": width, "height": height})


def _rate(text: Column) -> Column:
    parts = F.split(text, "/")
    num, den = (p.try_cast("double") for p in (F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    den = F.coalesce(den, F.when(F.size(parts) == 1, F.lit(1.0)))
    return F.when((num > 0) & (den > 0), num / den)


def normalise_probe(df: DataFrame, json: str, focal_tags: list[str]) -> DataFrame:
    """Probe rows (``json`` text) with fps, width, height, rotation_deg, duration_s, frame_count, focal_35mm."""

    def field(path: str) -> Column:
        return F.get_json_object(F.col(json), f"$.{path}")

    fps = F.coalesce(_rate(field("avg_frame_rate")), _rate(field("r_frame_rate")))
    rotation = F.pmod(F.coalesce(F.bround(field("rotation").try_cast("double")).cast("int"), F.lit(0)), F.lit(360))
    turned = rotation.isin(90, 270)
    w, h = (field(x).try_cast("int") for x in ("width", "height"))
    duration = field("duration").try_cast("double")
    focal = F.coalesce(*[field(t).try_cast("double") for t in focal_tags], F.lit(None).cast("double"))
    return df.withColumns({
        "fps": fps, "width": F.when(turned, h).otherwise(w), "height": F.when(turned, w).otherwise(h), "rotation_deg": rotation, "duration_s": duration,
        "frame_count": F.coalesce(field("nb_frames").try_cast("int"), F.bround(fps * duration).cast("int")), "focal_35mm": focal,
    })


def frame_clock(frames: DataFrame, fps: Column | float, kept: str, by: list[str], order: str) -> DataFrame:
    """Kept frames with t_s (their extracted position over fps), frame_idx from 0, name, and effective_fps."""
    whole = Window.partitionBy(*by)
    ranked = frames.withColumn("_pos", F.row_number().over(whole.orderBy(order)) - 1).withColumn("_n", F.count("*").over(whole)).withColumn("_kept", F.count_if(F.col(kept)).over(whole))
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    ranked = ranked.withColumn("t_s", F.col("_pos") / rate).withColumn("effective_fps", rate * F.col("_kept") / F.col("_n"))
    out = ranked.where(F.col(kept)).withColumn("frame_idx", F.row_number().over(whole.orderBy("_pos")) - 1)
    return out.withColumn("name", F.format_string("%05d", "frame_idx")).drop("_pos", "_n", "_kept")


def to_world(points: DataFrame, poses: DataFrame, keys: list[str], xyz=("x", "y", "z")) -> DataFrame:
    """``points`` with wx, wy, wz: through the pose of their frame."""
    joined = points.join(poses.select(*keys, *POSE), keys)
    world = add(rotate(cols(*POSE[3:]), cols(*xyz)), cols(*POSE[:3]))
    return joined.select(*points.columns, *named(world, ("wx", "wy", "wz")))


def project_points(df: DataFrame, fx: Column, fy: Column, cx: Column, cy: Column, xyz=("x", "y", "z")) -> DataFrame:
    """Camera-frame points with u, v, depth; a depth within 1e-9 of zero counts as 1e-9."""
    x, y, z = cols(*xyz)
    safe = F.when(F.abs(z) < 1e-9, F.lit(1e-9)).otherwise(z)
    return df.withColumns({"u": fx * x / safe + cx, "v": fy * y / safe + cy, "depth": z})


def backproject(df: DataFrame, fx: Column, fy: Column, cx: Column, cy: Column, u: str = "u", v: str = "v", depth: str = "depth") -> DataFrame:
    """Pixels of over 1e-4 depth with their camera-frame point x, y, z."""
    d = F.col(depth)
    return df.where(d > 1e-4).withColumns({"x": (F.col(u) - cx) / fx * d, "y": (F.col(v) - cy) / fy * d, "z": d})


def hand_features(df: DataFrame, thumb, index, index_mcp, pinky_mcp, wrist) -> DataFrame:
    """Landmark columns of a frame with grasp_width, centre c*, closing axis k*, approach a*, palm normal n*.

    Each joint is a triple of column names. Axes shorter than 1e-9 fall back: closing to x,
    approach and normal to z.
    """
    t, i, m, p, w = (cols(*j) for j in (thumb, index, index_mcp, pinky_mcp, wrist))
    centre = scale(add(t, i), 0.5)
    palm = scale(add(add(m, p), w), 1.0 / 3.0)
    closing = unit(sub(t, i), lits(1, 0, 0))
    approach = unit(sub(centre, palm), lits(0, 0, 1))
    normal = unit(cross(sub(m, w), sub(p, w)), lits(0, 0, 1))
    return df.withColumns({"grasp_width": norm(sub(t, i))} | {f"{s}{a}": c for s, v in (("c", centre), ("k", closing), ("a", approach), ("n", normal)) for a, c in zip("xyz", v, strict=True)})


def ee_pose(df: DataFrame, offset: float = 0.02, valid: str = "valid") -> DataFrame:
    """Hand features with the gripper's pose: z along the approach, x along the closing axis made orthogonal; NULL where invalid."""
    c, k, a = (cols(*[f"{s}{x}" for x in "xyz"]) for s in "cka")
    origin = sub(c, scale(a, offset))
    flat = sub(k, scale(a, dot(k, a)))
    # A fallback axis where closing and approach are parallel: the world axis that approach is least along.
    helper = (F.when(F.abs(a[0]) < 0.9, F.lit(1.0)).otherwise(F.lit(0.0)), F.when(F.abs(a[0]) < 0.9, F.lit(0.0)).otherwise(F.lit(1.0)), F.lit(0.0))
    other = unit(sub(helper, scale(a, dot(helper, a))))
    df = df.withColumns({f"_x{n}": v for n, v in zip("xyz", unit(flat, other, 1e-6), strict=True)})
    x = cols("_xx", "_xy", "_xz")
    y = cross(a, x)
    pose = [*origin, *upright(from_axes(x, y, a))]
    return df.withColumns({n: F.when(F.col(valid), v) for n, v in zip(POSE, pose, strict=True)}).drop("_xx", "_xy", "_xz")


def rpy_quaternion(roll: float, pitch: float, yaw: float) -> tuple[float, float, float, float]:
    """Quaternion of extrinsic x, y, z rotations in degrees."""
    (cr, sr), (cp, sp), (cy, sy) = ((cos(radians(a) / 2), sin(radians(a) / 2)) for a in (roll, pitch, yaw))
    return (cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy)


def wrist_pose(df: DataFrame, xyz: tuple[float, float, float], rpy_deg: tuple[float, float, float]) -> DataFrame:
    """``df`` with the wrist camera's pose w_* (gripper pose, then a fixed offset) and its inverse v_*, the view."""
    t, q = cols(*POSE[:3]), cols(*POSE[3:])
    pose = [*add(t, rotate(q, lits(*xyz))), *upright(qmul(q, lits(*rpy_quaternion(*rpy_deg))))]
    df = df.withColumns({f"w_{n}": v for n, v in zip(POSE, pose, strict=True)})
    wt, wq = (cols(*[f"w_{n}" for n in part]) for part in (POSE[:3], POSE[3:]))
    back = [*scale(rotate(conj(wq), wt), -1.0), *conj(wq)]
    return df.withColumns({f"v_{n}": v for n, v in zip(POSE, back, strict=True)})


def apply_sim3(df: DataFrame, s: Column, q, t, poses: bool = True, xyz=POSE[:3]) -> DataFrame:
    """Points, and with ``poses`` their rotations, through a similarity: the scale stays out of the rotation."""
    moved = dict(zip(xyz, add(scale(rotate(q, cols(*xyz)), s), t), strict=True))
    if poses:
        moved |= dict(zip(POSE[3:], upright(qmul(q, cols(*POSE[3:]))), strict=True))
    return df.withColumns(moved)


def clamp_and_hold(df: DataFrame, least: Column | float, most: Column | float, by: list[str], width: str = "width", closed: str = "closed") -> DataFrame:
    """Widths within the gripper's limits; while closed, the sequence's median width of closed frames."""
    from trajlake.operators.select import with_percentiles

    df = with_percentiles(df, by, {"_h": (F.when(F.col(closed), F.col(width)), 0.5)})
    chosen = F.when(F.col(closed), F.col("_h")).otherwise(F.col(width))
    clamped = F.when(chosen.isNotNull(), F.least(F.lit(most), F.greatest(F.lit(least), chosen)))
    return df.withColumn(width, clamped).drop("_h")


def rescale_translation(df: DataFrame, fx: Column, detector_fx: Column, xyz=POSE[:3]) -> DataFrame:
    """A detector's camera translation at our focal length; left alone if the detector's is below 1e-6."""
    f = F.when(detector_fx > 1e-6, fx / detector_fx).otherwise(F.lit(1.0))
    return df.withColumns({c: F.col(c) * f for c in xyz})


def phash_bits(df: DataFrame, coef: str, out: str = "phash") -> DataFrame:
    """64 bits, the first one highest: a coefficient above the median of all but the first."""
    c = F.col(coef)
    rest = F.array_sort(F.slice(c, 2, 63))
    df = df.withColumn("_median", F.element_at(rest, 32))
    bits = F.transform(F.slice(F.col(coef), 1, 64), lambda x: F.when(x > F.col("_median"), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return df.withColumn(out, F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))).drop("_median")


def normalise_descriptor(df: DataFrame, vec: str, out: str = "vec") -> DataFrame:
    """Vectors less their mean, over their length unless that is at most 1e-6."""
    df = df.withColumn("_v", F.transform(vec, lambda x: x.cast("double")))
    df = df.withColumn("_m", F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / F.size("_v"))
    df = df.withColumn("_v", F.transform("_v", lambda x: x - F.col("_m")))
    df = df.withColumn("_n", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x)))
    return df.withColumn(out, F.transform("_v", lambda x: F.when(F.col("_n") > 1e-6, x / F.col("_n")).otherwise(x))).drop("_v", "_m", "_n")


def invert_model_pose(df: DataFrame) -> DataFrame:
    """World-to-camera rows turned into camera-to-world poses."""
    q = cols(*POSE[3:])
    back = scale(rotate(conj(q), cols(*POSE[:3])), -1.0)
    return df.withColumns(dict(zip(POSE, [*back, *upright(conj(q))], strict=True)))
