"""Filters, predicates and quality gates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajlake.operators.scan import STRETCH_ROWS
from trajlake.operators.select import with_percentiles

_ALL = (1 << 64) - 1

def blur_gate(frames: DataFrame, rel: float, least: float, cap: float, by: list[str], order: str, sharpness: str = "sharpness", stretch: int = STRETCH_ROWS) -> DataFrame:
    """``frames`` with threshold and keep.

    The threshold is max(rel * median, least). If more than ``cap`` of a group would go
    (unreadable frames count), it is ignored and the sharpest max(1, round(n * (1 - cap)))
    stay; unreadable frames sort last, ties go to the earlier frame.
    """
    w = Window.partitionBy(*by)
    s = F.col(sharpness)
    df = with_percentiles(frames, by, {"_median": (s, 0.5)}, stretch)
    df = df.withColumn("threshold", F.greatest(F.coalesce(F.col("_median") * rel, F.lit(least)), F.lit(least))).drop("_median")
    df = df.withColumn("_ok", F.coalesce(s >= F.col("threshold"), F.lit(False))).withColumn("_n", F.count("*").over(w)).withColumn("_kept", F.count_if(F.col("_ok")).over(w))
    df = df.withColumn("_rank", F.row_number().over(w.orderBy(s.desc_nulls_last(), order)))
    capped = (F.col("_n") - F.col("_kept")) / F.col("_n") > cap
    most = F.greatest(F.lit(1), F.bround(F.col("_n") * (1 - cap)).cast("int"))
    return df.withColumn("keep", F.when(capped, F.col("_rank") <= most).otherwise(F.col("_ok"))).withColumn("capped", capped).drop("_ok", "_n", "_kept", "_rank")


def drop_near_duplicates(frames: DataFrame, least_distance: int, by: list[str], order: str, phash: str = "phash") -> DataFrame:
    """Frames at least ``least_distance`` bits from the last kept one, in order; 0 keeps all.

    A frame without a hash stays, as does the one after it. Of each clip, one hash is held at a time.
    """
    if least_distance <= 0:
        return frames

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip, last = None, None
        for batch in batches:
            keep = []
            for *own, h in zip(*(batch.column(c).to_pylist() for c in (*by, phash)), strict=True):
                new = own != clip or last is None or h is None or ((last ^ h) & _ALL).bit_count() >= least_distance
                clip, last = own, h if new else last
                keep.append(new)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return frames.repartition(*by).sortWithinPartitions(*by, order, phash).mapInArrow(run, frames.schema)


def fov_gate(clips: DataFrame, most: float = 100.0, fov: str = "fov_deg") -> DataFrame:
    """A gate row per clip: passed unless the field of view is over ``most``."""
    return clips.withColumns({"passed": F.col(fov) <= most, "threshold": F.lit(float(most)), "unit": F.lit("deg")})


def hand_depth_filter(landmarks: DataFrame, by: list[str], z: str, least: float = 0.02, most: float = 5.0) -> DataFrame:
    """Groups whose smallest and largest depth are plausible."""
    return landmarks.groupBy(*by).agg(F.min(z).alias("z_min"), F.max(z).alias("z_max")).where((F.col("z_min") >= least) & (F.col("z_max") <= most))


def mask_area_gate(stats: DataFrame, least_pixels: int, fraction: float, area: str = "area", width: str = "width", height: str = "height") -> DataFrame:
    return stats.where((F.col(area) >= least_pixels) & (F.col(area) <= fraction * F.col(width) * F.col(height)))


def cloud_gate(points: DataFrame, by: list[str], least: int = 50, most_spread: float = 0.35, xyz=("x", "y", "z")) -> DataFrame:
    """Groups of enough points whose per-axis population deviations are short as a vector."""
    spread = F.sqrt(sum((F.pow(F.stddev_pop(c), 2) for c in xyz[1:]), F.pow(F.stddev_pop(xyz[0]), 2)))
    return points.groupBy(*by).agg(F.count("*").alias("n"), spread.alias("spread")).where((F.col("n") >= least) & (F.col("spread") <= most_spread))


def localization_decision(stats: DataFrame, least_rate: float = 0.7, most_loss: float = 0.02, most_speed: float = 2.0, path_factor: float = 8.0, least_inliers: float = 0.35, override: bool = False) -> DataFrame:
    """``stats`` with pose_source, rejected, reasons, reject_reason.

    Reads register_rate, tracking_loss, median_speed, path_length, span, inlier_ratio,
    scale_method, device_available. Diagnostics are compared as rounded to 4 places.
    Reasons come in the order speed, path, inliers; implausible motion goes before a failed
    registration, that before tracking loss. With ``override`` implausible poses are
    kept under another label.
    """
    device = (F.col("scale_method") == "arkit_sim3") & F.col("device_available")
    low = F.col("register_rate") < least_rate
    source = F.when(~low, F.lit("sfm")).when(device, F.lit("device")).otherwise(F.lit("failed"))
    df = stats.withColumn("pose_source", F.coalesce(source, F.lit("failed")))
    speed, path = F.round("median_speed", 4), F.round("path_length", 4)
    reasons = F.array(
        F.when(speed > most_speed, F.concat(F.lit("median speed above "), F.lit(str(most_speed)), F.lit(" m/s"))),
        F.when(path > path_factor * F.col("span"), F.concat(F.lit("path above "), F.lit(str(path_factor)), F.lit(" x scene span"))),
        F.when((F.col("pose_source") == "sfm") & (F.col("inlier_ratio") < least_inliers), F.concat(F.lit("inlier ratio below "), F.lit(str(least_inliers)))),
    )
    df = df.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))
    implausible = F.size("reasons") > 0
    failed, loss = F.col("pose_source") == "failed", F.coalesce(F.col("tracking_loss") > most_loss, F.lit(False))
    kept = implausible & F.lit(override)
    reason = (
        F.when(implausible & ~F.lit(override), F.concat(F.lit("implausible: "), F.array_join("reasons", "; ")))
        .when(failed, F.lit("localization failed")).when(loss, F.lit("tracking loss"))
    )
    df = df.withColumn("reject_reason", reason).withColumn("rejected", F.col("reject_reason").isNotNull())
    return df.withColumn("pose_source", F.when(kept & ~failed, F.concat("pose_source", F.lit("_implausible"))).otherwise(F.col("pose_source")))


def preflight_verdict(df: DataFrame, demo: str, reference: str) -> DataFrame:
    """``df`` with ratio (0 without a reference), verdict and gate_value (ratio to 4 places, compared unrounded)."""
    ratio = F.when(F.col(reference) > 0, F.col(demo) / F.col(reference)).otherwise(F.lit(0.0))
    df = df.withColumn("ratio", ratio)
    verdict = F.when(F.col("ratio") >= 0.40, F.lit("PASS")).when(F.col("ratio") >= 0.25, F.lit("MARGINAL")).otherwise(F.lit("FAIL"))
    return df.withColumn("verdict", verdict).withColumn("gate_value", F.round("ratio", 4))


def marker_gates(agreement: DataFrame, by: list[str], most_cm: float = 3.0, most_deg: float = 5.0, least_coverage: float = 0.5) -> DataFrame:
    """Three gate rows per row (n, position_cm, rotation_deg, coverage), or a failed one with the reason if n is 0."""

    def gate(name: str, value: Column, ok: Column, threshold: float, unit: str, detail: str = "") -> Column:
        return F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("passed"), value.cast("double").alias("value"), F.lit(threshold).alias("threshold"), F.lit(unit).alias("unit"), F.lit(detail).alias("detail"))

    three = F.array(
        gate("marker_position", F.col("position_cm"), F.col("position_cm") <= most_cm, most_cm, "cm"),
        gate("marker_rotation", F.col("rotation_deg"), F.col("rotation_deg") <= most_deg, most_deg, "deg"),
        gate("marker_coverage", F.col("coverage"), F.col("coverage") >= least_coverage, least_coverage, "fraction"),
    )
    one = F.array(gate("marker_position", F.lit(None), F.lit(False), most_cm, "cm", "marker not observed"))
    return agreement.select(*by, F.inline(F.when(F.col("n") > 0, three).otherwise(one)))


def scene_gate(stats: DataFrame, least_rate: float = 0.8, registered: str = "registered", total: str = "total") -> DataFrame:
    """``stats`` with registration_rate and passed."""
    rate = F.when(F.col(total) > 0, F.col(registered) / F.col(total)).otherwise(F.lit(0.0))
    return stats.withColumn("registration_rate", rate).withColumn("passed", F.col("registration_rate") >= least_rate)


def episode_verdict(status: DataFrame, least_coverage: float = 0.5) -> DataFrame:
    """``status`` (valid_hands, closed_frames, mean_coverage) with rejected and warning."""
    warning = F.when(F.col("closed_frames") == 0, F.lit("gripper never closes")).when(F.col("mean_coverage") < least_coverage, F.lit("low view coverage"))
    return status.withColumn("rejected", F.col("valid_hands") == 0).withColumn("warning", F.when(~F.col("rejected"), warning))


def accept_depth_fit(fits: DataFrame, least_n: int, least_corr: float = 0.5) -> DataFrame:
    return fits.where((F.col("n") >= least_n) & (F.abs(F.col("corr")) >= least_corr))
