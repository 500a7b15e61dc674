"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajlake.functions.pose import add, angle_deg, cols, conj, norm, qmul, rotate, sub
from trajlake.operators.joins import rate_map
from trajlake.operators.scan import STRETCH_ROWS
from trajlake.operators.select import meet, percentiles, with_percentiles


def pct(col: Column | str, p: float, approx: bool = False) -> Column:
    """Linear percentile; ``approx`` for groups of millions of values."""
    return F.percentile_approx(col, p, 10_000).cast("double") if approx else F.percentile(col, F.lit(p))


def quality_summary(frames: DataFrame, by: list[str], sharpness: str = "sharpness") -> DataFrame:
    """Counts and sharpness of frames with keep (after blur), kept (after duplicates) and threshold."""
    s = F.col(sharpness)
    return frames.groupBy(*by).agg(
        F.count_if("kept").alias("n_kept"), F.count_if(~F.col("keep")).alias("dropped_blur"), F.count_if(F.col("keep") & ~F.col("kept")).alias("dropped_duplicate"),
        F.max("threshold").alias("threshold"), pct(s, 0.5).alias("median"), F.avg(s).alias("mean"), pct(s, 0.1).alias("p10"),
    )


def match_counts(matches: DataFrame, pair=("query", "ref"), ref_kp: str = "ref_kp") -> DataFrame:
    """n_matches per pair: entries other than -1; an absent pair has no row."""
    return matches.groupBy(*pair).agg(F.count_if(F.col(ref_kp) != -1).alias("n_matches"))


def viewpoint_overlap(demo: DataFrame, baseline: DataFrame, by: list[str]) -> DataFrame:
    """by, demo (median over queries of their best reference), reference (median over baseline pairs); columns query, n_matches."""
    best = demo.groupBy(*by, "query").agg(F.max("n_matches").alias("best")).groupBy(*by).agg(pct("best", 0.5).alias("demo"))
    ceiling = baseline.groupBy(*by).agg(pct("n_matches", 0.5).alias("reference"))
    return best.join(ceiling, by, "left").withColumn("reference", F.coalesce("reference", F.lit(0.0)))


def registration_summary(frames: DataFrame, by: list[str]) -> DataFrame:
    """register_rate, inlier_ratio, median_inliers, median_correspondences, tracking_loss from valid, inliers, correspondences."""
    valid = F.col("valid")
    ratio = F.when(valid, F.col("inliers") / F.greatest(F.col("correspondences"), F.lit(1)))
    return frames.groupBy(*by).agg(
        F.avg(valid.cast("int")).alias("register_rate"), pct(ratio, 0.5).alias("inlier_ratio"), pct(F.when(valid, F.col("inliers")), 0.5).cast("int").alias("median_inliers"),
        pct(F.when(valid, F.col("correspondences")), 0.5).cast("int").alias("median_correspondences"), (1 - F.avg(valid.cast("int"))).alias("tracking_loss"),
    )


def dominant_marker(detections: DataFrame, by: list[str], marker: str, least: int, configured: int | None = None) -> DataFrame:
    """by, marker_id, n_detections, ignored: the most detected id (ties: the lowest), or the configured one if it was seen.

    Under ``least`` detections there is none. Ids are never averaged.
    """
    counts = detections.groupBy(*by, marker).agg(F.count("*").alias("_n"))
    want = F.struct("_n", (-F.col(marker)).alias("m")) if configured is None else F.when(F.col(marker) == configured, F.struct("_n", (-F.col(marker)).alias("m")))
    out = counts.groupBy(*by).agg(F.max(want).alias("_b"), F.array_sort(F.collect_list(marker)).alias("_all"))
    out = out.withColumn("n_detections", F.when(F.col("_b._n") >= least, F.col("_b._n"))).withColumn("marker_id", F.when(F.col("n_detections").isNotNull(), -F.col("_b.m")))
    ignored = F.when(F.col("marker_id").isNull(), F.col("_all")).otherwise(F.array_except("_all", F.array("marker_id")))
    return out.select(*by, "marker_id", "n_detections", ignored.alias("ignored"))


def marker_scale(corners: DataFrame, by: list[str], known: float, xyz=("x", "y", "z")) -> DataFrame:
    """by, side (mean of the four), scale = known / side, from triangulated corners 0..3."""
    pivot = corners.groupBy(*by).agg(F.count("*").alias("_n"), *[F.max(F.when(F.col("corner") == k, F.col(c))).alias(f"_{c}{k}") for k in range(4) for c in xyz])
    sides = [norm(sub(cols(*[f"_{c}{(k + 1) % 4}" for c in xyz]), cols(*[f"_{c}{k}" for c in xyz]))) for k in range(4)]
    side = (sides[0] + sides[1] + sides[2] + sides[3]) / 4
    return pivot.where("_n = 4").select(*by, side.alias("side")).where("side > 0").withColumn("scale", F.lit(float(known)) / F.col("side"))


def known_object_scale(views: DataFrame, by: list[str], known_width: float, least: int = 3) -> DataFrame:
    """by, width (median of (x1 - x0) * dist / fx), spread (p84 - p16), height_p90, n_views, scale; of ``least`` views at least."""
    w, h = (F.col("x1") - F.col("x0")) * F.col("dist") / F.col("fx"), (F.col("y1") - F.col("y0")) * F.col("dist") / F.col("fx")
    out = views.groupBy(*by).agg(F.count("*").alias("n_views"), pct(w, 0.5).alias("width"), (pct(w, 0.84) - pct(w, 0.16)).alias("spread"), pct(h, 0.9).alias("height_p90"))
    return out.where(F.col("n_views") >= least).withColumn("scale", F.lit(float(known_width)) / F.col("width"))


def resolve_scale(df: DataFrame, sources: dict[str, str], allow_unscaled: bool = False) -> DataFrame:
    """``df`` with scale_method, scale, refused: the first source (label: column) with a finite positive value."""
    def usable(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), x)

    scale = F.coalesce(*[usable(c) for c in sources.values()])
    method = F.coalesce(*[F.when(usable(c).isNotNull(), F.lit(label)) for label, c in sources.items()])
    df = df.withColumn("scale_method", F.coalesce(method, F.lit("unscaled" if allow_unscaled else "none")))
    return df.withColumn("scale", F.coalesce(scale, F.lit(1.0) if allow_unscaled else F.lit(None).cast("double"))).withColumn("refused", F.lit(not allow_unscaled) & F.col("scale").isNull())


def scene_extent(points: DataFrame, by: list[str], xyz=("x", "y", "z"), approx: bool = False) -> DataFrame:
    """by, extent_x.. (p98 - p2), span (their diagonal), raw_span (corner to corner)."""
    ext = [(pct(c, 0.98, approx) - pct(c, 0.02, approx)).alias(f"extent_{c}") for c in xyz]
    raw = [(F.max(c) - F.min(c)).alias(f"_r{c}") for c in xyz]
    out = points.groupBy(*by).agg(*ext, *raw)
    return out.select(*by, *[f"extent_{c}" for c in xyz], norm(cols(*[f"extent_{c}" for c in xyz])).alias("span"), norm(cols(*[f"_r{c}" for c in xyz])).alias("raw_span"))


def fit_inverse_depth(samples: DataFrame, by: list[str], least: int, relative: str = "relative", metric: str = "metric", excluded: str | None = None, keep_untrimmed: bool = False) -> DataFrame:
    """by, n, a, b, corr, rmse of 1 / metric = a * relative + b over the 5th to 95th percentile of 1 / metric.

    With ``keep_untrimmed``, a group that trimming leaves under ``least`` samples of uses all of them.
    """
    ok = (F.col(metric) > 1e-3) & F.col(relative).isNotNull() & ~F.isnan(F.col(relative).cast("double")) & (F.col(metric) < float("inf"))
    if excluded:
        ok = ok & ~F.col(excluded)
    w = Window.partitionBy(*by)
    rows = samples.where(ok).select(*by, F.col(relative).cast("double").alias("x"), (1.0 / F.col(metric)).alias("y"))
    rows = with_percentiles(rows, by, {"_lo": (F.col("y"), 0.05), "_hi": (F.col("y"), 0.95)})
    rows = rows.withColumn("_in", F.col("y").between(F.col("_lo"), F.col("_hi")))
    if keep_untrimmed:
        rows = rows.withColumn("_in", F.col("_in") | (F.count_if("_in").over(w) < least))
    kept = rows.where("_in")
    fits = kept.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"), F.abs(F.corr("x", "y")).alias("corr"), (F.regr_syy("y", "x") - F.regr_sxy("y", "x") * F.regr_slope("y", "x")).alias("_sse"))
    return fits.where(F.col("n") >= least).withColumn("rmse", F.sqrt(F.greatest(F.col("_sse"), F.lit(0.0)) / F.col("n"))).drop("_sse")


def metric_depth(df: DataFrame, relative: Column, a: Column, b: Column) -> DataFrame:
    """``df`` with depth_m = 1 / (a * relative + b) where that denominator is over 1e-4, else 0."""
    y = a * relative + b
    return df.withColumn("depth_m", F.when(y > 1e-4, 1.0 / y).otherwise(F.lit(0.0)))


def voxel_downsample(cloud: DataFrame, voxel: float, by: list[str], index: str, xyz=("x", "y", "z")) -> DataFrame:
    """One point per voxel, that of the lowest index; no-op for a voxel of 0 or less."""
    if voxel <= 0:
        return cloud
    names = cloud.columns
    keys = [F.floor(F.col(c) / voxel).cast("bigint").alias(f"_v{c}") for c in xyz]
    best = cloud.select("*", *keys).groupBy(*by, *[f"_v{c}" for c in xyz]).agg(F.min_by(F.struct(*names), F.col(index)).alias("_p"))
    return best.select(*[F.col(f"_p.{c}").alias(c) for c in names])


def error_summary(errors: DataFrame, by: list[str], error: str, source: str = "estimated", stretch: int = STRETCH_ROWS) -> DataFrame:
    """median, p90, worst, n of the finite errors of each group; NULL for a group without any."""
    e = F.col(error).cast("double")
    finite = F.when(~F.isnan(e) & (F.abs(e) < float("inf")), e)
    shares = percentiles(errors, by, {"median": (finite, 0.5), "p90": (finite, 0.9)}, stretch)
    rest = errors.groupBy(*by).agg(F.max(finite).alias("worst"), F.count(finite).alias("n"))
    return meet(shares, rest, by, "inner", broadcast=False).withColumn("source", F.lit(source))


def pool_metrics(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Median over episodes of their medians."""
    return metrics.groupBy(*by).agg(pct("median", 0.5).alias("pooled_median"), F.count("median").alias("n_episodes"))


def grasp_summary(frames: DataFrame, by: list[str], order: str, width: str) -> DataFrame:
    """closed_count, closed_fraction, transitions, onset, release, median_width, width_pcts of frames with closed."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.coalesce(F.col("closed") != F.lag("closed").over(w), F.lit(False))
    rows = frames.withColumn("_c", F.when(change, F.col(order)))
    out = rows.groupBy(*by).agg(
        F.count_if("closed").alias("closed_count"), F.avg(F.col("closed").cast("int")).alias("closed_fraction"), F.count("_c").alias("transitions"),
        F.min("_c").alias("onset"), F.max("_c").alias("_last"), pct(width, 0.5).alias("median_width"), F.percentile(width, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("width_pcts"),
    )
    return out.withColumn("release", F.when(F.col("transitions") > 1, F.col("_last"))).drop("_last")


def trajectory_summary(ee: DataFrame, by: list[str], order: str, t: str, width: str, point=("tx", "ty", "tz")) -> DataFrame:
    """n, duration, width range, speed_median, speed_max, path_length of consecutive rows."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = ee.withColumns({f"_p{c}": F.lag(c).over(w) for c in (*point, t)})
    rows = rows.withColumn("_s", norm(sub(cols(*point), cols(*[f"_p{c}" for c in point])))).withColumn("_v", F.when(F.col(t) > F.col(f"_p{t}"), F.col("_s") / (F.col(t) - F.col(f"_p{t}"))))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), (F.max(t) - F.min(t)).alias("duration"), F.min(width).alias("width_min"), F.max(width).alias("width_max"), pct("_v", 0.5).alias("speed_median"), F.max("_v").alias("speed_max"), F.coalesce(F.sum("_s"), F.lit(0.0)).alias("path_length"))


def motion_diagnostics(poses: DataFrame, fps: float, by: list[str], order: str, valid: str = "valid", point=("tx", "ty", "tz")) -> DataFrame:
    """path_length, median_speed, max_speed, range_* over valid rows with gaps closed up; only sequences of 3 valid rows or more."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = poses.where(F.col(valid)).withColumns({f"_p{c}": F.lag(c).over(w) for c in point})
    rows = rows.withColumn("_s", norm(sub(cols(*point), cols(*[f"_p{c}" for c in point]))))
    out = rows.groupBy(*by).agg(F.count("*").alias("n_valid"), F.sum("_s").alias("path_length"), (pct("_s", 0.5) * fps).alias("median_speed"), (F.max("_s") * fps).alias("max_speed"), *[(F.max(c) - F.min(c)).alias(f"range_{c}") for c in point])
    return out.where("n_valid >= 3")


def view_coverage(pixels: DataFrame, frames: DataFrame, width: int, height: int, by: list[str], frame: str) -> DataFrame:
    """by, mean_coverage, min_coverage over all of ``frames``: distinct covered pixels over the image's."""
    return covered_share(pixels.select(*by, frame, "px", "py").distinct().groupBy(*by, frame).agg(F.count("*").alias("n_pixels")), frames, width, height, by, frame)


def covered_share(counts: DataFrame, frames: DataFrame, width: int, height: int, by: list[str], frame: str) -> DataFrame:
    """by, mean_coverage, min_coverage over all of ``frames``: n_pixels of ``counts`` over the image's."""
    share = F.coalesce(F.col("n_pixels"), F.lit(0)) / F.lit(width * height)
    return frames.select(*by, frame).distinct().join(counts, [*by, frame], "left").groupBy(*by).agg(F.avg(share).alias("mean_coverage"), F.min(share).alias("min_coverage"))


def detection_summary(frames: DataFrame, by: list[str], hand: str, obj: str, residual: str, area: str) -> DataFrame:
    return frames.groupBy(*by).agg(F.avg(F.col(hand).cast("int")).alias("hand_rate"), F.avg(F.col(obj).cast("int")).alias("object_rate"), pct(residual, 0.5).alias("median_residual"), pct(F.when(F.col(area) > 0, F.col(area)), 0.5).alias("median_area"))


def mask_moments(pixels: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    return pixels.groupBy(*by).agg(F.count("*").alias("area"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def gripper_limits(joints: DataFrame, grippers: DataFrame, by: list[str], default: float) -> DataFrame:
    """by, max_width, limits_source: the largest span of prismatic joints (lower, upper), doubled from two on; else the default."""
    j = joints.where((F.col("kind") == "prismatic") & F.col("lower").isNotNull() & F.col("upper").isNotNull())
    spans = j.groupBy(*by).agg(F.max(F.abs(F.col("upper") - F.col("lower"))).alias("_s"), F.count("*").alias("_n"))
    width = F.col("_s") * F.when(F.col("_n") >= 2, F.lit(2.0)).otherwise(F.lit(1.0))
    out = grippers.select(*by).distinct().join(spans, by, "left")
    return out.select(*by, F.coalesce(width, F.lit(float(default))).alias("max_width"), F.when(F.col("_s").isNull(), F.lit("config")).otherwise(F.lit("joints")).alias("limits_source"))


def batch_rollup(status: DataFrame, by: list[str], clip: str, rate: str) -> DataFrame:
    """episodes, accepted, ok, rates (clip: rate) from rejected. The map is bounded by a run's clips."""
    return status.groupBy(*by).agg(F.count("*").alias("episodes"), F.count_if(~F.col("rejected")).alias("accepted"), F.max(~F.col("rejected")).alias("ok"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(clip), F.col(rate))))).alias("rates"))


def stage_ledger(events: DataFrame, by: list[str], stage: str, label: str, seconds: str, status: str, failed: str) -> DataFrame:
    """by, stage: seconds, n_events, status ("failed" if any event is), timings summed by label."""
    sums = events.groupBy(*by, stage, label).agg(F.sum(seconds).alias("_s"), F.count("*").alias("_n"), F.max(F.col(status) == failed).alias("_f"))
    return sums.groupBy(*by, stage).agg(F.sum("_s").alias("seconds"), F.sum("_n").alias("n_events"), F.when(F.max("_f"), F.lit("failed")).otherwise(F.lit("ok")).alias("status"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label), F.col("_s"))))).alias("timings"))


def config_hash(entries: DataFrame, by: list[str], key: str, value: str, rank: str) -> DataFrame:
    """by, config_hash: of dotted keys, for each the value of the highest ``rank``; the first 16 hex digits of the sha256 of sorted compact JSON."""
    won = entries.groupBy(*by, key).agg(F.max_by(value, rank).alias("_v"))
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("_v").cast("string")))))
    return won.groupBy(*by).agg(F.substring(F.sha2(F.to_json(m), 256), 1, 16).alias("config_hash"))


def model_quality(observations: DataFrame, n_cameras: DataFrame, by: list[str], image: str, point: str, error: str) -> DataFrame:
    """registered, registration_rate, n_points, mean_track_length, mean_observations, mean_error; ``n_cameras`` has by, total."""
    per = observations.groupBy(*by).agg(F.countDistinct(image).alias("registered"), F.countDistinct(point).alias("n_points"), F.count("*").alias("_o"), F.avg(error).alias("mean_error"))
    out = per.join(n_cameras, by)
    return out.select(*by, "registered", (F.col("registered") / F.col("total")).alias("registration_rate"), "n_points", (F.col("_o") / F.col("n_points")).alias("mean_track_length"), (F.col("_o") / F.col("registered")).alias("mean_observations"), "mean_error")


def cloud_radius(points: DataFrame, by: list[str], xyz=("x", "y", "z"), p: float = 0.95, approx: bool = False) -> DataFrame:
    """Percentile of the distance to the mean."""
    means = points.groupBy(*by).agg(*[F.avg(c).alias(f"_m{c}") for c in xyz])
    rows = points.join(means, by).withColumn("_d", norm(sub(cols(*xyz), cols(*[f"_m{c}" for c in xyz]))))
    return rows.groupBy(*by).agg(pct("_d", p, approx).alias("radius"))


def nearest_depth(pixels: DataFrame, by: list[str], depth: str, value: str, layer: str | None = None) -> DataFrame:
    """Per pixel the smallest depth and its value; among equal depths the earlier layer, then the smaller value, wins."""
    key = F.struct(F.col(depth).alias("d"), *([F.col(layer).alias("l")] if layer else []), F.col(value).alias("v"))
    return pixels.groupBy(*by).agg(F.min(key).alias("_k")).select(*by, F.col("_k.d").alias(depth), F.col("_k.v").alias(value))


def marker_agreement(obs: DataFrame, by: list[str], valid_frames: DataFrame, label: str = "scan") -> DataFrame:
    """Position (cm) and rotation (deg) of implied against actual camera poses: i_* and a_* pose columns, marker position m_*.

    median, p90, max of both; coverage = solved / valid frames (``valid_frames``: by, n_valid); spread of the implied marker position.
    """
    P = ("tx", "ty", "tz", "qw", "qx", "qy", "qz")
    i, a = ([F.col(f"{s}_{c}") for c in P] for s in ("i", "a"))
    rows = obs.withColumn("_cm", norm(sub(i[:3], a[:3])) * 100).withColumn("_deg", angle_deg(tuple(i[3:]), tuple(a[3:])))
    spread = norm([F.stddev_pop(f"m_{c}") for c in "xyz"])
    out = rows.groupBy(*by).agg(*[f.alias(f"{n}_{k}") for n, c in (("position_cm", "_cm"), ("rotation_deg", "_deg")) for k, f in (("median", pct(c, 0.5)), ("p90", pct(c, 0.9)), ("max", F.max(c)))], F.count("*").alias("n"), spread.alias("spread"))
    return out.join(valid_frames, by).withColumn("coverage", F.col("n") / F.col("n_valid")).withColumn("label", F.lit(label)).drop("n_valid")


def score_episodes(est: DataFrame, truth: DataFrame, by: list[str], order: str, fps_est: float, fps_true: float) -> DataFrame:
    """by, metric, unit, median, p90, worst, n: camera position and rotation, width and grasp state against truth.

    Estimated rows (pose, width, closed, valid) meet the truth's at their time, half up; only valid rows count.
    """
    P = ("tx", "ty", "tz", "qw", "qx", "qy", "qz")
    n = truth.groupBy(*by).agg(F.count("*").alias("_n"))
    rows = est.where("valid").join(n, by).withColumn("_i", rate_map(F.col(order), fps_est, fps_true, F.col("_n"), "half_up"))
    other = truth.select(*by, F.col(order).cast("bigint").alias("_i"), *[F.col(c).alias(f"_{c}") for c in (*P, "width", "closed")])
    rows = rows.join(other, [*by, "_i"])
    metrics = F.array(
        F.struct(F.lit("camera_position").alias("metric"), F.lit("cm").alias("unit"), (norm(sub(cols(*P[:3]), cols(*[f"_{c}" for c in P[:3]]))) * 100).alias("e")),
        F.struct(F.lit("camera_rotation").alias("metric"), F.lit("deg").alias("unit"), angle_deg(cols(*P[3:]), cols(*[f"_{c}" for c in P[3:]])).alias("e")),
        F.struct(F.lit("grasp_width").alias("metric"), F.lit("m").alias("unit"), F.abs(F.col("width") - F.col("_width")).alias("e")),
        F.struct(F.lit("grasp_state").alias("metric"), F.lit("agree").alias("unit"), (F.col("closed") == F.col("_closed")).cast("double").alias("e")),
    )
    return error_summary(rows.select(*by, F.inline(metrics)), [*by, "metric", "unit"], "e")


def implied_pose(q, t, mq, mt) -> tuple[Column, ...]:
    """Camera pose implied by a marker's fixed pose (mq, mt) and its pose in the camera (q, t)."""
    back = conj(q)
    cq = qmul(mq, back)
    return (*add(mt, rotate(mq, tuple(-c for c in rotate(back, t)))), *cq)
