"""Queries of frame curation, projections of clip tables and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlake.operators import aggs, gates, project
from trajlake.plans.bindings import SIG, TRAJ, sig, table, traj
from trajlake.plans.registry import query
from trajlake.plans.sequences import rounded

_C1 = """m AS (SELECT *, greatest(coalesce(quantile_cont(width, 0.5) OVER (PARTITION BY clip) * 0.3, 1.0), 1.0) AS threshold, count(*) OVER (PARTITION BY clip) AS n,
        row_number() OVER (PARTITION BY clip ORDER BY width DESC NULLS LAST, frame) AS rk FROM sig),
    o AS (SELECT *, coalesce(width >= threshold, false) AS ok, count(*) FILTER (coalesce(width >= threshold, false)) OVER (PARTITION BY clip) AS kept_n FROM m),
    c1 AS (SELECT *, (n - kept_n) / n > 0.15 AS capped, CASE WHEN (n - kept_n) / n > 0.15 THEN rk <= greatest(1, round_even(n * 0.85, 0)) ELSE ok END AS keep FROM o)"""


def _gated(spark, sf):
    return gates.blur_gate(sig(spark, sf), 0.3, 1.0, 0.15, ["clip"], "frame", sharpness="width")


@query(f"WITH {SIG}, {_C1} SELECT clip, frame, round(threshold, 6) AS threshold, keep, capped FROM c1")
def c1_blur_gate(spark, sf):
    return rounded(_gated(spark, sf).select("clip", "frame", "threshold", "keep", "capped"), ["threshold"])


@query(f"""WITH {SIG}, {_C1} SELECT clip, count(*) FILTER (keep AND flag) AS n_kept, count(*) FILTER (NOT keep) AS dropped_blur, count(*) FILTER (keep AND NOT flag) AS dropped_duplicate,
    round(max(threshold), 6) AS threshold, round(quantile_cont(width, 0.5), 6) AS median, round(avg(width), 6) AS mean, round(quantile_cont(width, 0.1), 6) AS p10 FROM c1 GROUP BY 1""")
def e1_quality_summary(spark, sf):
    frames = _gated(spark, sf).withColumn("kept", F.col("keep") & F.col("flag"))
    return rounded(aggs.quality_summary(frames, ["clip"], "width"), ["threshold", "median", "mean", "p10"])


@query(f"""WITH {SIG}, n AS (SELECT *, count(*) OVER (PARTITION BY clip) AS n, count(*) FILTER (flag) OVER (PARTITION BY clip) AS k FROM sig)
    SELECT clip, frame, round(frame / 30.0, 6) AS t_s, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS frame_idx,
        printf('%05d', row_number() OVER (PARTITION BY clip ORDER BY frame) - 1) AS name, round(30.0 * k / n, 6) AS effective_fps FROM n WHERE flag""")
def b4_frame_clock(spark, sf):
    out = project.frame_clock(sig(spark, sf), 30.0, "flag", ["clip"], "frame").withColumn("frame_idx", F.col("frame_idx").cast("bigint"))
    return rounded(out.select("clip", "frame", "t_s", "frame_idx", "name", "effective_fps"), ["t_s", "effective_fps"])


_BITS = """bits AS (SELECT vec_id, label, embedding, list_sort(embedding[2:64])[32] AS med FROM embeddings),
    hash AS (SELECT label AS clip, vec_id AS frame, list_transform(embedding[1:64], lambda x: (x > med)::int) AS b FROM bits)"""


def _hashed(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("clip"), F.col("vec_id").alias("frame"), "embedding")
    return project.phash_bits(e, "embedding")


@query(f"WITH {_BITS} SELECT clip, frame, list_sum(b)::bigint AS ones, b[1] = 1 AS first_bit, b[64] = 1 AS last_bit FROM hash")
def b14_phash_bits(spark, sf):
    h = F.col("phash")
    return _hashed(spark, sf).select("clip", "frame", F.bit_count(h).cast("bigint").alias("ones"), (h < 0).alias("first_bit"), (h.bitwiseAND(1) == 1).alias("last_bit"))


@query(f"""WITH RECURSIVE {_BITS}, num AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY frame) AS k FROM hash),
    walk AS (SELECT clip, frame, k, b AS last, true AS kept FROM num WHERE k = 1 UNION ALL
        SELECT n.clip, n.frame, n.k, CASE WHEN h >= 32 THEN n.b ELSE w.last END, h >= 32 FROM (SELECT w.*, n.b AS nb, list_sum(list_transform(list_zip(w.last, n.b), lambda p: (p[1] <> p[2])::int)) AS h, n.frame AS nf FROM walk w JOIN num n ON n.clip = w.clip AND n.k = w.k + 1) w JOIN num n ON n.clip = w.clip AND n.k = w.k + 1)
    SELECT clip, frame FROM walk WHERE kept""")
def c2_drop_near_duplicates(spark, sf):
    return gates.drop_near_duplicates(_hashed(spark, sf), 32, ["clip"], "frame").select("clip", "frame")


@query("SELECT p_partkey, p_size <= 40 AS passed, 40.0::double AS threshold, 'deg' AS unit FROM part")
def c3_fov_gate(spark, sf):
    return gates.fov_gate(table(spark, sf, "part"), 40.0, "p_size").select("p_partkey", "passed", "threshold", "unit")


@query("SELECT l_orderkey, min(l_quantity) AS z_min, max(l_quantity) AS z_max FROM lineitem GROUP BY 1 HAVING min(l_quantity) >= 2 AND max(l_quantity) <= 45")
def c4_hand_depth_filter(spark, sf):
    return gates.hand_depth_filter(table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity", 2, 45)


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 0.02 * p_retailprice * 1.5")
def c5_mask_area_gate(spark, sf):
    parts = table(spark, sf, "part").withColumn("h", F.lit(1.5))
    return gates.mask_area_gate(parts, 10, 0.02, "p_size", "p_retailprice", "h").select("p_partkey", "p_size")


@query("""SELECT l_orderkey, count(*) AS n, round(sqrt(stddev_pop(l_quantity) ^ 2 + stddev_pop(l_discount) ^ 2 + stddev_pop(l_tax) ^ 2), 6) AS spread FROM lineitem GROUP BY 1
    HAVING count(*) >= 4 AND sqrt(stddev_pop(l_quantity) ^ 2 + stddev_pop(l_discount) ^ 2 + stddev_pop(l_tax) ^ 2) <= 15""")
def c6_cloud_gate(spark, sf):
    return rounded(gates.cloud_gate(table(spark, sf, "lineitem"), ["l_orderkey"], 4, 15.0, ("l_quantity", "l_discount", "l_tax")), ["spread"])


E19 = f"""st AS (SELECT *, sqrt((tx - lag(tx) OVER w) ^ 2 + (ty - lag(ty) OVER w) ^ 2 + (tz - lag(tz) OVER w) ^ 2) AS s FROM traj WHERE valid WINDOW w AS (PARTITION BY clip ORDER BY frame)),
    e19 AS (SELECT clip, count(*) AS n_valid, sum(s) AS path_length, quantile_cont(s, 0.5) * 30 AS median_speed, max(s) * 30 AS max_speed, max(tx) - min(tx) AS range_tx, max(ty) - min(ty) AS range_ty, max(tz) - min(tz) AS range_tz FROM st GROUP BY 1 HAVING count(*) >= 3)"""
_EX = ", ".join(f"quantile_cont({c}, 0.98) - quantile_cont({c}, 0.02) AS extent_{c}, max({c}) - min({c}) AS r{c}" for c in ("tx", "ty", "tz"))
E9 = f"ex AS (SELECT clip, {_EX} FROM traj GROUP BY 1), e9 AS (SELECT *, sqrt(extent_tx ^ 2 + extent_ty ^ 2 + extent_tz ^ 2) AS span, sqrt(rtx ^ 2 + rty ^ 2 + rtz ^ 2) AS raw_span FROM ex)"


@query(f"WITH {TRAJ}, {E19} SELECT clip, n_valid, round(path_length, 5) AS path_length, round(median_speed, 5) AS median_speed, round(max_speed, 5) AS max_speed, round(range_tx, 5) AS range_tx, round(range_ty, 5) AS range_ty, round(range_tz, 5) AS range_tz FROM e19")
def e19_motion_diagnostics(spark, sf):
    out = aggs.motion_diagnostics(traj(spark, sf), 30.0, ["clip"], "frame")
    return rounded(out, [c for c in out.columns if c not in ("clip", "n_valid")], 5)


@query(f"WITH {TRAJ}, {E9} SELECT clip, round(extent_tx, 6) AS extent_tx, round(extent_ty, 6) AS extent_ty, round(extent_tz, 6) AS extent_tz, round(span, 6) AS span, round(raw_span, 6) AS raw_span FROM e9")
def e9_scene_extent(spark, sf):
    out = aggs.scene_extent(traj(spark, sf), ["clip"], ("tx", "ty", "tz"))
    return rounded(out, out.columns[1:])


@query(f"""WITH {TRAJ}, {E19}, {E9}, rate AS (SELECT clip, avg(valid::int) AS register_rate, avg((vec_id % 3 <> 0)::int) AS inlier_ratio FROM traj GROUP BY 1),
    j AS (SELECT clip, register_rate, inlier_ratio, median_speed, path_length, span, clip % 2 = 0 AS device, 1 - register_rate AS loss FROM e19 JOIN e9 USING (clip) JOIN rate USING (clip)),
    s AS (SELECT *, CASE WHEN register_rate >= 0.85 THEN 'sfm' WHEN device THEN 'device' ELSE 'failed' END AS pose_source FROM j),
    r AS (SELECT *, list_filter([CASE WHEN round(median_speed, 4) > 8.0 THEN 'median speed above 8.0 m/s' END, CASE WHEN round(path_length, 4) > 13.0 * span THEN 'path above 13.0 x scene span' END,
        CASE WHEN pose_source = 'sfm' AND inlier_ratio < 0.66 THEN 'inlier ratio below 0.66' END], lambda x: x IS NOT NULL) AS reasons FROM s),
    v AS (SELECT *, CASE WHEN len(reasons) > 0 THEN 'implausible: ' || array_to_string(reasons, '; ') WHEN pose_source = 'failed' THEN 'localization failed' WHEN loss > 0.15 THEN 'tracking loss' END AS reject_reason FROM r)
    SELECT clip, pose_source, reject_reason IS NOT NULL AS rejected, reject_reason, len(reasons) AS n_reasons, round(median_speed, 4) AS median_speed, round(path_length, 4) AS path_length, round(span, 4) AS span FROM v""")
def c7_localization_decision(spark, sf):
    t = traj(spark, sf)
    rate = t.groupBy("clip").agg(F.avg(F.col("valid").cast("int")).alias("register_rate"), F.avg((F.col("vec_id") % 3 != 0).cast("int")).alias("inlier_ratio"))
    stats = aggs.motion_diagnostics(t, 30.0, ["clip"], "frame").join(aggs.scene_extent(t, ["clip"], ("tx", "ty", "tz")), "clip").join(rate, "clip")
    stats = stats.withColumn("tracking_loss", 1 - F.col("register_rate")).withColumn("scale_method", F.when(F.col("clip") % 2 == 0, "arkit_sim3").otherwise("manual")).withColumn("device_available", F.lit(True))
    out = gates.localization_decision(stats, 0.85, 0.15, 8.0, 13.0, 0.66).withColumn("n_reasons", F.size("reasons").cast("bigint"))
    return rounded(out.select("clip", "pose_source", "rejected", "reject_reason", "n_reasons", "median_speed", "path_length", "span"), ["median_speed", "path_length", "span"], 4)


@query("""WITH a AS (SELECT o_custkey, median(o_totalprice) FILTER (o_orderstatus = 'F') AS demo, median(o_totalprice) AS reference FROM orders GROUP BY 1), r AS (SELECT *, CASE WHEN reference > 0 THEN coalesce(demo, 0) / 3 / reference ELSE 0 END AS ratio FROM a)
    SELECT o_custkey, CASE WHEN ratio >= 0.4 THEN 'PASS' WHEN ratio >= 0.25 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict, round(ratio, 4) AS gate_value FROM r""")
def c8_preflight_verdict(spark, sf):
    a = table(spark, sf, "orders").groupBy("o_custkey").agg(F.percentile(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")), F.lit(0.5)).alias("demo"), F.percentile("o_totalprice", F.lit(0.5)).alias("reference"))
    a = a.withColumn("demo", F.coalesce("demo", F.lit(0.0)) / 3)
    return gates.preflight_verdict(a, "demo", "reference").select("o_custkey", "verdict", "gate_value")


@query("""WITH a AS (SELECT o_custkey, count(*) FILTER (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') AS n, avg(o_totalprice) / 60000 AS p, stddev_pop(o_totalprice) / 15000 AS r, avg((o_orderstatus = 'F')::int) AS c FROM orders GROUP BY 1)
    SELECT o_custkey, g.name, coalesce(g.passed, false) AS passed, round(g.value, 4) AS value, g.threshold, g.unit, g.detail FROM (SELECT o_custkey, unnest(CASE WHEN n > 0 THEN [
        {'name': 'marker_position', 'passed': p <= 3.0, 'value': p, 'threshold': 3.0::double, 'unit': 'cm', 'detail': ''},
        {'name': 'marker_rotation', 'passed': r <= 5.0, 'value': r, 'threshold': 5.0::double, 'unit': 'deg', 'detail': ''},
        {'name': 'marker_coverage', 'passed': c >= 0.5, 'value': c, 'threshold': 0.5::double, 'unit': 'fraction', 'detail': ''}]
        ELSE [{'name': 'marker_position', 'passed': false, 'value': NULL::double, 'threshold': 3.0::double, 'unit': 'cm', 'detail': 'marker not observed'}] END) AS g FROM a)""")
def c9_marker_gates(spark, sf):
    p = F.col("o_orderpriority")
    a = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(p.like("1%") | p.like("2%")).alias("n"), (F.avg("o_totalprice") / 60000).alias("position_cm"), (F.stddev_pop("o_totalprice") / 15000).alias("rotation_deg"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("coverage"))
    return rounded(gates.marker_gates(a, ["o_custkey"]), ["value"], 4)


@query("SELECT o_custkey, round(count(*) FILTER (o_orderstatus <> 'P') / count(*), 6) AS registration_rate, count(*) FILTER (o_orderstatus <> 'P') / count(*) >= 0.8 AS passed FROM orders GROUP BY 1")
def c10_scene_gate(spark, sf):
    a = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") != "P").alias("registered"), F.count("*").alias("total"))
    return rounded(gates.scene_gate(a).select("o_custkey", "registration_rate", "passed"), ["registration_rate"])


@query("""WITH a AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS v, count(*) FILTER (o_orderpriority LIKE '1%') AS c, avg((o_totalprice > 150000)::int) AS m FROM orders GROUP BY 1)
    SELECT o_custkey, v = 0 AS rejected, CASE WHEN v = 0 THEN NULL WHEN c = 0 THEN 'gripper never closes' WHEN m < 0.5 THEN 'low view coverage' END AS warning FROM a""")
def c11_episode_verdict(spark, sf):
    a = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("valid_hands"), F.count_if(F.col("o_orderpriority").like("1%")).alias("closed_frames"), F.avg((F.col("o_totalprice") > 150000).cast("int")).alias("mean_coverage"))
    return gates.episode_verdict(a).select("o_custkey", "rejected", "warning")


_E10 = """s AS (SELECT l_suppkey AS grp, l_quantity::double AS x, 1 / l_extendedprice AS y FROM lineitem WHERE l_extendedprice > 0.001),
    q AS (SELECT *, quantile_cont(y, 0.05) OVER (PARTITION BY grp) AS lo, quantile_cont(y, 0.95) OVER (PARTITION BY grp) AS hi FROM s),
    fit AS (SELECT grp, count(*) AS n, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, abs(corr(x, y)) AS corr, sqrt(greatest(regr_syy(y, x) - regr_sxy(y, x) * regr_slope(y, x), 0) / count(*)) AS rmse FROM q WHERE y BETWEEN lo AND hi GROUP BY 1 HAVING count(*) >= 20)"""


def _fits(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_quantity").alias("relative"), F.col("l_extendedprice").alias("metric"))
    return aggs.fit_inverse_depth(rows, ["grp"], 20)


@query(f"WITH {_E10} SELECT grp, n, round(a * 1e6, 4) AS a, round(b * 1e6, 4) AS b, round(corr, 6) AS corr, round(rmse * 1e6, 4) AS rmse FROM fit")
def e10_fit_inverse_depth(spark, sf):
    return _fits(spark, sf).select("grp", "n", *[F.round(F.col(c) * 1e6, 4).alias(c) for c in ("a", "b", "rmse")], F.round("corr", 6).alias("corr"))


@query(f"WITH {_E10} SELECT grp, n, round(corr, 6) AS corr FROM fit WHERE n >= 20 AND corr >= 0.05")
def c12_accept_depth_fit(spark, sf):
    return rounded(gates.accept_depth_fit(_fits(spark, sf), 20, 0.05).select("grp", "n", "corr"), ["corr"])


@query("""WITH i AS (SELECT p_partkey, p_retailprice AS w, p_size AS f, p_size > 10 AS k FROM part), x AS (SELECT *, CASE WHEN k THEN f / 36.0 * w ELSE w * 0.9 END AS fx FROM i)
    SELECT p_partkey, round(fx, 6) AS fx, round(w / 2, 6) AS cx, round(degrees(2 * atan(w / 2 / fx)), 6) AS fov_deg, CASE WHEN k THEN 'focal_35mm' ELSE 'fallback_guess' END AS source, NOT k AS self_calibrate, CASE WHEN k THEN 'PINHOLE' ELSE 'SIMPLE_RADIAL' END AS camera_model FROM x""")
def b1_derive_intrinsics(spark, sf):
    clips = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("width"), F.lit(480.0).alias("height"), F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).otherwise(F.lit(0.0)).alias("focal_35mm"))
    return rounded(project.derive_intrinsics(clips).select("p_partkey", "fx", "cx", "fov_deg", "source", "self_calibrate", "camera_model"), ["fx", "cx", "fov_deg"])


@query("""WITH s AS (SELECT p_partkey, p_retailprice AS w, 600.0 AS h, least(1.0, 640.0 / greatest(p_retailprice, 600.0)) AS s FROM part), n AS (SELECT *, greatest(32, round_even(w * s, 0)::int) AS nw, greatest(32, round_even(h * s, 0)::int) AS nh FROM s)
    SELECT p_partkey, nw AS width, nh AS height, round(w * 0.9 * nw / w, 6) AS fx, round(h / 2 * nh / h, 6) AS cy FROM n""")
def b2_scale_intrinsics(spark, sf):
    clips = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("width"), F.lit(600.0).alias("height"), F.lit(None).cast("double").alias("focal_35mm"))
    clips = project.derive_intrinsics(clips)
    out = project.scale_intrinsics(clips, *project.working_size(F.col("width"), F.col("height"), 640))
    return rounded(out.select("p_partkey", "width", "height", "fx", "cy"), ["fx", "cy"])


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS width, CAST(json_extract(props, '$.k') AS INTEGER) * 90 % 360 AS rotation_deg, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) > 0 THEN round(CAST(json_extract(props, '$.k') AS INTEGER) / 1.001, 6) END AS fps FROM events""")
def b3_normalise_probe(spark, sf):
    k = F.get_json_object("props", "$.k")
    probe = F.to_json(F.struct(k.alias("width"), k.alias("height"), (k.cast("int") * 90).cast("string").alias("rotation"), F.lit("0/0").alias("avg_frame_rate"), F.concat(k, F.lit("000/1001")).alias("r_frame_rate"), F.lit("2.0").alias("duration")))
    out = project.normalise_probe(table(spark, sf, "events").select("event_id", probe.alias("probe")), "probe", ["focal35", "focal"])
    return rounded(out.select("event_id", "width", "rotation_deg", "fps"), ["fps"])
