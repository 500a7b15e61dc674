"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlake.operators import aggs
from trajlake.plans.bindings import SIG, TRAJ, cloud, sig, table, traj
from trajlake.plans.registry import query
from trajlake.plans.sequences import rounded

_XYZ = ("tx", "ty", "tz")


@query("""SELECT o_custkey, round(avg(v::int), 6) AS register_rate, round(quantile_cont(CASE WHEN v THEN i / greatest(c, 1) END, 0.5), 6) AS inlier_ratio, trunc(quantile_cont(CASE WHEN v THEN i END, 0.5))::int AS median_inliers,
    trunc(quantile_cont(CASE WHEN v THEN c END, 0.5))::int AS median_correspondences, round(1 - avg(v::int), 6) AS tracking_loss
    FROM (SELECT o_custkey, o_orderstatus <> 'P' AS v, o_orderkey % 40 AS i, o_orderkey % 90 AS c FROM orders) GROUP BY 1""")
def e4_registration_summary(spark, sf):
    frames = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderstatus") != "P").alias("valid"), (F.col("o_orderkey") % 40).alias("inliers"), (F.col("o_orderkey") % 90).alias("correspondences"))
    return rounded(aggs.registration_summary(frames, ["o_custkey"]), ["register_rate", "inlier_ratio", "tracking_loss"])


@query("""WITH c AS (SELECT o_orderpriority AS p, l_suppkey AS s, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), b AS (SELECT p, max(n) AS n, arg_max(s, n * 1000000 - s) AS s, count(*) AS k, sum(s)::bigint AS t FROM c GROUP BY 1)
    SELECT p, s AS marker_id, n AS n_detections, k - 1 AS n_ignored, t - s AS sum_ignored FROM b""")
def e5_dominant_marker(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("p"), F.col("l_suppkey").alias("s"))
    out = aggs.dominant_marker(d, ["p"], "s", 10)
    return out.select("p", "marker_id", "n_detections", F.size("ignored").cast("bigint").alias("n_ignored"), F.aggregate("ignored", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_ignored"))


@query(f"""WITH {TRAJ}, c AS (SELECT clip, frame // 4 AS g, frame % 4 AS k, tx AS x, ty AS y, tz AS z FROM traj), s AS (SELECT a.clip, a.g, count(*) AS n, avg(sqrt((b.x - a.x) ^ 2 + (b.y - a.y) ^ 2 + (b.z - a.z) ^ 2)) AS side FROM c a JOIN c b ON a.clip = b.clip AND a.g = b.g AND b.k = (a.k + 1) % 4 GROUP BY 1, 2)
    SELECT clip, g, round(side, 6) AS side, round(0.1 / side, 6) AS scale FROM s WHERE n = 4""")
def e6_marker_scale(spark, sf):
    corners = traj(spark, sf).select("clip", F.floor(F.col("frame") / 4).alias("g"), (F.col("frame") % 4).alias("corner"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    return rounded(aggs.marker_scale(corners, ["clip", "g"], 0.1), ["side", "scale"])


@query("""WITH v AS (SELECT l_orderkey, l_quantity * p_size / 500.0 AS w, l_quantity * 2 * p_size / 500.0 AS h FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT l_orderkey, count(*) AS n_views, round(quantile_cont(w, 0.5), 6) AS width, round(quantile_cont(w, 0.84) - quantile_cont(w, 0.16), 6) AS spread, round(quantile_cont(h, 0.9), 6) AS height_p90, round(0.3 / quantile_cont(w, 0.5), 6) AS scale FROM v GROUP BY 1 HAVING count(*) >= 3""")
def e7_known_object_scale(spark, sf):
    v = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    v = v.select("l_orderkey", F.lit(0.0).alias("x0"), F.col("l_quantity").alias("x1"), F.lit(0.0).alias("y0"), (F.col("l_quantity") * 2).alias("y1"), F.col("p_size").alias("dist"), F.lit(500.0).alias("fx"))
    return rounded(aggs.known_object_scale(v, ["l_orderkey"], 0.3), ["width", "spread", "height_p90", "scale"])


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS a, CASE WHEN o_orderpriority LIKE '1%' THEN -1.0 WHEN o_orderpriority LIKE '2%' THEN 2.5 END AS b, CASE WHEN o_custkey % 3 = 0 AND o_custkey > 0 THEN o_custkey::double END AS c FROM orders)
    SELECT o_orderkey, CASE WHEN a > 0 THEN 'arkit' WHEN b > 0 THEN 'aruco' WHEN c > 0 THEN 'manual' ELSE 'none' END AS scale_method, round(coalesce(a, CASE WHEN b > 0 THEN b END, c), 6) AS scale, coalesce(a, CASE WHEN b > 0 THEN b END, c) IS NULL AS refused FROM s""")
def e8_resolve_scale(spark, sf):
    p = F.col("o_orderpriority")
    s = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("a"), F.when(p.like("1%"), F.lit(-1.0)).when(p.like("2%"), F.lit(2.5)).alias("b"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey").cast("double")).alias("c"))
    return rounded(aggs.resolve_scale(s, {"arkit": "a", "aruco": "b", "manual": "c"}).select("o_orderkey", "scale_method", "scale", "refused"), ["scale"])


@query(f"WITH {TRAJ} SELECT clip, arg_min(vec_id, vec_id) AS point_id, round(arg_min(tx, vec_id), 6) AS x FROM traj GROUP BY clip, floor(tx / 0.1), floor(ty / 0.1), floor(tz / 0.1)")
def e12_voxel_downsample(spark, sf):
    return rounded(aggs.voxel_downsample(cloud(spark, sf), 0.1, ["clip"], "point_id").select("clip", "point_id", "x"), ["x"])


_E15 = "e15 AS (SELECT l_suppkey AS episode, l_returnflag AS metric, quantile_cont(l_discount * l_extendedprice, 0.5) AS median, quantile_cont(l_discount * l_extendedprice, 0.9) AS p90, max(l_discount * l_extendedprice) AS worst, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def _errors(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("episode"), F.col("l_returnflag").alias("metric"), (F.col("l_discount") * F.col("l_extendedprice")).alias("e"))
    return aggs.error_summary(rows, ["episode", "metric"], "e")


@query(f"WITH {_E15} SELECT episode, metric, round(median, 6) AS median, round(p90, 6) AS p90, round(worst, 6) AS worst, n, 'estimated' AS source FROM e15")
def e15_error_summary(spark, sf):
    return rounded(_errors(spark, sf), ["median", "p90", "worst"])


@query(f"WITH {_E15} SELECT metric, 'estimated' AS source, round(quantile_cont(median, 0.5), 4) AS pooled_median, count(median) AS n_episodes FROM e15 GROUP BY 1")
def e16_pool_metrics(spark, sf):
    return rounded(aggs.pool_metrics(_errors(spark, sf), ["metric", "source"]), ["pooled_median"], 4)


@query(f"""WITH {TRAJ}, s AS (SELECT clip, frame / 30.0 AS t, ox, sqrt((tx - lag(tx) OVER w) ^ 2 + (ty - lag(ty) OVER w) ^ 2 + (tz - lag(tz) OVER w) ^ 2) AS s FROM traj WINDOW w AS (PARTITION BY clip ORDER BY frame))
    SELECT clip, count(*) AS n, round(max(t) - min(t), 5) AS duration, round(min(ox), 5) AS width_min, round(max(ox), 5) AS width_max, round(quantile_cont(s * 30, 0.5), 5) AS speed_median, round(max(s * 30), 5) AS speed_max, round(sum(s), 5) AS path_length FROM s GROUP BY 1""")
def e18_trajectory_summary(spark, sf):
    out = aggs.trajectory_summary(traj(spark, sf).withColumn("t", F.col("frame") / 30.0), ["clip"], "frame", "t", "ox")
    return rounded(out, out.columns[2:], 5)


@query("""SELECT o_custkey, round(avg((o_orderstatus = 'F')::int), 6) AS hand_rate, round(avg((o_orderstatus = 'O')::int), 6) AS object_rate, round(quantile_cont(CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END, 0.5), 4) AS median_residual,
    round(quantile_cont(CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 END, 0.5), 4) AS median_area FROM orders GROUP BY 1""")
def e21_detection_summary(spark, sf):
    f = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("h"), (F.col("o_orderstatus") == "O").alias("o"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("r"), (F.col("o_orderkey") % 7).alias("a"))
    out = aggs.detection_summary(f, ["o_custkey"], "h", "o", "r", "a")
    return rounded(rounded(out, ["hand_rate", "object_rate"]), ["median_residual", "median_area"], 4)


@query("SELECT l_orderkey, count(*) AS area, round(avg(l_quantity), 6) AS cx, round(avg(l_linenumber), 6) AS cy, min(l_quantity) AS x0, min(l_linenumber) AS y0, max(l_quantity) AS x1, max(l_linenumber) AS y1 FROM lineitem GROUP BY 1")
def e22_mask_moments(spark, sf):
    return rounded(aggs.mask_moments(table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity", "l_linenumber"), ["cx", "cy"])


@query("""WITH j AS (SELECT p_brand, max(abs(p_size - 7)) AS s, count(*) AS n FROM part WHERE p_size > 49 GROUP BY 1) SELECT DISTINCT part.p_brand, coalesce(s * CASE WHEN n >= 2 THEN 2.0 ELSE 1.0 END, 85.0)::double AS max_width, CASE WHEN s IS NULL THEN 'config' ELSE 'joints' END AS limits_source FROM part LEFT JOIN j USING (p_brand)""")
def e23_gripper_limits(spark, sf):
    p = table(spark, sf, "part")
    j = p.select("p_brand", F.when(F.col("p_size") > 49, F.lit("prismatic")).otherwise(F.lit("revolute")).alias("kind"), F.lit(7).alias("lower"), F.col("p_size").alias("upper"))
    return aggs.gripper_limits(j, p, ["p_brand"], 85.0).withColumn("max_width", F.col("max_width").cast("double"))


@query("""WITH s AS (SELECT o_custkey % 100 AS run, o_orderpriority AS clip, avg((o_orderstatus = 'F')::int) AS rate FROM orders GROUP BY 1, 2)
    SELECT run, count(*) AS episodes, count(*) FILTER (rate >= 0.5) AS accepted, max(rate >= 0.5) AS ok, round(sum(rate), 6) AS rate_sum FROM s GROUP BY 1""")
def e24_batch_rollup(spark, sf):
    s = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 100).alias("run"), F.col("o_orderpriority").alias("clip")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("rate"))
    out = aggs.batch_rollup(s.withColumn("rejected", F.col("rate") < 0.5), ["run"], "clip", "rate")
    return out.select("run", "episodes", "accepted", "ok", F.round(F.aggregate(F.map_values("rates"), F.lit(0.0), lambda a, x: a + x), 6).alias("rate_sum"))


@query("""WITH l AS (SELECT o_custkey AS run, o_orderpriority AS stage, o_orderstatus AS label, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1, 2, 3)
    SELECT run, stage, round(sum(s), 2) AS seconds, sum(n)::bigint AS n_events, CASE WHEN max(label = 'P') THEN 'failed' ELSE 'ok' END AS status, count(*) AS n_labels, round(max(s), 2) AS longest FROM l GROUP BY 1, 2""")
def e25_stage_ledger(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("label"), F.col("o_totalprice").alias("s"))
    out = aggs.stage_ledger(o, ["run"], "stage", "label", "s", "label", "P")
    return out.select("run", "stage", F.round("seconds", 2).alias("seconds"), "n_events", "status", F.size("timings").cast("bigint").alias("n_labels"), F.round(F.array_max(F.map_values("timings")), 2).alias("longest"))


@query("""WITH w AS (SELECT o_custkey AS run, 'k.' || o_orderpriority AS k, arg_max(o_orderstatus, o_orderkey) AS v FROM orders GROUP BY 1, 2)
    SELECT run, substr(sha256('{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}'), 1, 16) AS config_hash FROM w GROUP BY 1""")
def e25_config_hash(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.concat(F.lit("k."), F.col("o_orderpriority")).alias("k"), F.col("o_orderstatus").alias("v"), "o_orderkey")
    return aggs.config_hash(o, ["run"], "k", "v", "o_orderkey")


@query("""WITH o AS (SELECT l_suppkey % 10 AS scene, l_orderkey AS img, l_partkey AS pt, l_discount AS e FROM lineitem), t AS (SELECT l_suppkey % 10 AS scene, count(DISTINCT l_orderkey) * 2 AS total FROM lineitem GROUP BY 1)
    SELECT scene, count(DISTINCT img) AS registered, round(count(DISTINCT img) / any_value(total), 6) AS registration_rate, count(DISTINCT pt) AS n_points, round(count(*) / count(DISTINCT pt), 6) AS mean_track_length, round(count(*) / count(DISTINCT img), 6) AS mean_observations, round(avg(e), 6) AS mean_error FROM o JOIN t USING (scene) GROUP BY 1""")
def e26_model_quality(spark, sf):
    o = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("scene"), "l_orderkey", "l_partkey", "l_discount")
    total = o.groupBy("scene").agg((F.countDistinct("l_orderkey") * 2).alias("total"))
    out = aggs.model_quality(o, total, ["scene"], "l_orderkey", "l_partkey", "l_discount")
    return rounded(out, ["registration_rate", "mean_track_length", "mean_observations", "mean_error"])


@query(f"""WITH {TRAJ}, m AS (SELECT clip, avg(tx) AS a, avg(ty) AS b, avg(tz) AS c FROM traj GROUP BY 1) SELECT clip, round(quantile_cont(sqrt((tx - a) ^ 2 + (ty - b) ^ 2 + (tz - c) ^ 2), 0.95), 6) AS radius FROM traj JOIN m USING (clip) GROUP BY 1""")
def e27_cloud_radius(spark, sf):
    return rounded(aggs.cloud_radius(traj(spark, sf), ["clip"], _XYZ), ["radius"])


# What the reference's documents describe beyond its code.


@query(f"WITH {SIG}, d AS (SELECT clip, t - lag(t) OVER (PARTITION BY clip ORDER BY frame) AS dt FROM sig) SELECT clip, count(dt) AS n_steps, count(*) FILTER (abs(dt - 3600) > 1800) AS n_off, round(max(abs(dt - 3600)), 4) AS worst FROM d GROUP BY 1")
def p1_timestamp_consistency(spark, sf):
    from pyspark.sql.window import Window

    d = sig(spark, sf).withColumn("dt", F.col("t") - F.lag("t").over(Window.partitionBy("clip").orderBy("frame")))
    off = F.abs(F.col("dt") - 3600)
    return d.groupBy("clip").agg(F.count("dt").alias("n_steps"), F.count_if(off > 1800).alias("n_off"), F.round(F.max(off), 4).alias("worst"))


@query(f"WITH {SIG}, g AS (SELECT clip, max(t) / 7200 + 1 AS expected, count(*) AS n FROM sig GROUP BY 1) SELECT clip, n, round(greatest(0.0, 1 - n / expected), 6) AS dropped, 1 - n / expected > 0.005 AS failed FROM g")
def p2_dropped_frames(spark, sf):
    g = sig(spark, sf).groupBy("clip").agg((F.max("t") / 7200 + 1).alias("expected"), F.count("*").alias("n"))
    lost = 1 - F.col("n") / F.col("expected")
    return g.select("clip", "n", F.round(F.greatest(F.lit(0.0), lost), 6).alias("dropped"), (lost > 0.005).alias("failed"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def p3_success_never_closed(spark, sf):
    o = table(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").distinct().join(o.where("o_orderpriority like '1%'").select("o_custkey"), "o_custkey", "left_anti")


@query(f"""WITH {SIG}, m AS (SELECT quantile_cont(width, 0.5) * 0.3 AS th FROM sig) SELECT clip, count(*) FILTER (coalesce(width < th, true)) AS n_soft, count(*) AS n FROM sig, m GROUP BY 1""")
def p4_batch_blur(spark, sf):
    s = sig(spark, sf)
    threshold = s.agg((aggs.pct("width", 0.5) * 0.3).alias("th"))
    return s.crossJoin(F.broadcast(threshold)).groupBy("clip").agg(F.count_if(F.coalesce(F.col("width") < F.col("th"), F.lit(True))).alias("n_soft"), F.count("*").alias("n"))


@query("SELECT event_id, value < 5 AS low_confidence FROM events WHERE value < 5")
def p6_low_confidence(spark, sf):
    return table(spark, sf, "events").where("value < 5").select("event_id", F.lit(True).alias("low_confidence"))


@query("""WITH c AS (SELECT l_suppkey AS demo, l_returnflag AS phase, count(*) AS n, quantile_cont(l_linenumber, 0.5) AS median_position FROM lineitem GROUP BY 1, 2) SELECT demo, phase, n, round(n / sum(n) OVER (PARTITION BY demo), 6) AS share, median_position FROM c""")
def p7_match_provenance(spark, sf):
    from pyspark.sql.window import Window

    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("demo"), F.col("l_returnflag").alias("phase")).agg(F.count("*").alias("n"), aggs.pct("l_linenumber", 0.5).alias("median_position"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("demo")), 6))


@query(f"""WITH {SIG}, r AS (SELECT *, frame - row_number() OVER (PARTITION BY clip, flag ORDER BY frame) AS g FROM sig), l AS (SELECT clip, g, count(*) AS n FROM r WHERE NOT flag GROUP BY 1, 2), b AS (SELECT clip, max(n) AS longest FROM l GROUP BY 1)
    SELECT s.clip, round(avg(flag::int), 6) AS visible, coalesce(any_value(longest), 0) AS longest_blind FROM sig s LEFT JOIN b ON b.clip = s.clip GROUP BY 1""")
def p8_marker_visibility(spark, sf):
    from pyspark.sql.window import Window

    s = sig(spark, sf)
    runs = s.withColumn("g", F.col("frame") - F.row_number().over(Window.partitionBy("clip", "flag").orderBy("frame")))
    longest = runs.where(~F.col("flag")).groupBy("clip", "g").agg(F.count("*").alias("n")).groupBy("clip").agg(F.max("n").alias("longest"))
    return s.groupBy("clip").agg(F.round(F.avg(F.col("flag").cast("int")), 6).alias("visible")).join(longest, "clip", "left").select("clip", "visible", F.coalesce("longest", F.lit(0)).alias("longest_blind"))
