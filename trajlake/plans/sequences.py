"""Queries of the sequence, sampling and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlake.functions.pose import POSE, cols, upright
from trajlake.operators import aggs, joins, sample, seq
from trajlake.plans.bindings import SIG, TRAJ, sig, table, traj
from trajlake.plans.registry import query

_BEFORE = "OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_AFTER = "OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_SCHMITT = f"coalesce(last_value(CASE WHEN width < 20 THEN true WHEN width > 60 THEN false END IGNORE NULLS) {_BEFORE}, false)"
_RUNS = f"""sch AS (SELECT *, {_SCHMITT} AS c FROM sig),
    ch AS (SELECT *, sum(ch) {_BEFORE} AS run FROM (SELECT *, coalesce((c <> lag(c) OVER (PARTITION BY clip ORDER BY frame))::int, 0) AS ch FROM sch)),
    ln AS (SELECT *, count(*) OVER (PARTITION BY clip, run) AS len, max(run) OVER (PARTITION BY clip) AS last_run FROM ch),
    ab AS (SELECT *, last_value(CASE WHEN run = 0 OR run = last_run OR len >= 3 THEN c END IGNORE NULLS) {_BEFORE} AS closed FROM ln)"""
#: Rounded pose columns of SQL, the quaternion with w >= 0.
RQ = ", ".join(f"round(CASE WHEN qw < 0 THEN -{c} ELSE {c} END, 5) + 0.0 AS {c}" for c in POSE[3:])
RT = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in POSE[:3])


def rounded(df, names, places: int = 6):
    return df.withColumns({n: F.round(n, places) + F.lit(0.0) for n in names})


def rounded_pose(df):
    df = df.withColumns(dict(zip(POSE[3:], upright(cols(*POSE[3:])), strict=True)))
    return rounded(rounded(df, POSE[:3]), POSE[3:], 5)


@query(f"WITH {SIG} SELECT clip, frame, {_SCHMITT} AS closed FROM sig")
def f5_schmitt(spark, sf):
    return seq.schmitt(sig(spark, sf), "width", 20.0, 60.0, ["clip"], "frame").select("clip", "frame", "closed")


@query(f"WITH {SIG}, {_RUNS} SELECT clip, frame, closed FROM ab")
def f6_absorb_short_runs(spark, sf):
    return seq.absorb_short_runs(seq.schmitt(sig(spark, sf), "width", 20.0, 60.0, ["clip"], "frame"), "closed", 3, ["clip"], "frame").select("clip", "frame", "closed")


@query(f"""WITH {SIG}, t AS (SELECT clip, quantile_cont(width, 0.15) AS lo, quantile_cont(width, 0.85) AS hi, count(width) AS n FROM sig GROUP BY 1)
    SELECT clip, round(CASE WHEN n >= 10 AND hi - lo > 60 THEN lo + 0.35 * (hi - lo) ELSE 20.0 END, 6) AS close_at,
        round(CASE WHEN n >= 10 AND hi - lo > 60 THEN lo + 0.65 * (hi - lo) ELSE 60.0 END, 6) AS open_at,
        CASE WHEN n >= 10 AND hi - lo > 60 THEN 'adaptive' ELSE 'config' END AS threshold_source FROM t""")
def f7_adaptive_thresholds(spark, sf):
    out = seq.adaptive_thresholds(sig(spark, sf), "width", ["clip"], 20.0, 60.0, 60.0)
    return rounded(out.select("clip", "close_at", "open_at", "threshold_source").distinct(), ["close_at", "open_at"])


@query(f"""WITH {SIG}, b AS (SELECT *, last_value(width IGNORE NULLS) {_BEFORE} AS v0, first_value(width IGNORE NULLS) {_AFTER} AS v1,
        last_value(CASE WHEN width IS NOT NULL THEN t END IGNORE NULLS) {_BEFORE} AS t0, first_value(CASE WHEN width IS NOT NULL THEN t END IGNORE NULLS) {_AFTER} AS t1 FROM sig)
    SELECT clip, frame, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0 END END, 6) AS width FROM b""")
def f2_fill_gaps(spark, sf):
    return rounded(seq.fill_gaps(sig(spark, sf), "width", ["clip"], "t").select("clip", "frame", "width"), ["width"])


def _slerp_sql(a: str, b: str, u: str, source: str) -> str:
    """SELECT of the columns of ``source`` with qw..qz between a_q* and b_q* at ``u``."""
    d = " + ".join(f"{a}_{c} * {b}_{c}" for c in POSE[3:])
    mix = ", ".join(f"({a}_{c} * wa + {b}_{c} * sg * wb) AS m_{c}" for c in POSE[3:])
    n = "sqrt(" + " + ".join(f"m_{c} * m_{c}" for c in POSE[3:]) + ")"
    return f"""SELECT *, {", ".join(f"m_{c} / {n} AS {c}" for c in POSE[3:])} FROM (SELECT *, {mix} FROM (SELECT *,
        CASE WHEN cc > 0.9995 THEN 1 - uu ELSE sin((1 - uu) * acos(cc)) / sin(acos(cc)) END AS wa, CASE WHEN cc > 0.9995 THEN uu ELSE sin(uu * acos(cc)) / sin(acos(cc)) END AS wb
        FROM (SELECT *, {u} AS uu, least(abs({d}), 1.0) AS cc, CASE WHEN {d} < 0 THEN -1 ELSE 1 END AS sg FROM {source})))"""


_AB = ", ".join(f"coalesce(a.{c}, b.{c}) AS a_{c}, coalesce(b.{c}, a.{c}) AS b_{c}" for c in (*POSE, "at"))
_BR = f"""br AS (SELECT clip, frame, valid, {_AB} FROM (SELECT *, last_value(p IGNORE NULLS) {_BEFORE} AS a, first_value(p IGNORE NULLS) {_AFTER} AS b
    FROM (SELECT *, CASE WHEN valid THEN {{{", ".join(f"'{c}': {c}" for c in POSE)}, 'at': frame}} END AS p FROM traj)))"""
_LT = ", ".join(f"a_{c} + (b_{c} - a_{c}) * uu AS {c}" for c in POSE[:3])


@query(f"""WITH {TRAJ}, {_BR}, s AS ({_slerp_sql("a", "b", "CASE WHEN b_at > a_at THEN (frame - a_at) / (b_at - a_at) ELSE 0.0 END", "br")})
    SELECT clip, frame, {RT}, {RQ} FROM (SELECT clip, frame, {_LT}, {", ".join(POSE[3:])} FROM s)""")
def f1_fill_pose_gaps(spark, sf):
    out = seq.fill_pose_gaps(traj(spark, sf), ["clip"], "frame")
    return rounded_pose(out.select("clip", "frame", *POSE))


_H = "OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
_LAGQ = " + ".join(f"{c} * lag({c}) OVER (PARTITION BY clip ORDER BY frame)" for c in POSE[3:])


@query(f"""WITH {TRAJ}, s AS (SELECT *, CASE WHEN sum(fl) {_BEFORE} % 2 = 1 THEN -1 ELSE 1 END AS sg FROM (SELECT *, coalesce(({_LAGQ} < 0)::int, 0) AS fl FROM traj)),
    m AS (SELECT clip, frame, {", ".join(f"avg({c}) {_H} AS {c}" for c in POSE[:3])}, {", ".join(f"avg({c} * sg) {_H} AS m_{c}" for c in POSE[3:])} FROM s)
    SELECT clip, frame, {RT}, {RQ} FROM (SELECT clip, frame, {", ".join(POSE[:3])}, {", ".join(f"m_{c} / sqrt({' + '.join(f'm_{k} * m_{k}' for k in POSE[3:])}) AS {c}" for c in POSE[3:])} FROM m)""")
def f3_smooth_poses(spark, sf):
    return rounded_pose(seq.smooth_poses(traj(spark, sf), 5, ["clip"], "frame").select("clip", "frame", *POSE))


_GRID = """n AS (SELECT clip, count(*) AS n, (count(*) - 1) / 30.0 AS last FROM traj GROUP BY 1),
    grid AS (SELECT clip, n, k, round(least(k / 12.0, last) * 30.0, 9) AS at_ FROM (SELECT *, unnest(generate_series(0, greatest(2, floor(last * 12.0)::bigint + 1) - 1)) AS k FROM n)),
    g AS (SELECT *, least(floor(at_)::bigint, greatest(n - 2, 0)) AS i FROM grid),
    ab AS (SELECT g.clip, k, at_, i, at_ - i AS u, """ + ", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in (*POSE, "ox", "valid")) + " FROM g JOIN traj a ON a.clip = g.clip AND a.frame = i JOIN traj b ON b.clip = g.clip AND b.frame = i + 1)"


@query(f"""WITH {TRAJ}, {_GRID}, s AS ({_slerp_sql("a", "b", "u", "ab")})
    SELECT clip, k, round(k / 12.0, 6) AS t_s, {RT}, {RQ}, round(ox, 6) AS ox, valid FROM (SELECT clip, k, {_LT}, {", ".join(POSE[3:])}, a_ox + (b_ox - a_ox) * uu AS ox,
    CASE WHEN round_even(at_, 0) > i THEN b_valid ELSE a_valid END AS valid FROM s)""")
def f4_resample(spark, sf):
    out = seq.resample(traj(spark, sf), 30.0, 12.0, ["clip"], "frame", width="ox", flag="valid")
    return rounded(rounded_pose(out), ["t_s", "ox"]).select("clip", "k", "t_s", *POSE, "ox", "valid")


_STEP = "sqrt((tx - lag(tx) OVER w) ^ 2 + (ty - lag(ty) OVER w) ^ 2 + (tz - lag(tz) OVER w) ^ 2)"


@query(f"WITH {TRAJ} SELECT clip, frame, round({_STEP}, 6) AS step, round({_STEP} * 30, 5) AS speed FROM traj WINDOW w AS (PARTITION BY clip ORDER BY frame)")
def f11_step_motion(spark, sf):
    out = seq.step_motion(traj(spark, sf), ["clip"], "frame", 30.0)
    return rounded(rounded(out.select("clip", "frame", "step", "speed"), ["step"]), ["speed"], 5)


def _hands(spark, sf):
    return traj(spark, sf).withColumnsRenamed({"tx": "hx", "ty": "hy", "tz": "hz"}).withColumn("hand_valid", F.col("valid")).withColumn("obj_valid", F.col("vec_id") % 5 != 0)


_HANDS = f"""{TRAJ}, hands AS (SELECT clip, frame, vec_id, tx AS hx, ty AS hy, tz AS hz, ox, oy, oz, valid AS hv, vec_id % 5 <> 0 AS ov FROM traj),
    con AS (SELECT *, hv AND ov AND sqrt((hx - ox) ^ 2 + (hy - oy) ^ 2 + (hz - oz) ^ 2) < 0.2 AS contact FROM hands),
    vel AS (SELECT *, {", ".join(f"30 * ({p}{c} - lag({p}{c}) OVER w) AS {p}v{c}" for p in "ho" for c in "xyz")}, coalesce(lag(hv AND ov) OVER w, false) AND hv AND ov AS both_ FROM con WINDOW w AS (PARTITION BY clip ORDER BY frame)),
    cou AS (SELECT *, coalesce(both_ AND sqrt(ovx ^ 2 + ovy ^ 2 + ovz ^ 2) >= 0.02 AND sqrt(hvx ^ 2 + hvy ^ 2 + hvz ^ 2) >= 1e-6
        AND hvx * ovx + hvy * ovy + hvz * ovz > 0.6 * sqrt(ovx ^ 2 + ovy ^ 2 + ovz ^ 2) * sqrt(hvx ^ 2 + hvy ^ 2 + hvz ^ 2), false) AS coupled FROM vel)"""


@query(f"WITH {_HANDS} SELECT clip, frame, coupled FROM cou")
def f8_motion_coupling(spark, sf):
    return seq.motion_coupling(_hands(spark, sf), 30.0, ["clip"], "frame").select("clip", "frame", "coupled")


@query(f"WITH {_HANDS} SELECT clip, frame, contact FROM con")
def f9_contact(spark, sf):
    return seq.contact(_hands(spark, sf), 0.2).select("clip", "frame", "contact")


def _grasp(spark, sf):
    df = seq.motion_coupling(seq.contact(_hands(spark, sf), 0.2), 30.0, ["clip"], "frame")
    return seq.grasp_state(df, "qx", 0.0, 0.3, ["clip"], "frame", least_run=2)


_NARROW = f"coalesce(last_value(CASE WHEN qx < 0.0 THEN true WHEN qx > 0.3 THEN false END IGNORE NULLS) {_BEFORE}, false)"
GRASP = f"""{_HANDS}, nar AS (SELECT cou.*, t.qx, {_NARROW.replace("OVER (PARTITION BY clip ORDER BY frame", "OVER (PARTITION BY cou.clip ORDER BY cou.frame")} AS narrow FROM cou JOIN traj t ON t.vec_id = cou.vec_id),
    raw AS (SELECT *, narrow AND (contact OR coupled) OR coupled AND contact AS c FROM nar),
    ch AS (SELECT *, sum(ch) {_BEFORE} AS run FROM (SELECT *, coalesce((c <> lag(c) OVER (PARTITION BY clip ORDER BY frame))::int, 0) AS ch FROM raw)),
    ln AS (SELECT *, count(*) OVER (PARTITION BY clip, run) AS len, max(run) OVER (PARTITION BY clip) AS last_run FROM ch),
    gr AS (SELECT *, last_value(CASE WHEN run = 0 OR run = last_run OR len >= 2 THEN c END IGNORE NULLS) {_BEFORE} AS closed FROM ln)"""


@query(f"WITH {GRASP} SELECT clip, frame, closed FROM gr")
def f10_grasp_state(spark, sf):
    return _grasp(spark, sf).select("clip", "frame", "closed")


@query(f"""WITH {GRASP}, t AS (SELECT *, CASE WHEN closed <> lag(closed) OVER (PARTITION BY clip ORDER BY frame) THEN frame END AS at_ FROM gr)
    SELECT clip, count(*) FILTER (closed) AS closed_count, round(avg(closed::int), 6) AS closed_fraction, count(at_) AS transitions, min(at_) AS onset,
        CASE WHEN count(at_) > 1 THEN max(at_) END AS release, round(quantile_cont(qx, 0.5), 6) AS median_width, round(quantile_cont(qx, 0.05), 6) AS p5, round(quantile_cont(qx, 0.95), 6) AS p95 FROM t GROUP BY 1""")
def e17_grasp_summary(spark, sf):
    out = aggs.grasp_summary(_grasp(spark, sf), ["clip"], "frame", "qx")
    out = out.select("clip", "closed_count", "closed_fraction", "transitions", "onset", "release", "median_width", F.get("width_pcts", F.lit(0)).alias("p5"), F.get("width_pcts", F.lit(4)).alias("p95"))
    return rounded(out, ["closed_fraction", "median_width", "p5", "p95"])


@query("SELECT l_orderkey, arg_max(l_linenumber, l_extendedprice * 1000 - l_linenumber) AS l_linenumber, round(max(l_extendedprice), 6) AS l_extendedprice FROM lineitem GROUP BY 1")
def f12_top_detection(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return seq.top_detection(rows, ["l_orderkey"], F.col("l_extendedprice"), "l_linenumber").withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@query("""WITH o AS (SELECT l_suppkey, l_orderkey, l_quantity::double AS x, l_extendedprice::double AS y, l_discount::double AS z FROM lineitem),
    f AS (SELECT * FROM (SELECT *, min(l_orderkey) OVER (PARTITION BY l_suppkey) AS m FROM o) WHERE l_orderkey = m)
    SELECT l_suppkey, l_orderkey, round(x - avg(x) OVER w, 6) AS x, round(y - avg(y) OVER w, 6) AS y, round(z - avg(z) OVER w, 6) AS z, round(avg(y) OVER w, 6) AS cy FROM f WINDOW w AS (PARTITION BY l_suppkey)""")
def f13_canonical_model(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"))
    return rounded(seq.canonical_model(rows, ["l_suppkey"], "l_orderkey").select("l_suppkey", "l_orderkey", "x", "y", "z", "cy"), ["x", "y", "z", "cy"])


@query(f"""WITH {SIG}, r AS (SELECT *, count(*) OVER (PARTITION BY clip) AS m FROM sig), k AS (SELECT DISTINCT clip, (k * (m - 1)) // 11 AS frame FROM (SELECT DISTINCT clip, m FROM r), generate_series(0, 11) g(k) WHERE m > 12)
    SELECT clip, frame FROM r WHERE m <= 12 UNION ALL SELECT clip, frame FROM k""")
def g1_even_sample(spark, sf):
    return sample.even_sample(sig(spark, sf).select("clip", "frame"), 12, ["clip"], "frame")


@query(f"WITH {SIG} SELECT clip, frame FROM (SELECT *, greatest(1, count(*) OVER (PARTITION BY clip) // 10) AS s FROM sig) WHERE frame % s = 0 AND frame < s * 7")
def g2_stride_sample(spark, sf):
    return sample.stride_sample(sig(spark, sf).select("clip", "frame"), 10, ["clip"], "frame", first=7)


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY substr(md5(doc_id || ':42'), 1, 10), doc_id) AS k FROM documents WHERE lang IS NOT NULL) WHERE k <= 100")
def g3_seeded_cap(spark, sf):
    return sample.seeded_cap(table(spark, sf, "documents").select("lang", "doc_id"), 100, 42, ["lang"], "doc_id")


@query(f"WITH {SIG} SELECT clip, frame FROM sig WHERE frame < 12")
def g4_head(spark, sf):
    return sample.head(sig(spark, sf).select("clip", "frame"), 12, ["clip"], "frame")


def _near_pairs(spark, sf):
    return joins.candidate_pairs(traj(spark, sf).select("clip", "frame"), ["clip"], "frame", mode="band", window=2)


def _far_pairs(spark, sf):
    t = traj(spark, sf).select("clip", "frame")
    return t.where("frame % 3 = 0").select("clip", F.col("frame").alias("i"), (F.col("frame") + 1).alias("j")).unionByName(t.where("frame >= 9").select("clip", F.lit(0).cast("bigint").alias("i"), F.col("frame").alias("j")))


_NEAR = "near AS (SELECT a.clip, a.frame AS i, b.frame AS j FROM traj a JOIN traj b ON a.clip = b.clip AND b.frame > a.frame AND b.frame <= a.frame + 2)"
_FAR = "far AS (SELECT clip, frame AS i, frame + 1 AS j FROM traj WHERE frame % 3 = 0 UNION ALL SELECT clip, 0, frame FROM traj WHERE frame >= 9)"


@query(f"WITH {TRAJ}, {_NEAR}, {_FAR} SELECT * FROM near UNION SELECT * FROM far")
def h1_union_pairs(spark, sf):
    return sample.union_pairs(_near_pairs(spark, sf), _far_pairs(spark, sf))


@query("""WITH c AS (SELECT o_orderpriority AS p, l_suppkey AS s, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    b AS (SELECT p, arg_max(s, n * 1000000 - s) AS chosen, list_sort(list(s)) AS seen FROM c GROUP BY 1)
    SELECT p, chosen, len(list_filter(seen, lambda x: x <> chosen)) AS n_ignored, list_sum(list_filter(seen, lambda x: x <> chosen))::bigint AS sum_ignored FROM b""")
def h2_ids_ignored(spark, sf):
    c = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("p"), F.col("l_suppkey").alias("s")).agg(F.count("*").alias("n"))
    b = c.groupBy("p").agg(F.max_by("s", F.col("n") * 1000000 - F.col("s")).alias("chosen"), F.collect_list("s").alias("seen"))
    b = b.withColumn("ignored", sample.ids_ignored(F.col("seen"), F.col("chosen")))
    return b.select("p", "chosen", F.size("ignored").cast("bigint").alias("n_ignored"), F.aggregate("ignored", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_ignored"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def h3_concat_clouds(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    return sample.concat_clouds(*[rows.where(F.col("l_returnflag") == f) for f in "ANR"]).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def h4_distinct_pairs(spark, sf):
    return sample.distinct_pairs(table(spark, sf, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def h5_scored_clips(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return sample.scored_clips(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), orders, ["c_custkey"])


@query("SELECT p_partkey FROM part INTERSECT SELECT l_partkey FROM lineitem")
def h6_usable_frames(spark, sf):
    seen = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return sample.usable_frames(table(spark, sf, "part"), seen, ["p_partkey"])
