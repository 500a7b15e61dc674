"""Queries of pose arithmetic and the solvers."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlake.functions.pose import POSE, add, cols, conj, lits, qmul, rotate, scale
from trajlake.operators import aggs, project, solve
from trajlake.plans.bindings import SIG, TRAJ, sig, table, traj
from trajlake.plans.registry import query
from trajlake.plans.sequences import rounded, rounded_pose


def rot(q: tuple[str, str, str, str], v: tuple[str, str, str]) -> tuple[str, str, str]:
    """SQL of a vector rotated by a unit quaternion, through its matrix."""
    w, x, y, z = q
    m = [[f"(1 - 2 * ({y} * {y} + {z} * {z}))", f"(2 * ({x} * {y} - {w} * {z}))", f"(2 * ({x} * {z} + {w} * {y}))"], [f"(2 * ({x} * {y} + {w} * {z}))", f"(1 - 2 * ({x} * {x} + {z} * {z}))", f"(2 * ({y} * {z} - {w} * {x}))"], [f"(2 * ({x} * {z} - {w} * {y}))", f"(2 * ({y} * {z} + {w} * {x}))", f"(1 - 2 * ({x} * {x} + {y} * {y}))"]]
    return tuple(f"({' + '.join(f'{a} * {b}' for a, b in zip(row, v, strict=True))})" for row in m)


def mul(a, b) -> tuple[str, ...]:
    (p, q, r, s), (w, x, y, z) = a, b
    return (f"({p}*{w} - {q}*{x} - {r}*{y} - {s}*{z})", f"({p}*{x} + {q}*{w} + {r}*{z} - {s}*{y})", f"({p}*{y} - {q}*{z} + {r}*{w} + {s}*{x})", f"({p}*{z} + {q}*{y} - {r}*{x} + {s}*{w})")


def r(exprs, names, places: int = 5) -> str:
    return ", ".join(f"round({e}, {places}) + 0.0 AS {n}" for e, n in zip(exprs, names, strict=True))


def rq(q, names=POSE[3:]) -> str:
    return ", ".join(f"round(CASE WHEN {q[0]} < 0 THEN -{e} ELSE {e} END, 5) + 0.0 AS {n}" for e, n in zip(q, names, strict=True))


_Q, _T, _O = ("qw", "qx", "qy", "qz"), ("tx", "ty", "tz"), ("ox", "oy", "oz")
_QC = ("qw", "(-qx)", "(-qy)", "(-qz)")


@query(f"WITH {TRAJ} SELECT clip, frame, {r([f'{a} + {t}' for a, t in zip(rot(_Q, _O), _T, strict=True)], ('wx', 'wy', 'wz'))} FROM traj")
def b5_to_world(spark, sf):
    t = traj(spark, sf)
    points = t.select("clip", "frame", *[F.col(o).alias(c) for o, c in zip(_O, "xyz", strict=True)])
    return rounded(project.to_world(points, t, ["clip", "frame"]).select("clip", "frame", "wx", "wy", "wz"), ["wx", "wy", "wz"], 5)


@query(f"WITH {TRAJ} SELECT clip, frame, round(500 * ox / (oz + 2) + 320, 5) AS u, round(500 * oy / (oz + 2) + 240, 5) AS v, round(oz + 2, 5) AS depth FROM traj")
def b6_project(spark, sf):
    t = traj(spark, sf).withColumn("oz", F.col("oz") + 2)
    out = project.project_points(t, *lits(500, 500, 320, 240), xyz=_O)
    return rounded(out.select("clip", "frame", "u", "v", "depth"), ["u", "v", "depth"], 5)


@query(f"WITH {TRAJ} SELECT clip, frame, round((frame * 8 - 320) / 500.0 * oz, 6) + 0.0 AS x, round((frame * 6 - 240) / 500.0 * oz, 6) + 0.0 AS y, round(oz, 6) AS z FROM traj WHERE oz > 1e-4")
def b7_backproject(spark, sf):
    t = traj(spark, sf).withColumns({"u": F.col("frame") * 8, "v": F.col("frame") * 6})
    return rounded(project.backproject(t, *lits(500, 500, 320, 240), depth="oz").select("clip", "frame", "x", "y", "z"), ["x", "y", "z"])


_JOINTS = [[f"j{k}{c}" for c in "xyz"] for k in range(5)]


def _hand(spark, sf):
    e = table(spark, sf, "embeddings")
    floats = [F.get("embedding", F.lit(10 + i)).cast("double").alias(n) for i, n in enumerate(n for j in _JOINTS for n in j)]
    return project.hand_features(e.select("vec_id", (F.col("vec_id") % 7 != 0).alias("valid"), *floats), *_JOINTS)


_JF = ", ".join(f"CAST(embedding[{11 + i}] AS DOUBLE) AS {n}" for i, n in enumerate(n for j in _JOINTS for n in j))


def _u(p: str) -> str:
    return f"sqrt({p}x * {p}x + {p}y * {p}y + {p}z * {p}z)"


_FEAT = f"""jt AS (SELECT vec_id, vec_id % 7 <> 0 AS valid, {_JF} FROM embeddings),
    f1 AS (SELECT *, {", ".join(f"(j0{c} + j1{c}) / 2 AS c{c}, j0{c} - j1{c} AS d{c}, (j0{c} + j1{c}) / 2 - (j2{c} + j3{c} + j4{c}) / 3 AS e{c}, j2{c} - j4{c} AS g{c}, j3{c} - j4{c} AS h{c}" for c in "xyz")} FROM jt),
    f2 AS (SELECT *, gy * hz - gz * hy AS mx, gz * hx - gx * hz AS my, gx * hy - gy * hx AS mz FROM f1),
    feat AS (SELECT vec_id, valid, {_u("d")} AS grasp_width, cx, cy, cz, {", ".join(f"d{c} / {_u('d')} AS k{c}, e{c} / {_u('e')} AS a{c}, m{c} / {_u('m')} AS n{c}" for c in "xyz")} FROM f2)"""


@query(f"WITH {_FEAT} SELECT vec_id, {r(['grasp_width', *[p + c for p in 'ckan' for c in 'xyz']], ['grasp_width', *[p + c for p in 'ckan' for c in 'xyz']])} FROM feat")
def b8_hand_features(spark, sf):
    names = ["grasp_width", *[p + c for p in "ckan" for c in "xyz"]]
    return rounded(_hand(spark, sf).select("vec_id", *names), names, 5)


_EE = f"""{_FEAT}, x1 AS (SELECT *, {", ".join(f"k{c} - a{c} * (kx * ax + ky * ay + kz * az) AS f{c}" for c in "xyz")} FROM feat),
    x2 AS (SELECT *, {", ".join(f"f{c} / {_u('f')} AS x{c}" for c in "xyz")} FROM x1), x3 AS (SELECT *, ay * xz - az * xy AS yx, az * xx - ax * xz AS yy, ax * xy - ay * xx AS yz FROM x2),
    ee AS (SELECT vec_id, valid, cx - ax * 0.02 AS tx, cy - ay * 0.02 AS ty, cz - az * 0.02 AS tz, xx, xy, xz, yx, yy, yz, ax, ay, az FROM x3)"""


@query(f"""WITH {_EE} SELECT vec_id, {", ".join(f"CASE WHEN valid THEN round({c}, 5) + 0.0 END AS {c}" for c in _T)}, {", ".join(f"CASE WHEN valid THEN round({c}, 4) + 0.0 END AS {c}" for c in ("xx", "xy", "xz", "ax", "ay", "az"))} FROM ee""")
def b9_ee_pose(spark, sf):
    ee = project.ee_pose(_hand(spark, sf)).select("vec_id", *POSE)
    x, z = (rotate(cols(*_Q), lits(*v)) for v in ((1, 0, 0), (0, 0, 1)))
    out = ee.select("vec_id", *_T, *[c.alias(n) for c, n in zip((*x, *z), ("xx", "xy", "xz", "ax", "ay", "az"), strict=True)])
    return rounded(rounded(out, _T, 5), ["xx", "xy", "xz", "ax", "ay", "az"], 4)


_OFF = project.rpy_quaternion(10.0, -20.0, 30.0)
_WQ = mul(_Q, [repr(x) for x in _OFF])
_WT = [f"({t} + {a})" for t, a in zip(_T, rot(_Q, ("0.01", "-0.05", "0.03")), strict=True)]


@query(f"""WITH {TRAJ}, w AS (SELECT clip, frame, {", ".join(f"{e} AS w_{n}" for e, n in zip([*_WT, *_WQ], POSE, strict=True))} FROM traj)
    SELECT clip, frame, {r([f"w_{c}" for c in _T], [f"w_{c}" for c in _T])}, {rq([f"w_{c}" for c in _Q], [f"w_{c}" for c in _Q])}, {r([f"-{x}" for x in rot(("w_qw", "(-w_qx)", "(-w_qy)", "(-w_qz)"), ("w_tx", "w_ty", "w_tz"))], [f"v_{c}" for c in _T])} FROM w""")
def b10_wrist_pose(spark, sf):
    out = project.wrist_pose(traj(spark, sf), (0.01, -0.05, 0.03), (10.0, -20.0, 30.0))
    names = [*[f"w_{c}" for c in POSE], *[f"v_{c}" for c in _T]]
    return rounded(out.select("clip", "frame", *names), names, 5)


_S3 = (1.7, (0.5, -0.5, 0.5, 0.5), (0.3, -0.2, 0.9))
_S3Q = [repr(x) for x in _S3[1]]


@query(f"WITH {TRAJ} SELECT clip, frame, {r([f'1.7 * {a} + ({b})' for a, b in zip(rot(_S3Q, _T), _S3[2], strict=True)], _T)}, {rq(mul(_S3Q, _Q))} FROM traj")
def b11_apply_sim3(spark, sf):
    out = project.apply_sim3(traj(spark, sf), F.lit(_S3[0]), lits(*_S3[1]), lits(*_S3[2]))
    return rounded(out.select("clip", "frame", *POSE), POSE, 5)


@query(f"""WITH {SIG}, h AS (SELECT *, quantile_cont(CASE WHEN flag THEN width END, 0.5) OVER (PARTITION BY clip) AS h FROM sig), c AS (SELECT clip, frame, CASE WHEN flag THEN h ELSE width END AS v FROM h)
    SELECT clip, frame, round(CASE WHEN v IS NOT NULL THEN least(120.0, greatest(5.0, v)) END, 6) AS width FROM c""")
def b12_clamp_and_hold(spark, sf):
    return rounded(project.clamp_and_hold(sig(spark, sf), 5.0, 120.0, ["clip"], closed="flag").select("clip", "frame", "width"), ["width"])


@query(f"WITH {TRAJ} SELECT clip, frame, {r([f'{c} * CASE WHEN vec_id % 3 > 0 THEN 900.0 / (vec_id % 3 * 500) ELSE 1 END' for c in _T], _T)} FROM traj")
def b13_rescale_translation(spark, sf):
    t = traj(spark, sf)
    return rounded(project.rescale_translation(t, F.lit(900.0), (F.col("vec_id") % 3 * 500).cast("double")).select("clip", "frame", *_T), _T, 5)


@query("""WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: x::double - list_avg(list_transform(embedding, lambda y: y::double))) AS v FROM embeddings)
    SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first_one, round(v[64] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last_one FROM m""")
def b15_normalise_descriptor(spark, sf):
    out = project.normalise_descriptor(table(spark, sf, "embeddings"), "embedding")
    return rounded(out.select("vec_id", F.element_at("vec", 1).alias("first_one"), F.element_at("vec", -1).alias("last_one")), ["first_one", "last_one"])


@query(f"WITH {TRAJ} SELECT clip, frame, {r([f'-{x}' for x in rot(_QC, _T)], _T)}, {rq(_QC)} FROM traj")
def b16_invert_model_pose(spark, sf):
    return rounded(project.invert_model_pose(traj(spark, sf)).select("clip", "frame", *POSE), POSE, 5)


def _moved(spark, sf):
    """Trajectories beside themselves through a known similarity."""
    return project.apply_sim3(traj(spark, sf), F.lit(_S3[0]), lits(*_S3[1]), lits(*_S3[2]))


@query(f"WITH {TRAJ} SELECT clip, count(*) AS n, 1.7::double AS s, {', '.join(f'{v}::double AS {c}' for v, c in zip((*_S3[2], *_S3[1]), POSE, strict=True))}, 0.0::double AS rmse FROM traj WHERE clip IN (SELECT clip FROM traj GROUP BY 1 HAVING count(*) >= 3) GROUP BY 1")
def e11_fit_sim3(spark, sf):
    t = traj(spark, sf).select("clip", "frame", *[F.col(c).alias(n) for c, n in zip(_T, "xyz", strict=True)])
    m = _moved(spark, sf).select("clip", "frame", *[F.col(c).alias(n) for c, n in zip(_T, "uvw", strict=True)])
    out = solve.fit_sim3(t.join(m, ["clip", "frame"]), ["clip"]).select("clip", "n", "s", *POSE, "rmse")
    return rounded(out, out.columns[2:], 5)


_R9 = dict(zip([f"r{i}{j}" for i in range(3) for j in range(3)], ["1 - 2 * (qy * qy + qz * qz)", "2 * (qx * qy - qw * qz)", "2 * (qx * qz + qw * qy)", "2 * (qx * qy + qw * qz)", "1 - 2 * (qx * qx + qz * qz)", "2 * (qy * qz - qw * qx)", "2 * (qx * qz - qw * qy)", "2 * (qy * qz + qw * qx)", "1 - 2 * (qx * qx + qy * qy)"], strict=True))
#: The symmetric 4 x 4 matrix whose largest eigenvector is the mean rotation, moved up so that no eigenvalue is negative.
_K4 = {"00": "r00 + r11 + r22 + 4", "01": "r21 - r12", "02": "r02 - r20", "03": "r10 - r01", "11": "r00 - r11 - r22 + 4", "12": "r10 + r01", "13": "r02 + r20", "22": "r11 - r00 - r22 + 4", "23": "r21 + r12", "33": "r22 - r00 - r11 + 4"}


def _at(i: int, j: int) -> str:
    return f"k{min(i, j)}{max(i, j)}"


_SQUARE = {ij: " + ".join(f"{_at(int(ij[0]), m)} * {_at(m, int(ij[1]))}" for m in range(4)) for ij in _K4}
_TRACE = " + ".join(f"({_SQUARE[f'{i}{i}']})" for i in range(4))


@query(f"""WITH RECURSIVE {TRAJ}, v AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS k, count(*) OVER (PARTITION BY clip) AS m FROM traj WHERE valid),
    p AS (SELECT DISTINCT clip, (u * (m - 1)) // 39 AS k FROM (SELECT DISTINCT clip, m FROM v WHERE m > 40), generate_series(0, 39) g(u)), d AS (SELECT * FROM v WHERE m <= 40 UNION ALL SELECT v.* FROM v JOIN p USING (clip, k)),
    a AS (SELECT clip, count(*) AS n, {", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in _T)}, {", ".join(f"avg({e}) AS {c}" for c, e in _R9.items())} FROM d GROUP BY 1 HAVING count(*) >= 3),
    s AS (SELECT clip, 0 AS step, {", ".join(f"({e}) / 10 AS k{ij}" for ij, e in _K4.items())} FROM a UNION ALL SELECT clip, step + 1, {", ".join(f"({e}) / ({_TRACE})" for e in _SQUARE.values())} FROM s WHERE step < 30),
    e AS (SELECT clip, CASE WHEN k00 >= greatest(k11, k22, k33) THEN [k00, k01, k02, k03] WHEN k11 >= greatest(k22, k33) THEN [k01, k11, k12, k13] WHEN k22 >= k33 THEN [k02, k12, k22, k23] ELSE [k03, k13, k23, k33] END AS q FROM s WHERE step = 30),
    f AS (SELECT clip, list_transform(q, lambda x: x / sqrt(list_sum(list_transform(q, lambda y: y * y))) * CASE WHEN q[1] < 0 THEN -1 ELSE 1 END) AS q FROM e)
    SELECT a.clip, n, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _T)}, {", ".join(f"round(q[{i + 1}], 5) + 0.0 AS {c}" for i, c in enumerate(_Q))} FROM a JOIN f USING (clip)""")
def e13_reference_pose(spark, sf):
    return rounded_pose(solve.reference_pose(traj(spark, sf).where("valid"), ["clip"], "frame").select("clip", "n", *POSE))


_ANG = "degrees(2 * acos(least(1.0, abs(qw * 0.9 + qx * 0.1 + qy * 0.3 + qz * 0.3) / 1.0)))"


@query(f"""WITH {TRAJ}, e AS (SELECT clip, sqrt((tx - ox) ^ 2 + (ty - oy) ^ 2 + (tz - oz) ^ 2) * 100 AS cm, {_ANG} AS deg, ox, oy, oz FROM traj WHERE valid), n AS (SELECT clip, count(*) AS n_valid FROM traj GROUP BY 1)
    SELECT clip, {", ".join(f"round(quantile_cont({c}, 0.5), 4) AS {p}_median, round(quantile_cont({c}, 0.9), 4) AS {p}_p90, round(max({c}), 4) AS {p}_max" for p, c in (("position_cm", "cm"), ("rotation_deg", "deg")))},
        count(*) AS n, round(sqrt(stddev_pop(ox) ^ 2 + stddev_pop(oy) ^ 2 + stddev_pop(oz) ^ 2), 4) AS spread, round(count(*) / any_value(n_valid), 4) AS coverage, 'scan' AS label FROM e JOIN n USING (clip) GROUP BY 1""")
def e14_marker_agreement(spark, sf):
    t = traj(spark, sf)
    obs = t.where("valid").select("clip", *[F.col(c).alias(f"i_{c}") for c in POSE], *[F.col(o).alias(f"a_{c}") for o, c in zip(_O, _T, strict=True)], *[v.alias(f"a_{c}") for v, c in zip(lits(0.9, 0.1, 0.3, 0.3), _Q, strict=True)], *[F.col(o).alias(f"m_{c}") for o, c in zip(_O, "xyz", strict=True)])
    out = aggs.marker_agreement(obs, ["clip"], t.groupBy("clip").agg(F.count("*").alias("n_valid")))
    return rounded(out, [c for c in out.columns if c not in ("clip", "n", "label")], 4)


@query(f"""WITH {TRAJ}, n AS (SELECT clip, count(*) AS n FROM traj GROUP BY 1), m AS (SELECT e.*, greatest(0, least(n - 1, floor(round(frame / 30.0 * 20.0, 9) + 0.5)::bigint)) AS i FROM traj e JOIN n USING (clip) WHERE valid),
    j AS (SELECT m.clip, sqrt((m.tx - t.tx) ^ 2 + (m.ty - t.ty) ^ 2 + (m.tz - t.tz) ^ 2) * 100 AS p, degrees(2 * acos(least(1.0, abs(m.qw * t.qw + m.qx * t.qx + m.qy * t.qy + m.qz * t.qz)))) AS a, abs(m.ox - t.ox) AS w, ((m.oy > 0) = (t.oy > 0))::int::double AS g FROM m JOIN traj t ON t.clip = m.clip AND t.frame = i),
    u AS (SELECT clip, 'camera_position' AS metric, 'cm' AS unit, p AS e FROM j UNION ALL SELECT clip, 'camera_rotation', 'deg', a FROM j UNION ALL SELECT clip, 'grasp_width', 'm', w FROM j UNION ALL SELECT clip, 'grasp_state', 'agree', g FROM j)
    SELECT clip, metric, unit, round(quantile_cont(e, 0.5), 3) AS median, round(quantile_cont(e, 0.9), 3) AS p90, round(max(e), 3) AS worst, count(*) AS n, 'estimated' AS source FROM u GROUP BY 1, 2, 3""")
def e29_score_episodes(spark, sf):
    t = traj(spark, sf).withColumns({"width": F.col("ox"), "closed": F.col("oy") > 0})
    return rounded(aggs.score_episodes(t, t, ["clip"], "frame", 30.0, 20.0), ["median", "p90", "worst"], 3)


def _projections(spark, sf):
    """Each point of a clip seen by the poses of the frames around its own, with exact pixels."""
    t = traj(spark, sf)
    cams = t.select("clip", F.col("frame").alias("cam"), *POSE)
    back = scale(rotate(conj(cols(*_Q)), cols(*_T)), -1.0)
    axes = [rotate(conj(cols(*_Q)), lits(*v)) for v in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]
    p = {f"p{i}{j}": axes[j][i] if j < 3 else back[i] for i in range(3) for j in range(4)}
    cams = cams.withColumns(p)
    around = F.explode(F.sequence(F.col("frame") - 12, F.col("frame") + 12)).alias("cam")
    pts = t.select("clip", "vec_id", around, *[F.col(o).alias(c) for o, c in zip(_O, "xyz", strict=True)])
    v = pts.join(cams, ["clip", "cam"])
    x = [F.col(f"p{i}0") * F.col("x") + F.col(f"p{i}1") * F.col("y") + F.col(f"p{i}2") * F.col("z") + F.col(f"p{i}3") for i in range(3)]
    return v.withColumns({"u": x[0] / x[2], "v": x[1] / x[2]}).where(F.abs(x[2]) > 0.05)


@query(f"WITH {TRAJ} SELECT clip, vec_id, round(ox, 4) + 0.0 AS x, round(oy, 4) + 0.0 AS y, round(oz, 4) + 0.0 AS z FROM traj")
def i1_triangulate(spark, sf):
    out = solve.triangulate(_projections(spark, sf), ["clip", "vec_id"], [f"p{i}{j}" for i in range(3) for j in range(4)])
    return rounded(out.select("clip", "vec_id", "x", "y", "z"), ["x", "y", "z"], 4)


def _model(spark, sf):
    return traj(spark, sf).select("clip", F.col("vec_id").alias("point_id"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))


@query("""WITH m AS (SELECT label AS clip, count(*) AS n FROM embeddings GROUP BY 1) SELECT clip, f AS frame, round(0.1 * f, 3) AS tx, round(0.2 * f, 3) AS ty, round(0.3 * f, 3) AS tz,
    0.999 AS qw, 0.03 AS qx, 0.02 AS qy, 0.035 AS qz, 0.0 AS rmse, greatest(4.0, floor(n * 0.8)) AS n FROM m, (SELECT unnest([0, 1])::int AS f) WHERE n >= 4""")
def i2_register_frames(spark, sf):
    """Clouds that are the model, turned a little and moved: the fit must give that motion back."""
    model = _model(spark, sf)
    q = lits(0.99875, 0.03, 0.02, 0.035)
    frames = model.withColumn("frame", F.explode(F.array(F.lit(0), F.lit(1))))
    moved = add(rotate(q, cols("x", "y", "z")), tuple(F.col("frame") * c for c in (0.1, 0.2, 0.3)))
    clouds = frames.withColumns(dict(zip("xyz", moved, strict=True)))
    return rounded(solve.register_frames(model, clouds, ["clip"], "frame", most=None), [*POSE, "rmse"], 3)


_TURN = 5


@query(f"""WITH m AS (SELECT label AS clip, count(*) AS n FROM embeddings GROUP BY 1) SELECT clip, f AS frame, round(0.01 * f, 3) AS tx, round(-0.02 * f, 3) + 0.0 AS ty, 0.0 AS tz,
    round(cos(radians({_TURN} / 2.0 * f)), 3) AS qw, 0.0 AS qx, 0.0 AS qy, round(sin(radians({_TURN} / 2.0 * f)), 3) AS qz, 0.0 AS rmse, greatest(4.0, floor(n * 0.8)) AS n FROM m, (SELECT unnest(generate_series(0, 24))::int AS f) WHERE n >= 4""")
def i2_register_chained(spark, sf):
    """The model turns by 120 degrees over 25 frames: each frame starts from the one before."""
    model = _model(spark, sf)
    frames = model.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(24))))
    half = F.radians(F.col("frame") * (_TURN / 2.0))
    moved = add(rotate((F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half)), cols("x", "y", "z")), (F.col("frame") * 0.01, F.col("frame") * -0.02, F.lit(0.0)))
    clouds = frames.withColumns(dict(zip("xyz", moved, strict=True)))
    return rounded(solve.register_frames(model, clouds, ["clip"], "frame", most=None, chain=True), [*POSE, "rmse"], 3)


@query(f"WITH {TRAJ} SELECT clip, frame, {r(_T, _T, 6)}, {rq(_Q)} FROM traj")
def b11_round_trip(spark, sf):
    """A similarity and its inverse: how far each pose comes back off."""
    out = _moved(spark, sf)
    q = lits(*_S3[1])
    back = scale(rotate(conj(q), tuple(F.col(c) - v for c, v in zip(_T, _S3[2], strict=True))), 1 / _S3[0])
    return rounded_pose(out.select("clip", "frame", *[b.alias(c) for b, c in zip((*back, *qmul(conj(q), cols(*_Q))), POSE, strict=True)]))
