"""Window and sequence operators. ``by`` names the sequence, ``order`` its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajlake.functions.pose import POSE, cols, dot, lerp, named, norm, scale, slerp, slerp_weights, sub, unit
from trajlake.operators.scan import STRETCH_ROWS, Scan
from trajlake.operators.select import with_percentiles


def _w(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def schmitt(df: DataFrame, col: str, close: Column | float, open_: Column | float, by: list[str], order: str, out: str = "closed", stretch: int = STRETCH_ROWS) -> DataFrame:
    """Closed below ``close``, open above ``open_``, else as before; a missing value holds; starts open. Needs close <= open."""
    says = F.when(F.col(col) < close, F.lit(True)).when(F.col(col) > open_, F.lit(False))
    scan = Scan(df, by, order, stretch).last(_closed=says)
    closed = F.coalesce("_closed", F.lit(False))
    return scan.add(**{out: closed}).done(*[out] * (out not in df.columns))


def absorb_short_runs(df: DataFrame, col: str, least: int, by: list[str], order: str, stretch: int = STRETCH_ROWS) -> DataFrame:
    """Runs of under ``least`` rows take the value of the last run that stays; the first and last run stay."""
    if least <= 1:
        return df
    # A run's length is the way from its first row to its last one, so that no run's rows have to meet.
    differs = lambda c: F.coalesce(F.col(col) != F.col(c), F.lit(False))
    scan = Scan(df, by, order, stretch).total(_at=F.lit(1)).previous(_before=F.col(col), _had=F.lit(True)).following(_after=F.col(col), _has=F.lit(True))
    scan.last(_first=F.when(F.col("_had").isNull() | differs("_before"), F.col("_at"))).next(_last=F.when(F.col("_has").isNull() | differs("_after"), F.struct("_at", F.col("_has").isNull().alias("end"))))
    stays = (F.col("_first") == 1) | F.col("_last.end") | (F.col("_last._at") - F.col("_first") + 1 >= least)
    return scan.last(_value=F.when(stays, F.col(col))).add(**{col: F.col("_value")}).done()


def adaptive_thresholds(df: DataFrame, col: str, by: list[str], close: float, open_: float, least_range: float, least_rows: int = 10, stretch: int = STRETCH_ROWS) -> DataFrame:
    """``df`` with close_at, open_at, threshold_source: at 35 and 65 % between the 15th and 85th percentile if they are far enough apart."""
    df = with_percentiles(df, by, {"_lo": (F.col(col), 0.15), "_hi": (F.col(col), 0.85)}, stretch).withColumn("_n", F.count(col).over(Window.partitionBy(*by)))
    adapts = (F.col("_n") >= least_rows) & (F.col("_hi") - F.col("_lo") > least_range)
    span = F.col("_hi") - F.col("_lo")
    return df.select(
        *[c for c in df.columns if c not in ("_lo", "_hi", "_n")],
        F.when(adapts, F.col("_lo") + 0.35 * span).otherwise(F.lit(close)).alias("close_at"),
        F.when(adapts, F.col("_lo") + 0.65 * span).otherwise(F.lit(open_)).alias("open_at"),
        F.when(adapts, F.lit("adaptive")).otherwise(F.lit("config")).alias("threshold_source"),
    )


def fill_gaps(df: DataFrame, col: str, by: list[str], order: str, stretch: int = STRETCH_ROWS) -> DataFrame:
    """Missing values by linear interpolation in ``order`` between their neighbours; edges hold."""
    own = F.when(F.col(col).isNotNull(), F.struct(F.col(col).alias("v"), F.col(order).alias("t")))
    scan = Scan(df, by, order, stretch).last(_a=own).next(_b=own)
    v0, v1, t0, t1 = F.col("_a.v"), F.col("_b.v"), F.col("_a.t"), F.col("_b.t")
    u = F.when(t1 > t0, (F.col(order) - t0) / (t1 - t0)).otherwise(F.lit(0.0))
    value = F.when(v0.isNull(), v1).when(v1.isNull(), v0).otherwise(v0 + (v1 - v0) * u)
    return scan.add(**{col: value}).done()


def fill_pose_gaps(df: DataFrame, by: list[str], order: str, valid: str = "valid", stretch: int = STRETCH_ROWS) -> DataFrame:
    """Poses of invalid rows between their valid neighbours: slerp and lerp; edges hold the nearest; none valid gives NULL."""
    own = F.when(F.col(valid), F.struct(*[F.col(p).alias(p) for p in POSE], F.col(order).alias("at")))
    scan = Scan(df, by, order, stretch).last(_a=own).next(_b=own)
    scan.add(_a=F.coalesce("_a", "_b"), _b=F.coalesce("_b", "_a"))
    a, b = ([F.col(f"{s}.{p}") for p in POSE] for s in ("_a", "_b"))
    span = F.col("_b.at") - F.col("_a.at")
    # Each step a column of its own, so that no expression holds the steps before it several times.
    scan.add(_u=F.when(span > 0, (F.col(order) - F.col("_a.at")) / span).otherwise(F.lit(0.0)), _d=dot(a[3:], b[3:]))
    scan.add(**dict(zip(("_wa", "_wb"), slerp_weights(F.col("_d"), F.col("_u")), strict=True)))
    scan.add(**{f"_{p}": x * F.col("_wa") + y * F.col("_wb") for p, x, y in zip(POSE[3:], a[3:], b[3:], strict=True)})
    q = unit(tuple(F.col(f"_{p}") for p in POSE[3:]), least=0.0)
    inside = F.col(valid) | (span <= 0)
    values = [F.when(inside, x).otherwise(y) for x, y in zip(a, [*lerp(a[:3], b[:3], F.col("_u")), *q], strict=True)]
    return scan.add(**dict(zip(POSE, values, strict=True))).done()


def smooth_poses(df: DataFrame, window: int, by: list[str], order: str, stretch: int = STRETCH_ROWS) -> DataFrame:
    """Centred mean of positions and of sign-aligned quaternions, renormalised; the window is made odd after it is cut to the length.

    Means are differences of running sums, so a row costs the same at any width. Missing values, NaN too, don't count.
    """
    if window <= 1:
        return df
    q = ("qw", "qx", "qy", "qz")
    own = Scan(df, by, order, stretch).previous(**{f"_l{c}": F.col(c) for c in q}).total(_k=F.lit(1))
    flips = F.coalesce((dot(cols(*q), cols(*[f"_l{c}" for c in q])) < 0).cast("int"), F.lit(0))
    own.total(_flips=flips).add(_s=F.when(F.col("_flips") % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0)))
    values = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) * (F.col("_s") if c in q else 1.0) for c in ("tx", "ty", "tz", *q)}
    own.add(**{f"_x{c}": v for c, v in values.items()}).total(**{f"_t{c}": F.col(f"_x{c}") for c in values}, **{f"_c{c}": F.col(f"_x{c}").isNotNull().cast("bigint") for c in values})
    n = own.df.groupBy(*by).agg(F.count("*").alias("_n")) if own.cut else None
    rows = own._with(own.df, n) if own.cut and len(n.limit(20_001).take(20_001)) <= 20_000 else own.df.join(n, by) if own.cut else own.df.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    sizes = F.least(F.lit(window), F.col("_n"))
    width = F.when(sizes % 2 == 1, sizes).when(F.col("_n") >= window, F.lit(window + 1 - window % 2)).otherwise(sizes - 1)
    half = (width - 1) / 2
    # Sums up to the last row of the window and up to the one before its first, found at their own positions.
    sums = F.struct(*[F.col(f"_{x}{c}").alias(f"{x}{c}") for c in values for x in "tc"])
    # Widths differ between short sequences, so positions are spread to make each window's half as wide as ``reach``.
    most = max(1, window // 2)
    reach = (most + 1) ** 2
    spread = F.col("_k") * F.when(half > 0, F.floor(F.lit(reach) / half)).otherwise(F.lit(reach + 1))
    rows = rows.withColumn("_sums", sums).withColumn("_y", spread.cast("bigint"))
    names = [*df.columns, "_s", "_n", "_y", "_sums"]
    if own.cut:
        rows = _with_reach(rows, reach, stretch * (reach // most), names)
    w = Window.partitionBy(*by, *["_part"] * own.cut).orderBy("_y")
    rows = rows.withColumns({"_hi": F.last("_sums").over(w.rangeBetween(Window.unboundedPreceding, reach)), "_lo": F.last("_sums").over(w.rangeBetween(Window.unboundedPreceding, -reach - 1))})
    if own.cut:
        rows = rows.where("_own")
    zero = F.lit(0.0)
    mean = {c: (F.col(f"_hi.t{c}") - F.coalesce(F.col(f"_lo.t{c}"), zero)) / F.nullif(F.col(f"_hi.c{c}") - F.coalesce(F.col(f"_lo.c{c}"), F.lit(0)), F.lit(0)) for c in values}
    rows = rows.withColumns({f"_m{c}": m for c, m in mean.items()})
    length = norm(cols(*[f"_m{c}" for c in q]))
    keep = F.col("_n") < 3
    out = {c: F.when(keep, F.col(c)).otherwise(F.col(f"_m{c}")) for c in ("tx", "ty", "tz")}
    out |= {c: F.when(keep, F.col(c)).when(length <= 1e-9, F.col(c) * F.col("_s")).otherwise(F.col(f"_m{c}") / length) for c in q}
    return rows.withColumns(out).select(*df.columns)


def _with_reach(rows: DataFrame, reach: int, size: int, names: list[str]) -> DataFrame:
    """``rows`` dealt to parts of ``size`` places, each with the rows beyond its ends that its own look up."""
    part = F.floor(F.col("_y") / size)
    # A window's first row, and the one before it, lie at most two reaches below.
    first, last = F.greatest(F.lit(0), F.floor((F.col("_y") - reach - 1) / size)), F.floor((F.col("_y") + 2 * (reach + 1)) / size)
    dealt = rows.select(*names, F.explode(F.sequence(first, last)).alias("_part"))
    return dealt.withColumn("_own", F.col("_part") == part)


def resample(df: DataFrame, fps: float, hz: float, by: list[str], order: str, width: str = "width", flag: str = "flag") -> DataFrame:
    """Rows at ``hz`` from rows at ``fps``: max(2, floor(duration * hz) + 1) of them; slerp, lerp, linear width, nearest flag (half to even).

    Sequences of under two rows stay as they are. ``order`` counts rows from 0.
    """
    n = df.groupBy(*by).agg(F.count("*").alias("_n"))
    last = (F.col("_n") - 1) / F.lit(float(fps))
    count = F.greatest(F.lit(2), F.floor(last * hz) + 1)
    count = F.when(F.col("_n") < 2, F.col("_n")).otherwise(count)
    grid = n.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1)))
    at = F.least(F.col("k") / F.lit(float(hz)), last) * float(fps)
    grid = grid.withColumn("_at", F.round(at, 9)).withColumn("_i", F.least(F.floor("_at"), F.greatest(F.col("_n") - 2, F.lit(0))))
    values = [*POSE, width, flag]
    a = df.select(*by, F.col(order).cast("bigint").alias("_i"), F.struct(*values).alias("_a"))
    b = df.select(*by, (F.col(order) - 1).cast("bigint").alias("_i"), F.struct(*values).alias("_b"))
    rows = grid.join(a, [*by, "_i"]).join(b, [*by, "_i"], "left").withColumn("_b", F.coalesce("_b", "_a"))
    u = F.when(F.col("_n") < 2, F.lit(0.0)).otherwise(F.col("_at") - F.col("_i"))
    p, q = ([F.col(f"{s}.{c}") for c in POSE] for s in ("_a", "_b"))
    t, r = lerp(p[:3], q[:3], u), slerp(tuple(p[3:]), tuple(q[3:]), u)
    near = F.bround("_at") > F.col("_i")
    return rows.select(*by, "k", (F.col("k") / F.lit(float(hz))).alias("t_s"), *named([*t, *r], POSE), (F.col(f"_a.{width}") + (F.col(f"_b.{width}") - F.col(f"_a.{width}")) * u).alias(width), F.when(near, F.col(f"_b.{flag}")).otherwise(F.col(f"_a.{flag}")).alias(flag))


def step_motion(df: DataFrame, by: list[str], order: str, fps: float, point=("tx", "ty", "tz")) -> DataFrame:
    """``df`` with step (distance from the row before, NULL at the first) and speed."""
    w = _w(by, order)
    df = df.withColumns({f"_p{c}": F.lag(c).over(w) for c in point})
    step = norm(sub(cols(*point), cols(*[f"_p{c}" for c in point])))
    return df.withColumn("step", step).withColumn("speed", step * float(fps)).drop(*[f"_p{c}" for c in point])


def contact(df: DataFrame, within: float = 0.05, hand=("hx", "hy", "hz"), obj=("ox", "oy", "oz"), hand_valid: str = "hand_valid", obj_valid: str = "obj_valid") -> DataFrame:
    """``df`` with contact: both valid and under ``within`` apart."""
    near = norm(sub(cols(*hand), cols(*obj))) < within
    return df.withColumn("contact", F.coalesce(F.col(hand_valid) & F.col(obj_valid) & near, F.lit(False)))


def motion_coupling(df: DataFrame, fps: float, by: list[str], order: str, least_cos: float = 0.6, least_speed: float = 0.02, hand=("hx", "hy", "hz"), obj=("ox", "oy", "oz"), hand_valid: str = "hand_valid", obj_valid: str = "obj_valid") -> DataFrame:
    """``df`` with coupled: hand and object valid in this row and the one before, and moving alike."""
    w = _w(by, order)
    df = df.withColumns({f"_p{c}": F.lag(c).over(w) for c in (*hand, *obj)})
    ok = F.col(hand_valid) & F.col(obj_valid)
    both = ok & F.coalesce(F.lag(ok).over(w), F.lit(False))
    hv = scale(sub(cols(*hand), cols(*[f"_p{c}" for c in hand])), float(fps))
    ov = scale(sub(cols(*obj), cols(*[f"_p{c}" for c in obj])), float(fps))
    alike = (norm(ov) >= least_speed) & (norm(hv) >= 1e-6) & (dot(hv, ov) > least_cos * norm(hv) * norm(ov))
    return df.withColumn("coupled", F.coalesce(both & alike, F.lit(False))).drop(*[f"_p{c}" for c in (*hand, *obj)])


def grasp_state(df: DataFrame, width: str, close: Column | float, open_: Column | float, by: list[str], order: str, least_run: int = 3, contact_mode: str = "frame") -> DataFrame:
    """``df`` (with contact and coupled) with closed: (narrow and (contact or coupled)) or (coupled and contact), short runs absorbed.

    ``contact_mode`` "last_frame" counts contact in the last row of a sequence only.
    """
    touch = F.col("contact")
    if contact_mode == "last_frame":
        touch = touch & F.lead(order).over(_w(by, order)).isNull()
    df = schmitt(df, width, close, open_, by, order, out="_narrow").withColumn("_touch", touch)
    closed = F.col("_narrow") & (F.col("_touch") | F.col("coupled")) | (F.col("coupled") & F.col("_touch"))
    return absorb_short_runs(df.withColumn("closed", closed), "closed", least_run, by, order).drop("_narrow", "_touch")


def top_detection(df: DataFrame, by: list[str], metric: Column, tie: str) -> DataFrame:
    """The row with the largest ``metric`` of each group; ties go to the lowest ``tie``."""
    names = df.columns
    best = df.withColumn("_m", F.struct(metric.alias("m"), (-F.col(tie)).alias("t"))).groupBy(*by).agg(F.max_by(F.struct(*names), F.col("_m")).alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) for c in names])


def canonical_model(points: DataFrame, by: list[str], order: str, xyz=("x", "y", "z")) -> DataFrame:
    """Points of each sequence's first row position, centred on their mean, with that mean (cx, cy, cz)."""
    first = points.withColumn("_f", F.min(order).over(Window.partitionBy(*by))).where(F.col(order) == F.col("_f")).drop("_f")
    w = Window.partitionBy(*by)
    means = {f"c{c}": F.avg(c).over(w) for c in xyz}
    first = first.withColumns(means)
    return first.withColumns({c: F.col(c) - F.col(f"c{c}") for c in xyz})
