"""Solvers: moments are summed by Spark, small matrices are decomposed one row per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajlake.functions.pose import POSE

_SIM3 = ", ".join(f"{c} double" for c in ("s", *POSE))


def _quaternion(r: np.ndarray) -> np.ndarray:
    """(w, x, y, z) with w >= 0 of a rotation matrix."""
    k = np.array([
        [r[0, 0] - r[1, 1] - r[2, 2], 0, 0, 0], [r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], 0, 0],
        [r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1], 0], [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], r.trace()],
    ])
    v = np.linalg.eigh(k / 3)[1][:, -1]
    q = v[[3, 0, 1, 2]]
    return -q if q[0] < 0 else q


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(m)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt)) or 1]) @ vt


def fit_sim3(pairs: DataFrame, by: list[str], with_scale: bool = True, src=("x", "y", "z"), dst=("u", "v", "w")) -> DataFrame:
    """by, n, s, pose of the similarity that takes src to dst in the least squares, with rmse, max_error, median_error.

    Groups of under 3 pairs, or of one point, have no row. Means, covariance and variance are divided by n.
    """
    sums = [F.avg(c).alias(f"m_{c}") for c in (*src, *dst)] + [F.avg(F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for a in dst for b in src] + [F.avg(F.col(a) * F.col(a)).alias(f"q_{a}") for a in src]
    moments = pairs.groupBy(*by).agg(F.count("*").alias("n"), *sums).where("n >= 3")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = np.full((len(f), 8), np.nan)
            for i, row in enumerate(f.itertuples(index=False)):
                r = row._asdict()
                a, b = (np.array([r[f"m_{c}"] for c in names]) for names in (src, dst))
                cov = np.array([[r[f"c_{d}_{s}"] for s in src] for d in dst]) - np.outer(b, a)
                var = sum(r[f"q_{s}"] for s in src) - a @ a
                if var <= 1e-15:
                    continue
                u, d, vt = np.linalg.svd(cov)
                sign = np.diag([1, 1, 1.0 if np.linalg.det(u) * np.linalg.det(vt) > 0 else -1.0])
                rot = u @ sign @ vt
                s = float((d * np.diag(sign)).sum() / var) if with_scale else 1.0
                out[i] = [s, *(b - s * rot @ a), *_quaternion(rot)]
            yield pd.concat([f[[*by, "n"]].reset_index(drop=True), pd.DataFrame(out, columns=["s", *POSE])], axis=1).dropna(subset=["s"])

    kinds = ", ".join(f"`{c}` {moments.schema[c].dataType.simpleString()}" for c in by)
    fits = moments.mapInPandas(solve, f"{kinds}, n bigint, {_SIM3}")
    from trajlake.functions.pose import add, cols, norm, rotate, scale, sub

    moved = add(scale(rotate(cols(*POSE[3:]), cols(*src)), F.col("s")), cols(*POSE[:3]))
    errors = pairs.join(fits, by).select(*by, norm(sub(moved, cols(*dst))).alias("_e"))
    stats = errors.groupBy(*by).agg(F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.max("_e").alias("max_error"), F.percentile("_e", F.lit(0.5)).alias("median_error"))
    return fits.join(stats, by)


def reference_pose(obs: DataFrame, by: list[str], order: str, least: int = 3, most: int = 40) -> DataFrame:
    """by, n, pose: per-axis median position and mean rotation of up to ``most`` evenly drawn observations; ``least`` at least."""
    from trajlake.functions.pose import cols
    from trajlake.operators.sample import even_sample

    drawn = even_sample(obs, most, by, order)
    w, x, y, z = cols(*POSE[3:])
    r = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]
    mean = drawn.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile(c, F.lit(0.5)).alias(c) for c in POSE[:3]], *[F.avg(r[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)]).where(F.col("n") >= least)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = f[[f"r{i}{j}" for i in range(3) for j in range(3)]].to_numpy().reshape(-1, 3, 3)
            q = np.array([_quaternion(nearest_rotation(x)) for x in m]).reshape(-1, 4)
            yield pd.concat([f[[*by, "n", *POSE[:3]]].reset_index(drop=True), pd.DataFrame(q, columns=list(POSE[3:]))], axis=1)

    kinds = ", ".join(f"`{c}` {mean.schema[c].dataType.simpleString()}" for c in by)
    return mean.mapInPandas(solve, f"{kinds}, n bigint, " + ", ".join(f"{c} double" for c in POSE))


def triangulate(views: DataFrame, by: list[str], matrix: list[str], u: str = "u", v: str = "v", first: int | None = None, order: str | None = None) -> DataFrame:
    """by, n, x, y, z: the point seen at (u, v) through 3x4 projections (12 columns, row by row) of two views or more.

    The ten sums of the normal matrix are Spark's; its smallest eigenvector is taken per group. NULL
    if the last coordinate vanishes.
    """
    if first is not None:
        views = views.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_k") <= first)
    p = [F.col(c) for c in matrix]
    rows = [[F.col(u) * p[8 + k] - p[k] for k in range(4)], [F.col(v) * p[8 + k] - p[4 + k] for k in range(4)]]
    sums = [F.sum(rows[0][i] * rows[0][j] + rows[1][i] * rows[1][j]).alias(f"a{i}{j}") for i in range(4) for j in range(i, 4)]
    normal = views.groupBy(*by).agg(F.count("*").alias("n"), *sums).where("n >= 2")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a = np.zeros((len(f), 4, 4))
            for i in range(4):
                for j in range(i, 4):
                    a[:, i, j] = a[:, j, i] = f[f"a{i}{j}"]
            point = np.linalg.eigh(a)[1][:, :, 0] if len(f) else np.zeros((0, 4))
            good = np.abs(point[:, 3]) >= 1e-12
            xyz = np.where(good[:, None], point[:, :3] / np.where(good, point[:, 3], 1)[:, None], np.nan)
            out = pd.DataFrame(xyz, columns=list("xyz"))
            yield pd.concat([f[[*by, "n"]].reset_index(drop=True), out], axis=1)

    kinds = ", ".join(f"`{c}` {normal.schema[c].dataType.simpleString()}" for c in by)
    out = normal.mapInPandas(solve, f"{kinds}, n bigint, x double, y double, z double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "xyz"})


#: Points in the cell of a point, on average, at most; queries that are looked up at once.
_CELL_POINTS, _AT_ONCE = 4, 1 << 15


class VoxelGrid:
    """Exact nearest neighbours among points, by cells of a pyramid of grids.

    A query looks into its cell and the 26 around it. What it finds there within a cell's width is nearest of all; the few
    queries that find nothing so near look again in cells twice as wide.
    """

    def __init__(self, points: np.ndarray):
        self.points, self.low = points, points.min(0)
        self.span = float(np.ptp(points, axis=0).max())
        # About two points a cell, were they spread evenly over the box; narrower while points crowd their cells all the same.
        self.width = max(self.span * (2.0 / len(points)) ** (1 / 3), 1e-12)
        self.grids: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        while self.width > max(self.span / (1 << 18), 1e-12):
            sizes = np.unique(self._grid(0)[0], return_counts=True)[1].astype(float)
            if (sizes * sizes).sum() <= _CELL_POINTS * len(points):
                break
            self.width /= 2
            self.grids.clear()

    def _cells(self, at: np.ndarray, level: int) -> np.ndarray:
        return np.floor((at - self.low) / (self.width * 2.0**level)).astype(np.int64)

    @staticmethod
    def _code(cells: np.ndarray) -> np.ndarray:
        # Cells of the points lie in [0, 2^20); all others get a code that no point has.
        inside = ((cells >= 0) & (cells < 1 << 20)).all(-1)
        return np.where(inside, cells[..., 0] << 40 | cells[..., 1] << 20 | cells[..., 2], -1)

    def _grid(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self.grids:
            code = self._code(self._cells(self.points, level))
            order = np.argsort(code, kind="stable")
            self.grids[level] = code[order], order
        return self.grids[level]

    def nearest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest point, the first of equally near ones, and its squared distance, for each row of ``at``."""
        found = [self._nearest(at[i : i + _AT_ONCE]) for i in range(0, max(len(at), 1), _AT_ONCE)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _nearest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, gap = np.zeros(len(at), np.int64), np.full(len(at), np.inf)
        around = np.stack(np.meshgrid(*[np.arange(-1, 2)] * 3, indexing="ij"), -1).reshape(-1, 3)
        todo, level = np.arange(len(at)), 0
        while len(todo):
            width = self.width * 2.0**level
            if width > 2 * self.span:
                # Wider cells tell nothing apart any more: these are far from all points.
                for part in np.array_split(todo, -(-len(todo) // 64)):
                    d = ((at[part, None] - self.points[None]) ** 2).sum(2)
                    best[part], gap[part] = d.argmin(1), d.min(1)
                break
            code, order = self._grid(level)
            wanted = self._code(self._cells(at[todo], level)[:, None] + around[None])
            first, last = np.searchsorted(code, wanted), np.searchsorted(code, wanted, "right")
            n = np.where(wanted >= 0, last - first, 0).ravel()
            own = np.repeat(np.arange(len(todo)), n.reshape(len(todo), 27).sum(1))
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found = order[np.repeat(first.ravel(), n) + place]
            d = ((at[todo][own] - self.points[found]) ** 2).sum(1)
            if len(own):
                top = np.flatnonzero(np.diff(own, prepend=-1))
                low = np.minimum.reduceat(d, top)
                first_of = np.minimum.reduceat(np.where(d == np.repeat(low, np.diff(top, append=len(d))), found, len(self.points)), top)
                best[todo[own[top]]], gap[todo[own[top]]] = first_of, low
            todo = todo[gap[todo] > width * width]
            level += 1
        return best, gap


def trimmed_icp(source: np.ndarray, target: np.ndarray, start: np.ndarray, trim: float, rounds: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Rotation, translation, rmse and pairs of the rigid fit of ``source`` to ``target``, from rotation ``start`` at the target's centre.

    The worst ``trim`` of the pairs of each round don't count; ``rmse`` is of the kept pairs before the last update. A round
    that keeps the pairs of the round before would move nothing any more, and neither would those after it.
    """
    source, target = (a[np.lexsort(a.T)] for a in (source, target))
    grid = VoxelGrid(target)
    rot, t = start, target.mean(0) - start @ source.mean(0)
    keep = max(4, int(len(source) * (1 - trim)))
    rmse, n, last = float("nan"), 0, None
    for _ in range(rounds):
        moved = source @ rot.T + t
        near, gap = grid.nearest(moved)
        kept = np.argsort(gap, kind="stable")[:keep]
        rmse, n = float(np.sqrt(gap[kept].mean())), len(kept)
        a, b = moved[kept], target[near[kept]]
        step = nearest_rotation((b - b.mean(0)).T @ (a - a.mean(0)))
        rot, t = nearest_rotation(step @ rot), step @ (t - a.mean(0)) + b.mean(0)
        pairs = np.full(len(source), -1)
        pairs[kept] = near[kept]
        if last is not None and (pairs == last).all():
            break
        last = pairs
    return rot, t, rmse, n


def register_frames(model: DataFrame, clouds: DataFrame, by: list[str], frame: str, trim: float = 0.2, rounds: int = 20, most: int | None = 4000, chain: bool = False) -> DataFrame:
    """by, frame, pose, rmse, n: the canonical model moved onto each frame's cloud, from the cloud's centre, by trimmed ICP.

    Both have by, point_id, x, y, z, and ``clouds`` the frame. A side keeps ``most`` points at most, drawn by a hash of their id (None: all); a
    frame or a model of under four points has no row. Each frame starts upright and for itself, so frames run in parallel. With
    ``chain`` it starts from the rotation of the frame before it that had a fit, as a turning object needs: a
    group's points then pass one task in frame order, which holds the model and one frame at a time, and groups run in parallel.
    """
    from trajlake.operators.sample import seeded_cap

    points = [*by, "point_id", "x", "y", "z"]
    m, c = model.select(*points), clouds.select(*points, frame)
    if most is not None:
        m, c = seeded_cap(m, most, 1, by, "point_id"), seeded_cap(c, most, 2, [*by, frame], "point_id")
    kinds = {k: c.schema[k].dataType.simpleString() for k in (*by, frame)}
    schema = ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + ", " + ", ".join(f"{k} double" for k in POSE) + ", rmse double, n double"
    names = [*by, frame, *POSE, "rmse", "n"]
    if chain:
        return _chained(m, c, by, frame, trim, rounds, names, schema)
    sides = [d.groupBy(*keys).agg(F.flatten(F.collect_list(F.array("x", "y", "z"))).alias(out)) for d, keys, out in ((c, [*by, frame], "_c"), (m, by, "_m"))]
    # A number of partitions that is asked for stays: fits take long for their few bytes, by which Spark would put them all into one task.
    rows = sides[0].join(sides[1], by).repartition(_tasks(model), *by, frame)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for keys, a, b in zip(f[[*by, frame]].itertuples(index=False), f["_m"], f["_c"], strict=True):
                x, y = (np.asarray(v, float).reshape(-1, 3) for v in (a, b))
                if min(len(x), len(y)) >= 4:
                    rot, t, rmse, n = trimmed_icp(x, y, np.eye(3), trim, rounds)
                    out.append([*keys, *t, *_quaternion(rot), rmse, n])
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(solve, schema)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _chained(model: DataFrame, clouds: DataFrame, by: list[str], frame: str, trim: float, rounds: int, names: list[str], schema: str) -> DataFrame:
    both = model.withColumn(frame, F.lit(None).cast(clouds.schema[frame].dataType)).unionByName(clouds.where(F.col(frame).isNotNull()))
    # The model comes first, as its frame is null.
    stream = both.select(*by, frame, "x", "y", "z").repartition(_tasks(model), *by).sortWithinPartitions(*by, F.asc_nulls_first(frame))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, at, source, rot = None, None, np.zeros((0, 3)), np.eye(3)
        parts: list[np.ndarray] = []

        def fit() -> list[list]:
            nonlocal source, rot
            points = np.concatenate(parts) if parts else np.zeros((0, 3))
            parts.clear()
            if at is None:
                source = points
            elif min(len(source), len(points)) >= 4:
                rot, t, rmse, n = trimmed_icp(source, points, rot, trim, rounds)
                return [[*group, at, *t, *_quaternion(rot), rmse, n]]
            return []

        for f in batches:
            out: list[list] = []
            keys = [tuple(k) for k in f[by].itertuples(index=False)]
            frames = [None if pd.isna(x) else x for x in f[frame]]
            xyz = f[["x", "y", "z"]].to_numpy(float)
            edges = [i for i in range(len(f)) if i == 0 or keys[i] != keys[i - 1] or frames[i] != frames[i - 1]]
            for lo, hi in zip(edges, [*edges[1:], len(f)], strict=True):
                if keys[lo] != group or frames[lo] != at:
                    if group is not None:
                        out += fit()
                    if keys[lo] != group:
                        source, rot = np.zeros((0, 3)), np.eye(3)
                    group, at = keys[lo], frames[lo]
                parts.append(xyz[lo:hi])
            yield pd.DataFrame(out, columns=names)
        if group is not None:
            yield pd.DataFrame(fit(), columns=names)

    return stream.mapInPandas(solve, schema)
