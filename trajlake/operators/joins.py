"""Joins of the capture pipeline."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajlake.operators.scan import STRETCH_ROWS, Scan

#: As many rows as a side may have to be broadcast: vectors or cameras take a few KB each.
BROADCAST_ROWS = 20_000
#: Bytes of query vectors that travel to the tasks at once, and references that a task scores at once.
QUERY_BYTES, BLOCK_ROWS = 1 << 25, 512
#: As many hashes of required pairs as are broadcast, of 8 bytes each.
BROADCAST_PAIRS = 1 << 21
#: Rows of a block of hashes besides those that visit it, bits that name a block at least, values looked up and pairs formed at once.
HASH_ROWS, HASH_BITS, HASH_CELLS, PAIR_ROWS = 1 << 18, 6, 1 << 18, 1 << 20


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if len(df.limit(most + 1).select(F.lit(1)).collect()) <= most else df


def asof_nearest(left: DataFrame, right: DataFrame, on: str, by: list[str], tolerance: Column | float | None = None, right_cols: list[str] | None = None, stretch: int = STRETCH_ROWS) -> DataFrame:
    """``left`` with r_* of the row of ``right`` nearest in ``on``, ties to the earlier, none beyond the tolerance.

    The default tolerance is half of the right side's mean interval. Both sides go
    through one sort: the last right row before and the first one after each left row.
    """
    right_cols = right_cols or [c for c in right.columns if c not in by]
    stats = right.groupBy(*by).agg(F.count("*").alias("_n"), (F.max(on) - F.min(on)).alias("_span"))
    lefts = left.select(*by, F.col(on).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(_struct(right, right_cols)).alias("_r"))
    rights = right.select(*by, F.col(on).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(_struct(left, left.columns)).alias("_l"), F.struct(*right_cols).alias("_r"))
    both = Scan(lefts.unionByName(rights), by, ["_t", "_side"], stretch).last(_b=F.col("_r")).next(_a=F.col("_r"))
    rows = both.df.where("_side = 1").join(small(stats), by, "left")
    later = F.col("_b").isNull() | (F.col(f"_a.{on}") - F.col("_t") < F.col("_t") - F.col(f"_b.{on}"))
    rows = rows.withColumn("_c", F.when(F.coalesce(later, F.lit(False)), F.col("_a")).otherwise(F.col("_b")))
    most = F.when(F.col("_n") > 0, 0.5 * F.col("_span") / F.col("_n")) if tolerance is None else F.lit(tolerance)
    ok = F.abs(F.col(f"_c.{on}") - F.col("_t")) <= most
    return rows.select(*[F.col(f"_l.{c}").alias(c) for c in left.columns], *[F.when(ok, F.col(f"_c.{c}")).alias(f"r_{c}") for c in right_cols])


def _struct(df: DataFrame, names: list[str]) -> str:
    return "struct<" + ",".join(f"`{n}`:{df.schema[n].dataType.simpleString()}" for n in names) + ">"


def rate_map(index: Column, fps_from: float, fps_to: float, n_to: Column, rounding: str) -> Column:
    """Index in a sequence of ``n_to`` rows at ``fps_to`` for a row at ``fps_from``: "half_up" or "half_even", clamped."""
    x = F.round(index / F.lit(float(fps_from)) * float(fps_to), 9)
    if rounding not in ("half_up", "half_even"):
        raise ValueError(rounding)
    mapped = F.floor(x + 0.5) if rounding == "half_up" else F.bround(x)
    return F.greatest(F.lit(0), F.least(n_to - 1, mapped)).cast("bigint")


def rate_map_join(a: DataFrame, b: DataFrame, fps_a: float, fps_b: float, rounding: str, by: list[str], order: str) -> DataFrame:
    """``a`` with mapped (row of ``b``) and b_* of that row; rows count from 0 in ``order``."""
    n = b.groupBy(*by).agg(F.count("*").alias("_n"))
    mapped = a.join(n, by).withColumn("mapped", rate_map(F.col(order), fps_a, fps_b, F.col("_n"), rounding)).drop("_n")
    others = b.select(*by, F.col(order).cast("bigint").alias("mapped"), *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in (*by, order)])
    return mapped.join(others, [*by, "mapped"])


def dot_product(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def retrieve_topk(queries: DataFrame, refs: DataFrame, k: int, by: list[str] | None = None, clusters: int = 64) -> DataFrame:
    """query, ref, score, rank: the ``k`` references (ref, rvec) of the largest dot product for each query (query, qvec).

    With ``by``, within groups of it (a run). Without, references are dealt to ``clusters`` and pass the tasks cluster by
    cluster. A task holds the queries and the best ``k`` it has met for each; of a block of references it scores only the queries that the block's
    centre and radius leave a chance, so no result is lost. At most tasks x queries x ``k`` rows leave the tasks. Queries
    travel in parts of QUERY_BYTES; for each part the references are read once. Ties go to the lower
    reference. Ids are integers; a null vector is nowhere.
    """
    by = by or []
    if by:
        best = queries.join(refs, by).select(*by, "query", "ref", dot_product("qvec", "rvec").alias("score"))
    else:
        queries, refs = queries.where("qvec is not null"), refs.where("rvec is not null")
        n, width = queries.agg(F.count("*"), F.max(F.size("qvec"))).first()
        parts = max(1, -(-n * (width or 0) * 8 // QUERY_BYTES))
        dealt = _clustered(refs, clusters)
        best = None
        for part in range(parts):
            own = queries.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part) if parts > 1 else queries
            found = _block_best(own, dealt, k)
            best = found if best is None else best.unionByName(found)
    w = Window.partitionBy(*by, "query").orderBy(F.desc("score"), "ref")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _clustered(refs: DataFrame, clusters: int) -> DataFrame:
    """ref, rvec, like vectors side by side: sorted by the nearest of ``clusters`` references that a hash draws."""
    pivots = refs.select("rvec").orderBy(F.xxhash64("ref"), "ref").limit(clusters).toPandas()["rvec"]
    if len(pivots) < clusters:
        return refs.select("ref", "rvec")
    centres = refs.sparkSession.sparkContext.broadcast(np.stack(pivots.to_numpy()).astype(np.float64))

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = centres.value
        for f in frames:
            if len(f):
                x = np.stack(f["rvec"].to_numpy()).astype(np.float64)
                yield f.assign(cluster=((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1).astype(np.int32))

    kind = refs.schema["rvec"].dataType.simpleString()
    rows = refs.select("ref", "rvec").mapInPandas(nearest, f"ref bigint, rvec {kind}, cluster int")
    # A large cluster lies over several ranges.
    return rows.repartitionByRange("cluster", "ref").sortWithinPartitions("cluster", "ref").drop("cluster")


def _block_best(queries: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    rows = queries.select("query", "qvec").toPandas()
    matrix = np.stack(rows["qvec"].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 0))
    shared = queries.sparkSession.sparkContext.broadcast((rows["query"].to_numpy(np.int64), matrix))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        length = np.sqrt((matrix * matrix).sum(1)) if len(ids) else None
        score, ref = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for f in frames:
            for at in range(0, len(f) if len(ids) else 0, BLOCK_ROWS):
                own = f.iloc[at : at + BLOCK_ROWS]
                x, names = np.stack(own["rvec"].to_numpy()).astype(np.float64), own["ref"].to_numpy(np.int64)
                centre = x.mean(0)
                radius = np.sqrt(((x - centre) ** 2).sum(1).max())
                # A little slack, so that rounding never drops a reference.
                bound = (matrix @ centre + length * radius) * (1 + 1e-12) + 1e-9 * length * (np.abs(centre).sum() + radius)
                todo = np.flatnonzero(bound >= score[:, -1])
                for part in np.array_split(todo, -(-len(todo) // BLOCK_ROWS)) if len(todo) else []:
                    s = np.concatenate([score[part], matrix[part] @ x.T], axis=1)
                    r = np.concatenate([ref[part], np.broadcast_to(names, (len(part), len(names)))], axis=1)
                    best = np.lexsort((r, -s), axis=1)[:, :k]
                    score[part], ref[part] = np.take_along_axis(s, best, 1), np.take_along_axis(r, best, 1)
        kept = np.isfinite(score)
        yield pd.DataFrame({"query": np.repeat(ids, kept.sum(1)), "ref": ref[kept], "score": score[kept]})

    return refs.mapInPandas(run, "query bigint, ref bigint, score double")


def candidate_pairs(frames: DataFrame, by: list[str], order: str, mode: str = "auto", window: int = 5, k: int = 3, limit: int = 120, retrieval: DataFrame | None = None) -> DataFrame:
    """by, i, j with i < j: all pairs of a group of at most ``limit`` frames, else a band of ``window`` and retrieved pairs outside of it.

    ``mode`` "exhaustive" or "band" decides for all groups. ``retrieval`` has by, i, j.
    """
    f = frames.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    all_ = {"exhaustive": F.lit(True), "band": F.lit(False), "auto": F.col("_n") <= limit}[mode]
    reach = F.when(all_, F.col("_n").cast("int")).otherwise(F.lit(window))
    # Frames are numbered from 0: the partners are positions, so no pair that isn't wanted is formed.
    i = F.col(order).cast("bigint")
    near = f.select(*by, i.alias("i"), F.explode(F.sequence(i + 1, i + reach)).alias("j"))
    have = frames.select(*by, F.col(order).cast("bigint").alias("j"))
    out = near.join(have, [*by, "j"]).select(*by, "i", "j")
    if retrieval is not None:
        far = retrieval.join(f.groupBy(*by).agg(F.max("_n").alias("_n")), by).where(~all_)
        out = out.unionByName(far.select(*by, F.least("i", "j").cast("bigint").alias("i"), F.greatest("i", "j").cast("bigint").alias("j")).where("i < j"))
    return out.distinct()


def baseline_pairs(frames: DataFrame, matched: DataFrame, gap: int, by: list[str], order: str) -> DataFrame:
    """by, i, j, n_matches, fallback: matched pairs ``gap`` apart; of a group without any, adjacent ones, flagged."""
    def at(g: int) -> DataFrame:
        own = frames.select(*by, F.col(order).cast("bigint").alias("i"), (F.col(order) + g).cast("bigint").alias("j"))
        return own.join(matched, [*by, "i", "j"])

    wide = at(gap).withColumn("fallback", F.lit(False))
    near = at(1).join(wide.select(*by).distinct(), by, "left_anti").withColumn("fallback", F.lit(True))
    return wide.unionByName(near)


def correspondences(pairs: DataFrame, matches: DataFrame, observations: DataFrame) -> DataFrame:
    """query, query_kp, ref, ref_kp, point_id: one vote per query keypoint, by the first reference in rank with a point.

    ``pairs`` (query, ref, ref_rank), ``matches`` (query, ref, query_kp, ref_kp; -1: none), ``observations`` (image, kp, point_id).
    """
    hits = matches.where("ref_kp >= 0").join(pairs, ["query", "ref"])
    points = observations.where("point_id is not null").select(F.col("image").alias("ref"), F.col("kp").alias("ref_kp"), "point_id")
    best = hits.join(points, ["ref", "ref_kp"]).groupBy("query", "query_kp").agg(F.min(F.struct("ref_rank", "ref", "ref_kp", "point_id")).alias("b"))
    return best.select("query", "query_kp", "b.ref", "b.ref_kp", "b.point_id")


def frame_anchors(observations: DataFrame, points: DataFrame, poses: DataFrame, depth: Column, least_depth: float = 1e-3, least: int = 20) -> DataFrame:
    """Observations joined with points (point_id) and poses (image), with depth, of images that keep ``least`` at least."""
    rows = observations.join(points, "point_id").join(poses, "image").withColumn("depth", depth).where(F.col("depth") > least_depth)
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("image"))).where(F.col("_n") >= least).drop("_n")


def missing_frames(manifest: DataFrame, files: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, n_missing, first_missing (three names at most)."""
    gone = manifest.join(files.select(*by, name).distinct(), [*by, name], "left_anti")
    ranked = gone.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(name)))
    return ranked.groupBy(*by).agg(F.count("*").alias("n_missing"), F.array_sort(F.collect_list(F.when(F.col("_k") <= 3, F.col(name)))).alias("first_missing"))


def coverage(required: DataFrame, have: DataFrame, a: str, b: str) -> DataFrame:
    """Required pairs that ``have`` has in neither orientation; "/" in names counts as "-"."""
    def pair(df: DataFrame) -> list[Column]:
        x, y = (F.replace(F.col(c).cast("string"), F.lit("/"), F.lit("-")) for c in (a, b))
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    need, met = required.select(*pair(required)).distinct(), have.select(*pair(have))
    # Pairs that nothing requires go before any task holds or shuffles them.
    hashes = need.select(F.xxhash64("a", "b").alias("_h")).distinct()
    if hashes.count() <= BROADCAST_PAIRS:
        met = met.withColumn("_h", F.xxhash64("a", "b")).join(F.broadcast(hashes), "_h", "left_semi").drop("_h")
    return need.join(met, ["a", "b"], "left_anti")


def accepted_only(df: DataFrame, status: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of episodes whose status isn't rejected; no status counts as rejected."""
    ok = status.where(~F.coalesce(F.col("rejected"), F.lit(True))).select(*keys).distinct()
    return df.join(ok, keys, "left_semi")


def prefer(df: DataFrame, refined: DataFrame, prior: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with ``value`` from ``refined`` if it has one, else from ``prior``, and value_source."""
    out = df.join(refined.select(*keys, F.col(value).alias("_r")), keys, "left").join(prior.select(*keys, F.col(value).alias("_p")), keys, "left")
    source = F.when(F.col("_r").isNotNull(), F.lit("refined")).when(F.col("_p").isNotNull(), F.lit("prior")).otherwise(F.lit("none"))
    return out.withColumn(value, F.coalesce("_r", "_p")).withColumn("value_source", source).drop("_r", "_p")


def resolve_companions(clips: DataFrame, files: DataFrame, explicit: DataFrame, clip: str, names: list[Column], path: str = "path") -> DataFrame:
    """``clips`` with ``path``: the explicit one, else the first of ``names`` that is a file."""
    out = clips.join(explicit.select(clip, F.col(path).alias("_e")), clip, "left")
    found: list[Column] = [F.col("_e")]
    have = files.select(F.col(path).alias("_f")).distinct()
    for i, name in enumerate(names):
        out = out.withColumn(f"_n{i}", name).join(have.withColumnRenamed("_f", f"_f{i}"), F.col(f"_n{i}") == F.col(f"_f{i}"), "left")
        found.append(F.col(f"_f{i}"))
    return out.withColumn(path, F.coalesce(*found)).drop("_e", *[f"_{x}{i}" for i in range(len(names)) for x in "nf"])


def view_pixels(cameras: DataFrame, cloud: DataFrame, fx: float, width: int, height: int, near: float = 0.05, far: float = 10.0, splat: int = 0, fill_ring: int = 1, block: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """by, clip, frame, px, py, depth, point_id: pixels that points cover in each camera, each widened to a square.

    Cameras (by, clip, frame, pose) see the points (by, point_id, x, y, z) of their own session ``by``. They walk an octree of the cloud, four cells a side and
    level: from the few cells around them that are as wide as they see, down to blocks of side ``block``, keeping at each level the
    cells whose sphere meets their view cone. Only points of the blocks that are left are projected. ``fill_ring``
    widens by as many pixels more, for points whose own square touches the image.
    """
    from trajlake.functions.pose import POSE, cols, conj, rotate, sub

    by = by or []
    slope = ((width / 2 + 1 + splat) / fx, (height / 2 + 1 + splat) / fx)
    # No camera sees farther than this, so what it sees lies in its own cell of the top level or in one beside it.
    reach = far * (1 + slope[0] ** 2 + slope[1] ** 2) ** 0.5
    top = 0
    while block * 4**top < reach:
        top += 1
    cell = [f"b{c}" for c in "xyz"]
    points = cloud.select("*", *[F.floor(F.col(c) / block).cast("bigint").alias(b) for b, c in zip(cell, "xyz", strict=True)])
    blocks = points.select(*by, *cell).distinct()
    few = len(blocks.limit(BROADCAST_ROWS + 1).select(F.lit(1)).collect()) <= BROADCAST_ROWS

    def nodes(level: int) -> DataFrame:
        """Cells of a level, with the one above each. No level has more cells than there are blocks."""
        at = [F.floor(F.col(b) / 4**k).cast("bigint").alias(f"{n}{b}") for n, k in (("n", level), ("u", level + 1)) for b in cell]
        out = blocks.select(*by, *at).distinct()
        return F.broadcast(out) if few else out

    def seen(level: int) -> Column:
        size = block * 4**level
        half = size * 3**0.5 / 2
        view = rotate(conj(cols(*POSE[3:])), sub(tuple((F.col(f"n{b}") + 0.5) * size for b in cell), cols(*POSE[:3])))
        ok = (view[2] > near - half) & (view[2] < far + half)
        for c, k in zip(view[:2], slope, strict=True):
            ok = ok & (F.abs(c) <= k * F.greatest(view[2], F.lit(0.0)) + half * (1 + k))
        return ok

    met = cameras.select(*by, "clip", "frame", *POSE)
    for b, at in zip(cell, POSE[:3], strict=True):
        own = F.floor(F.col(at) / (block * 4**top)).cast("bigint")
        met = met.withColumn(f"n{b}", F.explode(F.array(own - 1, own, own + 1)))
    met = met.join(nodes(top).drop(*[f"u{b}" for b in cell]), [*by, *[f"n{b}" for b in cell]]).where(seen(top))
    for level in reversed(range(top)):
        met = met.withColumnsRenamed({f"n{b}": f"u{b}" for b in cell}).join(nodes(level), [*by, *[f"u{b}" for b in cell]]).where(seen(level)).drop(*[f"u{b}" for b in cell])
    rows = met.withColumnsRenamed({f"n{b}": b for b in cell}).join(small(points.select(*by, *cell, "point_id", "x", "y", "z")), [*by, *cell])
    p = rotate(conj(cols(*POSE[3:])), sub(cols("x", "y", "z"), cols(*POSE[:3])))
    own = [*by, "clip", "frame", "point_id"]
    rows = rows.select(*own, *[c.alias(n) for c, n in zip(p, ("cx", "cy", "cz"), strict=True)]).where((F.col("cz") > near) & (F.col("cz") < far))
    u = F.floor(F.try_divide("cx", "cz") * fx + width / 2 + 0.5).cast("int")
    v = F.floor(F.try_divide("cy", "cz") * fx + height / 2 + 0.5).cast("int")
    rows = rows.select(*own, F.col("cz").alias("depth"), u.alias("u"), v.alias("v"))
    rows = rows.where(F.col("u").between(-splat, width - 1 + splat) & F.col("v").between(-splat, height - 1 + splat))
    wide = splat + fill_ring
    # The squares end at the image's edge, so no pixel outside of it is made.
    rows = rows.select(*own, "depth", "v", F.explode(F.sequence(F.greatest(F.col("u") - wide, F.lit(0)), F.least(F.col("u") + wide, F.lit(width - 1)))).alias("px"))
    rows = rows.select(*own, "depth", "px", F.explode(F.sequence(F.greatest(F.col("v") - wide, F.lit(0)), F.least(F.col("v") + wide, F.lit(height - 1)))).alias("py"))
    return rows.select(*by, "clip", "frame", "px", "py", "depth", "point_id")


def _word(of: Iterable[int]) -> int:
    """The signed 64-bit number of some bits."""
    of = list(of)
    return sum(1 << i for i in of) - (1 << 64 if 63 in of else 0)


def _varying(kinds: DataFrame) -> tuple[list[int], int]:
    """Bits that aren't the same in all hashes ``ha``, most even first, and the number of hashes."""
    ones = kinds.agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned("ha", i).bitwiseAND(1)).alias(f"b{i}") for i in range(64)]).first()
    n = ones["n"]
    share = {i: ones[f"b{i}"] / n for i in range(64) if n and 0 < ones[f"b{i}"] < n}
    return sorted(share, key=lambda i: abs(share[i] - 0.5)), n


def _banded(kinds: DataFrame, bits: list[int], most: int) -> tuple[DataFrame, float]:
    """ha, band, code, with the bits dealt to ``most`` + 1 bands, and the number of pairs that meet in them."""
    bands = [_word(bits[k :: most + 1]) for k in range(most + 1)]
    banded = kinds.select("ha", F.posexplode(F.array(*[F.col("ha").bitwiseAND(F.lit(m)) for m in bands])).alias("band", "code"))
    pairs = banded.groupBy("band", "code").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()[0] or 0
    return banded, pairs


def _near(met: DataFrame, most: int) -> DataFrame:
    distance = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))).cast("int").alias("distance")
    return met.select("ha", "hb", distance).where(F.col("distance") <= most).distinct()


def _met(banded: DataFrame, most: int) -> DataFrame:
    return _near(banded.join(banded.select("band", "code", F.col("ha").alias("hb")), ["band", "code"]).where("ha < hb"), most)


def hash_links(kinds: DataFrame, most: int) -> DataFrame:
    """ha, hb, distance with ha < hb: pairs of distinct 64-bit hashes (column ha) up to ``most`` bits apart, each once.

    Two exact ways, of which the cheaper is taken, as measured. Bands: bits that vary are dealt to ``most`` + 1 bands by
    falling entropy, and hashes so close agree in one band at least; its cost is the pairs that meet. Meeting half way: each
    hash sends out itself and all hashes within half of ``most`` bits of it; two meet at some hash between them, where no more
    than those around it come together. Its cost is the hashes sent out; it is what dense hashes need.
    """
    h = F.col("ha")
    bits, n = _varying(kinds)
    banded, pairs = _banded(kinds, bits, most)
    far, close = (most + 1) // 2, most // 2
    sent = n * sum(math.comb(len(bits), k) for k in range(far + 1))
    if pairs <= sent:
        return _met(banded, most)

    def around(least: int, reach: int) -> Column:
        return F.array(*[h.bitwiseXOR(F.lit(_word(c))) for k in range(least, reach + 1) for c in combinations(bits, k)])

    # Of two hashes d bits apart, the one goes half of d, up, and the other the rest: never none and none.
    a, b = kinds.select("ha", F.explode(around(1, far)).alias("at")), kinds.select(h.alias("hb"), F.explode(around(0, close)).alias("at"))
    met = a.join(b.hint("merge"), "at").where("ha <> hb").select(F.least("ha", "hb").alias("ha"), F.greatest("ha", "hb").alias("hb"))
    return _near(met, most)


def _kinds(df: DataFrame, key: str, phash: str) -> tuple[DataFrame, DataFrame]:
    """key, ha of the rows with a hash; ha, n_same, class_id of the distinct hashes."""
    rows = df.where(F.col(phash).isNotNull()).select(F.col(key).alias("key"), F.col(phash).alias("ha"))
    return rows, rows.groupBy("ha").agg(F.count("*").alias("n_same"), F.min("key").alias("class_id"))


def near_hashes(df: DataFrame, key: str, phash: str, most: int) -> DataFrame:
    """a, b, distance with a < b: pairs of 64-bit hashes up to ``most`` bits apart, each named by the smallest key of its rows.

    Rows that share a hash are one class (``hash_classes``), so no pairs are formed among them.
    """
    _, kinds = _kinds(df, key, phash)
    names = kinds.select("ha", "class_id")
    links = hash_links(kinds.select("ha"), most).join(names.withColumnRenamed("class_id", "x"), "ha").join(names.withColumnsRenamed({"ha": "hb", "class_id": "y"}), "hb")
    return links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def _near_counts(kinds: DataFrame, most: int) -> DataFrame:
    """ha, n_same, n_near of the distinct hashes: n_near sums n_same over the others up to ``most`` bits away.

    No pair is formed. Of m bits that vary, let A(d) be the sum over the hashes just d bits away. Each value hands its A(d) to those
    one bit away; what arrives there is (d + 1) A(d + 1) + (m - d + 1) A(d - 1), as of d + 1 bits any may be the last one turned. So each
    bit of distance is one shuffle of m + 1 rows a value, and of values there are 2^m at most. Where bands form fewer pairs, those are linked.
    """
    h = F.col("ha")
    bits, n = _varying(kinds)
    m = len(bits)
    banded, pairs = _banded(kinds, bits, most)
    spread = n
    sent = 0
    for _ in range(most):
        sent += spread * (m + 1)
        spread = min(spread * (m + 1), 1 << m)
    if pairs <= sent:
        links = _met(banded, most)
        both = links.select(F.explode(F.array(F.struct("ha", "hb"), F.struct(F.col("hb").alias("ha"), h.alias("hb")))).alias("p")).select("p.*")
        near = both.join(kinds.select(h.alias("hb"), F.col("n_same").alias("n")), "hb").groupBy("ha").agg(F.sum("n").alias("n_near"))
        return kinds.select("ha", "n_same").join(near, "ha", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    zero = F.lit(0).cast("bigint")
    # before: A(d - 1); at: A(d); near: A(1) + ... + A(d).
    state = kinds.select("ha", "n_same", zero.alias("before"), F.col("n_same").alias("at"), zero.alias("near"))
    for d in range(most):
        own = F.struct(h.alias("ha"), "n_same", (F.col("before") * -(m - d + 1)).alias("x"), F.col("at").alias("before"), "near")
        others = [F.struct(h.bitwiseXOR(F.lit(_word([b]))).alias("ha"), zero.alias("n_same"), F.col("at").alias("x"), zero.alias("before"), zero.alias("near")) for b in bits]
        sums = state.select(F.inline(F.array(own, *others))).groupBy("ha").agg(*[F.sum(c).alias(c) for c in ("n_same", "x", "before", "near")])
        at = F.expr(f"x div {d + 1}")
        state = sums.select("ha", "n_same", "before", at.alias("at"), (F.col("near") + at).alias("near"))
    return state.where("n_same > 0").select("ha", "n_same", F.col("near").alias("n_near"))


def hash_classes(df: DataFrame, key: str, phash: str, most: int) -> DataFrame:
    """key, class_id, n_same, n_near of each row with a 64-bit hash.

    Rows of one hash are a class, named by its smallest key, of n_same rows; n_near counts the rows of other classes up to ``most`` bits
    away. Classes are linked, not rows, so a hash that very many rows share costs what one row does.
    """
    rows, kinds = _kinds(df, key, phash)
    of = _near_counts(kinds, most).join(kinds.select("ha", "class_id"), "ha")
    return rows.join(of, "ha").select(F.col("key").alias(key), "class_id", "n_same", "n_near")


def _pairs_of(a: tuple, b: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of a and of b (keys, first places, sizes), group by group: all pairs of their keys, and the number of the group; a bounded number at once."""
    (a_keys, a_first, _), (b_keys, b_first, b_size) = a, b
    sizes = a[2] * b_size
    ends = np.cumsum(sizes)
    for low in range(0, int(ends[-1]) if len(ends) else 0, PAIR_ROWS):
        high = min(low + PAIR_ROWS, int(ends[-1]))
        group = np.repeat(np.arange(len(ends)), np.clip(ends, low, high) - np.clip(ends - sizes, low, high))
        at, each = np.arange(low, high) - (ends - sizes)[group], b_size[group]
        yield a_keys[a_first[group] + at // each], b_keys[b_first[group] + at % each], group


def _by_hash(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The distinct hashes, and the keys of each as in ``_pairs_of``."""
    order = np.lexsort((keys, hashes))
    kinds, first, size = np.unique(hashes[order], return_index=True, return_counts=True)
    return kinds, (keys[order], first, size)


def _block_pairs(keys: np.ndarray, hashes: np.ndarray, moved: np.ndarray, masks: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
    """a, b, distance of rows of one block (``moved`` 0) with each other and with its visitors; masks and their bits by how far a visitor has moved."""
    kinds, own = _by_hash(keys[moved == 0], hashes[moved == 0])
    for x, y, _ in _pairs_of(own, own):
        yield x[x < y], y[x < y], np.zeros(np.count_nonzero(x < y), np.int32)
    for far, (words, bits) in enumerate(masks):
        others, theirs = (kinds, own) if far == 0 else _by_hash(keys[moved == far], hashes[moved == far])
        step = max(1, HASH_CELLS // max(1, len(words)))
        for low in range(0, len(others) if len(kinds) else 0, step):
            near = others[low : low + step, None] ^ words
            at = np.searchsorted(kinds, near)
            at[at == len(kinds)] = 0
            # Hashes of one block meet twice, from either side.
            met = (kinds[at] == near) & ((near > others[low : low + step, None]) if far == 0 else True)
            which, mask = np.nonzero(met)
            place = at[which, mask]
            for x, y, group in _pairs_of((theirs[0], theirs[1][low + which], theirs[2][low + which]), (own[0], own[1][place], own[2][place])):
                apart = bits[mask[group]]
                # First the pairs that x begins, so that a's runs, then b's, lie together and take little space.
                up, down = x < y, x > y
                yield np.concatenate([x[up], y[down]]), np.concatenate([y[up], x[down]]), np.concatenate([apart[up], apart[down]])


def near_pairs(df: DataFrame, key: str, phash: str, most: int) -> DataFrame:
    """a, b, distance with a < b: all pairs of rows whose 64-bit hashes are up to ``most`` bits apart, by their keys (bigint, each with one hash).

    Two exact ways, as in ``hash_links``. Bands, where few hashes meet in them; their links are joined with the rows. Where hashes are
    dense, some of the bits that vary name a block, and a row goes to its own and to all blocks up to ``most`` bits below it; there the hashes
    around it are looked up among the block's. So every pair is found once, by one of its rows, and none is shuffled. Rows of one hash are in
    one block; their pairs are formed a bounded number at once, but they are as many as the square of the rows.
    """
    rows = df.where(F.col(phash).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(phash).alias("ha")).distinct()
    kinds = rows.select("ha").distinct()
    bits, n = _varying(kinds)
    banded, pairs = _banded(kinds, bits, most)
    if pairs <= n * sum(math.comb(len(bits), k) for k in range(most + 1)):
        links = _met(banded, most).unionByName(kinds.select("ha", F.col("ha").alias("hb"), F.lit(0).alias("distance")))
        both = links.join(rows.withColumnRenamed("key", "x"), "ha").join(rows.select(F.col("key").alias("y"), F.col("ha").alias("hb")), "hb")
        return both.where("x < y or x > y and ha <> hb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")

    own = min(len(bits), max(HASH_BITS, math.ceil(math.log2(n / HASH_ROWS))))
    names, rest = bits[:own], bits[own:]
    block = sum((F.shiftrightunsigned("ha", i).bitwiseAND(1) * (1 << k) for k, i in enumerate(names)), F.lit(0)).cast("int")
    visits = [(c, _word([names[k] for k in c]), sum(1 << k for k in c)) for d in range(most + 1) for c in combinations(range(own), d)]
    sent = rows.withColumn("_b", block).select("key", F.inline(F.array(*[F.struct(F.col("_b").bitwiseXOR(F.lit(name)).alias("block"), F.col("ha").bitwiseXOR(F.lit(word)).alias("ha"), F.lit(len(c)).alias("moved"), "_b") for c, word, name in visits])))
    masks = []
    for far in range(most + 1):
        around = [(_word(c), far + k) for k in range(int(far == 0), most - far + 1) for c in combinations(rest, k)]
        masks.append((np.array([w for w, _ in around], np.int64), np.array([k for _, k in around], np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        blocks, *cols = (np.concatenate([b.column(c).to_numpy() for b in got]) for c in ("block", "key", "ha", "moved"))
        for one in np.unique(blocks):
            for found in _block_pairs(*(c[blocks == one] for c in cols), masks):
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b", "distance"])

    return sent.where("block <= _b").select("block", "key", "ha", "moved").repartitionById(1 << own, "block").mapInArrow(run, "a bigint, b bigint, distance int")
