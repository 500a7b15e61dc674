"""Sampling within groups, and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _rank(by: list[str], *order):
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def even_sample(df: DataFrame, n: int, by: list[str], order: str) -> DataFrame:
    """``n`` rows at positions trunc(k * (m - 1) / (n - 1)) of each group of m; all if m <= n; the first if n = 1."""
    ranked = df.withColumn("_k", _rank(by, order) - 1).withColumn("_m", F.count("*").over(Window.partitionBy(*by)))
    if n == 1:
        keep = F.col("_k") == 0
    else:
        # The least k whose position reaches this row; the row is in if k's position is just this one.
        k = F.expr(f"((_k * {n - 1} + _m - 2) div greatest(_m - 1, 1))")
        ranked = ranked.withColumn("_at", k)
        keep = (F.col("_m") <= n) | ((F.col("_at") < n) & (F.expr(f"(_at * (_m - 1)) div {n - 1}") == F.col("_k")))
    return ranked.where(keep).drop("_k", "_m", "_at")


def stride_sample(df: DataFrame, most: int, by: list[str], order: str, first: int | None = None) -> DataFrame:
    """Every max(1, m div most)-th row of each group of m, and at most ``first`` of them."""
    ranked = df.withColumn("_k", _rank(by, order) - 1).withColumn("_m", F.count("*").over(Window.partitionBy(*by)))
    step = F.expr(f"greatest(1, _m div {most})")
    keep = F.col("_k") % step == 0
    if first is not None:
        keep = keep & (F.col("_k") < step * first)
    return ranked.where(keep).drop("_k", "_m")


def seeded_cap(df: DataFrame, n: int, seed: int, by: list[str], key: str) -> DataFrame:
    """``n`` rows of each group at most, drawn by md5 of ``key`` and ``seed``, which any engine repeats.

    Rows that share a key share a draw and come together, as far as ``n`` goes. A group of m rows is counted by m / n ranges of the
    draw; only rows up to the range that fills ``n`` are ranked, so that no group is sorted whole.
    """
    counts = df.groupBy(*by).agg(F.count("*").alias("_m"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), 1, 10), 16, 10).cast("bigint")
    # 2^40 draws; the ranges of a group are as wide as hold n rows, if keys are distinct.
    width = F.expr(f"greatest(1, {1 << 40} div greatest(1, _m div {max(n, 1)}))")
    drawn = _meet(df.withColumn("_h", draw), counts, by).withColumn("_range", F.floor(F.col("_h") / width))
    sizes = drawn.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    enough = sizes.withColumn("_before", before).where(F.col("_before") < n).groupBy(*by).agg(F.max("_range").alias("_last"))
    near = _meet(drawn, enough, by).where(F.col("_range") <= F.col("_last"))
    return near.withColumn("_k", _rank(by, "_h", key)).where(F.col("_k") <= n).select(*df.columns)


def _meet(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with its group's columns; null names a group as any value does."""
    named = groups.withColumnsRenamed({c: f"_g_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return df.join(named, on).drop(*[f"_g_{c}" for c in by])


def head(df: DataFrame, n: int, by: list[str], order: str) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("_k", _rank(by, order)).where(F.col("_k") <= n).drop("_k")


def union_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of either, once."""
    return a.unionByName(b).distinct()


def ids_ignored(seen: Column, chosen: Column) -> Column:
    """Ids seen minus the chosen one, sorted."""
    return F.array_sort(F.array_except(seen, F.array(chosen)))


def concat_clouds(*clouds: DataFrame) -> DataFrame:
    """All rows of all clouds."""
    out = clouds[0]
    for more in clouds[1:]:
        out = out.unionByName(more)
    return out


def distinct_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.dropDuplicates([a, b])


def scored_clips(run: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Clips of the run that the truth has too."""
    return run.join(truth.select(*keys).distinct(), keys, "left_semi")


def usable_frames(poses: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """Names in both the reconstruction and the observations."""
    return poses.select(*keys).intersect(observations.select(*keys))
