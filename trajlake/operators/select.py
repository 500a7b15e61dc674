"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajlake.operators.scan import STRETCH_ROWS

#: Relative rank error of the approximate percentiles that bracket an exact one, and how many errors wide a bracket is to each side.
_ACCURACY, _SLACK = 10_000, 5
#: Fewer rows than this are never long: a bracket is to hold several ranks to each side of the one wanted.
_LEAST_LONG = 10_000
#: As many groups as a table of percentiles may have to be broadcast.
BROADCAST_GROUPS = 20_000


def percentiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]], stretch: int = STRETCH_ROWS) -> DataFrame:
    """by and, for each name of ``wanted``, the linear percentile of its column; null and NaN don't count.

    Spark's exact percentile holds all values of a group in one task. Of groups of over ``stretch`` rows, approximate
    percentiles bracket the two values wanted; values in the bracket are counted, those below it only as one, and the ranks
    are looked up among the few distinct values that are left. The results are the same.
    """
    values = {n: F.nanvl(c.cast("double"), F.lit(None).cast("double")) for n, (c, _) in wanted.items()}
    rows = df.select(*by, *[v.alias(n) for n, v in values.items()])
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    long = sizes.where(F.col("_n") > max(stretch, _LEAST_LONG)).select(*by)
    plain = [F.percentile(n, F.lit(p)).alias(n) for n, (_, p) in wanted.items()]
    if long.isEmpty():
        return rows.groupBy(*by).agg(*plain)
    # At most as many groups as the table has stretches.
    few = meet(rows, long, by, "left_anti").groupBy(*by).agg(*plain)
    return few.unionByName(_selected(meet(rows, long, by, "left_semi"), by, {n: p for n, (_, p) in wanted.items()}))


def with_percentiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]], stretch: int = STRETCH_ROWS) -> DataFrame:
    """``df`` with its group's percentiles."""
    found = percentiles(df, by, wanted, stretch)
    return meet(df, found, by, "left", broadcast=len(found.select(F.lit(1)).limit(BROADCAST_GROUPS + 1).collect()) <= BROADCAST_GROUPS)


def meet(df: DataFrame, groups: DataFrame, by: list[str], how: str, broadcast: bool = True) -> DataFrame:
    """``df`` joined with a row per group; null names a group as any value does."""
    named = groups.withColumnsRenamed({c: f"_g_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return df.join(F.broadcast(named) if broadcast else named, on, how).drop(*[f"_g_{c}" for c in by])


def _selected(rows: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    # One row for each value and percentile; a group's brackets are a few numbers.
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("q"), F.lit(float(p)).alias("p"), F.col(n).alias("x")) for n, p in at.items()])).alias("_v")).select(*by, "_v.*").where("x is not null")
    low = high = F.lit(None).cast("double")
    aggs = [F.count("x").alias("_n"), F.min("x").alias("_min"), F.max("x").alias("_max")]
    reach = _SLACK / _ACCURACY
    for i, (n, p) in enumerate(at.items()):
        aggs.append(F.percentile_approx(F.when(F.col("q") == n, F.col("x")), [max(0.0, p - reach), min(1.0, p + reach)], _ACCURACY).alias(f"_a{i}"))
    brackets = long.groupBy(*by, "q").agg(*aggs)
    for i, (n, p) in enumerate(at.items()):
        own = F.col("q") == n
        low = F.when(own, F.col("_min") if p <= reach else F.get(f"_a{i}", F.lit(0))).otherwise(low)
        high = F.when(own, F.col("_max") if p >= 1 - reach else F.get(f"_a{i}", F.lit(1))).otherwise(high)
    brackets = brackets.select(*by, "q", "_n", low.alias("_low"), high.alias("_high"))
    # What lies under the bracket counts as one value, the lowest.
    near = meet(long, brackets, [*by, "q"], "inner").where(F.col("x") <= F.col("_high"))
    counts = near.groupBy(*by, "q", "p", "_n", F.when(F.col("x") >= F.col("_low"), F.col("x")).alias("x")).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*by, "q").orderBy(F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.col("p") * (F.col("_n") - 1)
    ranked = counts.withColumn("_upto", F.sum("_k").over(w)).withColumns({"_lo": F.floor(place), "_hi": F.ceil(place), "_share": place - F.floor(place)})

    def value(rank: str) -> Column:
        here = (F.col("_upto") > F.col(rank)) & (F.col("_upto") - F.col("_k") <= F.col(rank))
        return F.max(F.when(here, F.col("x")))

    found = ranked.groupBy(*by, "q").agg(value("_lo").alias("_a"), value("_hi").alias("_b"), F.first("_share").alias("_s"))
    found = found.withColumn("v", F.when(F.col("_s") == 0, F.col("_a")).otherwise(F.col("_a") * (1 - F.col("_s")) + F.col("_b") * F.col("_s")))
    of = found.groupBy(*by).agg(*[F.max(F.when(F.col("q") == n, F.col("v"))).alias(n) for n in at])
    # A group without any value has its row too.
    return meet(rows.select(*by).distinct(), of, by, "left")
