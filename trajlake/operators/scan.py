"""Running values along sequences of any length.

A window function sorts a whole sequence in one task. A scan cuts the few sequences that are longer than a stretch
into parts by ranges of their order, runs the window in each part, and hands on what a part needs of those
beside it: one row a part, which a small table of all parts' ends supplies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Rows of one sequence that a single task may scan; longer ones are cut.
STRETCH_ROWS = 1_000_000
#: Quantiles of the order that a long sequence is cut at; between two of them it is cut evenly.
_CUTS = 64
_PART, _AT = "_part", "_in_part"


class Scan:
    """``df`` along ``order`` within ``by``, ties of the first order column by the others.

    Each method adds columns and returns the scan; ``df`` is the result so far, ``done()`` the result
    without what the scan has added for itself. Rows without a value in the first order column come first.
    """

    def __init__(self, df: DataFrame, by: list[str], order: str | list[str], stretch: int = STRETCH_ROWS):
        self.by, self.order = list(by), [order] if isinstance(order, str) else list(order)
        self.names, self.serial = df.columns, 0
        first = self.order[0]
        sizes = df.groupBy(*self.by).agg(F.count("*").alias("_n"))
        # At most as many as the table has stretches.
        long = sizes.where(F.col("_n") > stretch)
        self.cut = not long.isEmpty()
        if self.cut:
            at = F.col(first).cast("double") if df.schema[first].dataType.simpleString() != "double" else F.col(first)
            steps = [k / _CUTS for k in range(_CUTS + 1)]
            edges = self._with(df, long).withColumn(_AT, at).groupBy(*self.by).agg(F.percentile_approx(_AT, steps).alias("_edges"), F.ceil(F.first("_n") / (_CUTS * stretch)).alias("_split"))
            df = self._with(df.withColumn(_AT, at), edges, "left")
            bin_ = F.size(F.filter(F.slice("_edges", 2, _CUTS - 1), lambda e: e < F.col(_AT)))
            low, high = F.get("_edges", F.col("_bin")), F.get("_edges", F.col("_bin") + 1)
            share = F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(_AT) - low) / (high - low)))).otherwise(0.0)
            within = F.least(F.floor(share * F.col("_split")), F.col("_split") - 1)
            df = df.withColumn("_bin", bin_).withColumn(_PART, F.when(F.col("_edges").isNull(), 0).otherwise(F.coalesce(F.col("_bin") * F.col("_split") + within, F.lit(-1))).cast("bigint"))
            df = df.withColumn("_long", F.col("_edges").isNotNull()).drop("_bin", "_edges", "_split", _AT)
        self.df = df

    def _with(self, df: DataFrame, few: DataFrame, how: str = "inner") -> DataFrame:
        """``df`` joined with ``few``, which holds rows of long sequences' stretches only; a null key meets itself."""
        few = few.withColumnsRenamed({c: f"_k_{c}" for c in self.by})
        on = F.lit(True)
        for c in self.by:
            on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        return df.join(F.broadcast(few), on, how).drop(*[f"_k_{c}" for c in self.by])

    def _window(self, back: bool) -> WindowSpec:
        keys = [*self.by, _PART] if self.cut else self.by
        return Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) if back else F.asc_nulls_first(c) for c in self.order])

    def _carry(self, ends: list[Column], carry, back: bool) -> DataFrame:
        """The parts of long sequences with ``ends`` of each and ``carry`` of those before it."""
        parts = self.df.where("_long").groupBy(*self.by, _PART).agg(*ends)
        beside = Window.partitionBy(*self.by).orderBy(F.desc(_PART) if back else F.asc(_PART)).rowsBetween(Window.unboundedPreceding, -1)
        return parts.select(*self.by, F.col(_PART).alias("_of"), *carry(beside))

    def _meet(self, carried: DataFrame) -> None:
        few = carried.withColumnsRenamed({c: f"_k_{c}" for c in self.by})
        on = F.col(_PART) == F.col("_of")
        for c in self.by:
            on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        self.df = self.df.join(F.broadcast(few), on & F.col("_long"), "left").drop("_of", *[f"_k_{c}" for c in self.by])

    def _position(self, back: bool) -> Column:
        """What orders rows within a part, for aggregates; null order values sort lowest, as they do in the windows."""
        return F.struct(*[x for c in self.order for x in (F.col(c).isNotNull(), F.col(c))])

    def _nearest(self, values: dict[str, Column], back: bool) -> Scan:
        # Values that hold are columns first: an end is the last of them in its part.
        self.df = self.df.withColumns({f"_v_{n}": v for n, v in values.items()})
        here = self._window(back).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if self.cut:
            pick = F.min_by if back else F.max_by
            ends = [pick(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), self._position(back))).alias(f"_e_{n}") for n in values]
            self._meet(self._carry(ends, lambda w: [F.last(f"_e_{n}", ignorenulls=True).over(w).alias(f"_c_{n}") for n in values], back))
            self.df = self.df.withColumns({n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(here), F.col(f"_c_{n}")) for n in values}).drop(*[f"_c_{n}" for n in values])
        else:
            self.df = self.df.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(here) for n in values})
        self.df = self.df.drop(*[f"_v_{n}" for n in values])
        return self

    def last(self, **values: Column) -> Scan:
        """The last value that isn't null up to each row, its own included."""
        return self._nearest(values, False)

    def next(self, **values: Column) -> Scan:
        """The first value that isn't null from each row on, its own included."""
        return self._nearest(values, True)

    def total(self, **values: Column) -> Scan:
        """Sums of the values up to each row, its own included; null counts as nothing."""
        here = self._window(False).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.df = self.df.withColumns({f"_v_{n}": F.coalesce(v, F.lit(0)) for n, v in values.items()})
        sums = {n: F.sum(f"_v_{n}").over(here) for n in values}
        if self.cut:
            self._meet(self._carry([F.sum(f"_v_{n}").alias(f"_e_{n}") for n in values], lambda w: [F.sum(f"_e_{n}").over(w).alias(f"_c_{n}") for n in values], False))
            sums = {n: s + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n, s in sums.items()}
        self.df = self.df.withColumns(sums).drop(*[f"_{x}_{n}" for n in values for x in "vc"])
        return self

    def _beside(self, values: dict[str, Column], back: bool) -> Scan:
        w = self._window(back)
        self.df = self.df.withColumns({f"_v_{n}": F.struct(v.alias("x")) for n, v in values.items()})
        near = {n: F.lag(f"_v_{n}").over(w) for n in values}
        if self.cut:
            pick = F.min_by if back else F.max_by
            ends = [pick(f"_v_{n}", self._position(back)).alias(f"_e_{n}") for n in values]
            self._meet(self._carry(ends, lambda b: [F.last(f"_e_{n}", ignorenulls=True).over(b).alias(f"_c_{n}") for n in values], back))
            near = {n: F.coalesce(x, F.col(f"_c_{n}")) for n, x in near.items()}
        self.df = self.df.withColumns({n: x["x"] for n, x in near.items()}).drop(*[f"_{x}_{n}" for n in values for x in "vc"])
        return self

    def previous(self, **values: Column) -> Scan:
        """The values of the row before; null at the first."""
        return self._beside(values, False)

    def following(self, **values: Column) -> Scan:
        """The values of the row after; null at the last."""
        return self._beside(values, True)

    def add(self, **values: Column) -> Scan:
        """Columns computed row by row."""
        self.df = self.df.withColumns(values)
        return self

    def done(self, *more: str) -> DataFrame:
        """The given columns, as they are now, and ``more``."""
        return self.df.select(*self.names, *more)
