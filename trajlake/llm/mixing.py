"""Mixing sources to target weights by pivotal dependent rounding.

Every document wants ``target / source size`` copies, a number from 0 to 2. Its
whole part is settled at once. Fractions meet in pairs: mass moves from one
document to the other, by a coin whose bias keeps both expectations, until one
of the two is 0 or 1; the words in play stay the same. What remains of a group is
one fraction, which meets those of other groups further up, in a tree of bounded
fan-in, until one document of a source is left over. So a source's words miss
its target by less than the size of one document.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajlake.llm.common import WORD, cut, uniform

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
FAN_IN = 96
SEED = 20240229
#: As many sources as may be broadcast: a row of them takes under 200 bytes.
BROADCAST_SOURCES = 20_000
_ITEM = "struct<doc_id:{id},size:bigint,copies:int,p:double>"


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, n, target: ``share`` of all sizes by weight, none above ``most`` times its source.

    Weights repeat along the sources in code-point order, null last. Water filling:
    in order of cap over weight, sources fill up until the level that the rest share
    lies below the next one's cap.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights))
    caps = sums.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * share
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    levels = caps.withColumn("level", level)
    chosen = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)
    out = levels.withColumn("at", chosen["level"])
    return out.select("source", "source_size", "n", F.least("cap", F.coalesce(F.col("at") * F.col("w"), F.col("cap"))).alias("target"))


def _meet(acc: Column, x: Column, height: int, seed: int, drawn_by) -> Column:
    """The pivotal step between the fraction that is carried along and the next one."""
    cur = acc["cur"]
    p1, s1, p2, s2 = cur["p"], cur["size"].cast("double"), x["p"], x["size"].cast("double")
    up = F.least((1 - p1) * s1, p2 * s2)  # words that may move to the carried document
    down = F.least(p1 * s1, (1 - p2) * s2)  # and away from it
    gains = uniform(drawn_by(cur["doc_id"]), drawn_by(x["doc_id"]), cur["size"], x["size"], F.lit(height), F.lit(seed)) * (up + down) < down

    def item(y: Column, p: Column, extra: Column | int = 0) -> Column:
        return F.struct(y["doc_id"].alias("doc_id"), y["size"].alias("size"), (y["copies"] + extra).cast("int").alias("copies"), p.alias("p"))

    def state(carried: Column, settled: Column) -> Column:
        return F.struct(carried.alias("cur"), F.concat(acc["out"], F.array(settled)).alias("out"))

    zero = F.lit(0.0)
    first_full = state(item(x, p2 - (1 - p1) * s1 / s2), item(cur, zero, 1))
    second_empty = state(item(cur, p1 + p2 * s2 / s1), item(x, zero))
    first_empty = state(item(x, p2 + p1 * s1 / s2), item(cur, zero))
    second_full = state(item(cur, p1 - (1 - p2) * s2 / s1), item(x, zero, 1))
    step = F.when(gains, F.when((1 - p1) * s1 <= p2 * s2, first_full).otherwise(second_empty)).otherwise(
        F.when(p1 * s1 <= (1 - p2) * s2, first_empty).otherwise(second_full)
    )
    return F.when(cur.isNull(), F.struct(x.alias("cur"), acc["out"].alias("out"))).otherwise(step)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, fan_in: int = FAN_IN, seed: int = SEED, drawn_by=lambda key: key) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``size`` counts the words of the text (null: none); ``taken`` is ``copies * size``,
    with ``copies`` from 0 to ``most``. A document without words takes 0 words. The
    outcome depends on ids, sizes and ``seed`` alone, so reruns agree. Rows that repeat an id are documents of
    their own. The id may be a struct; ``drawn_by`` gives what of it decides. An empty table gives an empty result; other columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spec = _ITEM.format(id=kind)
    size = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))).cast("bigint")
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size")), "sizes")
    targets = cut(source_targets(sized, weights, share, most), "targets")
    n_sources, most_docs = targets.agg(F.count("*"), F.max("n")).first()
    side = targets.withColumnRenamed("source", "of")
    if n_sources <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(side, F.col("source").eqNullSafe(F.col("of"))).withColumn("want", F.least(want, F.lit(float(most))))
    rows = rows.select("source", "source_size", "target", "n", "doc_id", "size", F.floor("want").cast("int").alias("copies"), (F.col("want") - F.floor("want")).alias("p"))

    keys = ["source", "source_size", "target"]
    settled = [rows.where("size = 0 or p < 1e-12").select(*keys, "doc_id", "size", "copies")]
    open_ = rows.where("size > 0 and p >= 1e-12")
    groups, height = F.ceil(F.col("n") / fan_in), 0
    left = ceil((most_docs or 1) / fan_in)
    while True:
        group = F.pmod(F.xxhash64(drawn_by(F.col("doc_id")), "size", F.lit(seed + height)), F.col("groups"))
        dealt = open_.withColumn("groups", groups).withColumn("slot", group)
        lists = dealt.groupBy(*keys, "groups", "slot").agg(F.array_sort(F.collect_list(F.struct("doc_id", "size", "copies", "p"))).alias("items"))
        start = F.struct(F.lit(None).cast(spec).alias("cur"), F.expr(f"cast(array() as array<{spec}>)").alias("out"))
        h = height
        folded = cut(lists.select(*keys, "groups", F.aggregate("items", start, lambda acc, x: _meet(acc, x, h, seed, drawn_by)).alias("s")), "fold")
        settled.append(folded.select(*keys, F.explode("s.out").alias("o")).select(*keys, "o.doc_id", "o.size", "o.copies"))
        rest = folded.select(*keys, F.col("groups").alias("n"), "s.cur.*")
        height += 1
        if left == 1:
            last = F.col("copies") + (uniform(drawn_by(F.col("doc_id")), F.col("size"), F.lit(seed - 1)) < F.col("p")).cast("int")
            settled.append(rest.select(*keys, "doc_id", "size", last.alias("copies")))
            break
        whole = (F.col("p") < 1e-12) | (F.col("p") > 1 - 1e-12)
        settled.append(rest.where(whole).select(*keys, "doc_id", "size", (F.col("copies") + F.round("p").cast("int")).alias("copies")))
        open_ = rest.where(~whole)
        left = ceil(left / fan_in)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionAll(more)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))
