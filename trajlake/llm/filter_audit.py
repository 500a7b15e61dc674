"""What each filter of a chain removes, in every order of the chain.

A document fails some of five filters: a mask of five bits. What the mask does at each of
the 600 (order, step) places of the 120 orders is a number of 600 fields, one integer of
Python's unbounded kind. Documents of a part are counted by mask first, so that the sum of a part has
at most 32 terms for each kind of label, whatever the part's size; a sum's fields are its counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import UPPER, cut, join_uneven, let

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Bits of a field. A field counts documents, and a bigint counts no more of them than 63 bits do.
FIELD_BITS = 64
COUNTERS = ("kept", "removed", "redundant", "unique_fails")
#: Most documents with copies elsewhere that are met by broadcast: 32 bytes of name and an id each.
BROADCAST_NAMES = 200_000
_SPACE = r"[\x20\x09-\x0D]+"


def packed(mask: int) -> tuple[int, ...]:
    """For each of COUNTERS the integer whose field ``5 * order + step`` says whether a document of ``mask`` counts there."""
    out = dict.fromkeys(COUNTERS, 0)
    for at, order in enumerate(ORDERS):
        gone = False
        for step, name in enumerate(order):
            one = 1 << FIELD_BITS * (5 * at + step)
            own = 1 << FILTERS.index(name)
            fails = bool(mask & own)
            out["redundant"] += one * (fails and gone)
            out["removed"] += one * (fails and not gone)
            out["unique_fails"] += one * (mask == own)
            gone = gone or fails
            out["kept"] += one * (not gone)
    return tuple(out.values())


def unpack(total: int) -> np.ndarray:
    """The 600 fields of a sum."""
    return np.frombuffer(total.to_bytes(600 * FIELD_BITS // 8, "little"), "<u8").astype(np.int64)


def failures(text: Column) -> Column:
    """Bits 0 to 3: whether ``text`` fails A to D; null is the empty text."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE, -1), lambda w: w != "")

    def bits(words: Column) -> Column:
        whole = F.coalesce(text, F.lit(""))
        n, chars = F.size(words), F.length(whole)
        capitals = chars - F.length(F.translate(whole, UPPER, ""))
        tests = [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals.cast("bigint") > 5 * chars.cast("bigint"), whole.rlike("[#$%&*|]")]
        return sum((t.cast("int") * (1 << i) for i, t in enumerate(tests[1:], 1)), tests[0].cast("int"))

    return let(pieces, bits)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of each row of ``docs`` (doc_id, text, source).

    A text is an earlier one's copy (bit 4) if the least id with that text is less than its own. A row without an id is
    no copy and makes none; of rows that repeat an id, none is the other's. An id with several
    labels is good, or toxic, if one of them says so.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), failures(F.col("text")).alias("low"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("name"))
    rows = cut(rows, "failures")
    firsts = cut(rows.where("doc_id is not null").groupBy("name").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1"), "firsts")
    rows = join_uneven(rows, firsts, ["name"], "times", F.xxhash64("doc_id"), BROADCAST_NAMES)
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    rows = rows.select("doc_id", "part", (F.col("low") + copy.cast("int") * 16).alias("mask"))
    says = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(k) for c, k in (("quality", "good"), ("toxic", "bad"))])
    says = says.where("good > 0 or bad > 0")
    # Rows without an id would all meet in one task of the join.
    known = rows.where("doc_id is not null").join(says, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("toxic"))
    return known.unionByName(rows.where("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of documents there: 600 rows for each part.

    ``docs`` has doc_id, text, source; ``labels`` doc_id, quality, toxic. A null source is the part "", a null
    text the empty text. kept: after the step; removed: here; redundant: fail the step's filter, removed before; unique_fails: fail that
    filter only; good_lost, toxic_lost: removed here with that label; shapley: removed by the filter, over all orders and steps.
    Repeated rows count each; an empty table gives no row.
    """
    counts = masks(docs, labels).groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    of_mask = docs.sparkSession.sparkContext.broadcast([dict(zip(COUNTERS, packed(mask), strict=True)) for mask in range(1 << len(FILTERS))])

    def sums(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total, lost = dict.fromkeys(COUNTERS, 0), {"good": 0, "toxic": 0}
        for mask, good, toxic, n in zip(*(map(int, group[c]) for c in ("mask", "good", "toxic", "n")), strict=True):
            own = of_mask.value[mask]
            for c in COUNTERS:
                total[c] += n * own[c]
            lost["good"] += n * good * own["removed"]
            lost["toxic"] += n * toxic * own["removed"]
        out = pd.DataFrame({c: unpack(v) for c, v in total.items()} | {f"{k}_lost": unpack(v) for k, v in lost.items()})
        out.insert(0, "part", key[0])
        out.insert(1, "filter_order", np.repeat(ORDERS, 5))
        out.insert(2, "step", np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS)))
        name = np.array(list("".join(ORDERS)))
        out["shapley"] = out.groupby(name)["removed"].transform("sum")
        return out

    schema = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
    return counts.groupBy("part").applyInPandas(sums, schema)
