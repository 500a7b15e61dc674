"""Document fingerprints by a threshold-scaled sketch.

Of a text's shingles, every hash below a fixed fraction of the hash range is
kept, and no other. So sketches merge by union, and what two of them share, over the
smaller of them, estimates how much of the smaller document the larger
contains, however unequal they are. A text too short for that fraction is cut at twice the fraction, or at the whole range,
and its fingerprint says so: two sketches are compared below the lower of their limits, and nothing but the
two fingerprints is needed for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajlake.llm.common import let

SHINGLE_WORDS = 5
#: One of so many hashes is kept: 2^SCALE_BITS of them.
SCALE_BITS = 2
#: Hashes that a sketch holds at least, by a wider limit, or all that the text has.
LEAST = 8
_BITS = 40
#: Ranges of ids at most: their bounds are part of the plan.
_MOST_RANGES = 1 << 14


def hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Hashes (40 bits each) of all word shingles of the text, in its order; null counts as empty.

    Fewer words than a shingle has make one shingle.
    """
    mask = F.lit((1 << _BITS) - 1)

    def each(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]).bitwiseAND(mask))
        return F.when(n == 0, w).when(n < words, F.array(F.xxhash64(w).bitwiseAND(mask))).otherwise(runs)

    split = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return let(F.transform(split, lambda x: F.xxhash64(x)), each)


def _limit(level: Column) -> Column:
    return F.call_function("shiftright", F.lit(1 << _BITS), level)


def sketch(text: Column, words: int = SHINGLE_WORDS, scale_bits: int = SCALE_BITS) -> Column:
    """level, kept: the sorted distinct hashes of the text's word shingles below a 2^level-th of the range.

    The level is ``scale_bits``, or the highest one under it that keeps LEAST hashes, or 0, which keeps all.
    """

    def cut_at(every: Column) -> Column:
        level = F.lit(0)
        for k in range(1, scale_bits + 1):
            under = F.lit((1 << _BITS) >> k)
            level = F.when(F.get(every, F.lit(LEAST - 1)) < under, F.lit(k)).otherwise(level)
        return let(level, lambda k: F.struct(k.alias("level"), F.filter(every, lambda x: x < _limit(k)).alias("kept")))

    return let(F.array_sort(F.array_distinct(hashes(text, words))), cut_at)


def _below(a: Column, b: Column) -> Column:
    """What ``a`` has below the lower limit of both."""
    return F.filter(a["kept"], lambda x: x < _limit(F.greatest(a["level"], b["level"])))


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together, below the lower limit of both."""
    return F.struct(F.greatest(a["level"], b["level"]).alias("level"), F.array_sort(F.array_union(_below(a, b), _below(b, a))).alias("kept"))


def fingerprint(of: Column) -> Column:
    """A sketch as text: its level, then ten hexadecimal digits a hash."""
    return F.concat(of["level"].cast("string"), F.array_join(F.transform(of["kept"], lambda x: F.lpad(F.lower(F.hex(x)), _BITS // 4, "0")), ""))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other has, both below the lower limit; 1 for two equal sketches, 0 if only one is empty there."""
    both = F.struct(_below(a, b).alias("a"), _below(b, a).alias("b"))

    def share(w: Column) -> Column:
        small = F.least(F.size(w["a"]), F.size(w["b"]))
        return F.when(small > 0, F.size(F.array_intersect(w["a"], w["b"])) / small).otherwise(((a["level"] == b["level"]) & (F.size(a["kept"]) == F.size(b["kept"]))).cast("double"))

    return let(both, share)


def _buckets(ids: DataFrame, n: int) -> tuple[list, int]:
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    return sorted(set(cuts or [])), n


def with_next(docs: DataFrame, value_cols: list[str], id_col: str = "doc_id", derive=lambda df: df) -> DataFrame:
    """``docs`` with ``next_<col>``: the values of the next row by ascending id; after the last comes the first.

    Ids are cut into ranges of about equal row counts, each a group of one window. The
    first row of a range also stands at the end of the range before, so that no
    range needs another one. ``derive`` adds columns to the rows before they meet.
    """
    spark = docs.sparkSession
    want = min(_MOST_RANGES, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col(id_col).alias("doc_id"))
    cuts, _ = _buckets(ids, want)
    step = max(1, int(len(cuts) ** 0.5))
    coarse = F.array(*[F.lit(x) for x in cuts[::step]]).cast("array<bigint>")
    fine = F.array(*[F.array(*[F.lit(x) for x in cuts[i : i + step]]) for i in range(0, len(cuts), step)]) if cuts else None

    def bucket(i: Column) -> Column:
        if not cuts:
            return F.lit(0)
        high = F.size(F.filter(coarse, lambda c: c <= i))
        return F.coalesce(F.when(high == 0, F.lit(0)).otherwise((high - 1) * step + F.size(F.filter(F.get(fine, high - 1), lambda c: c <= i))), F.lit(0))

    # Of each range that has rows: its first id, and the range before it (a wrap for the first).
    heads = ids.groupBy(bucket(F.col("doc_id")).alias("b")).agg(F.min("doc_id").alias("head"))
    order = Window.orderBy("b")
    heads = heads.withColumn("into", F.coalesce(F.lag("b").over(order), F.max("b").over(Window.partitionBy()))).select("head", "into")
    rows = docs.withColumn("_b", bucket(F.col(id_col))).withColumn("_tail", F.lit(0))
    tails = docs.join(F.broadcast(heads), F.col(id_col).eqNullSafe(F.col("head"))).withColumn("_b", F.col("into")).withColumn("_tail", F.lit(1)).drop("head", "into")
    w = Window.partitionBy("_b").orderBy("_tail", id_col, *value_cols[:1])
    nexts = [F.lead(c).over(w).alias(f"next_{c}") for c in value_cols]
    return derive(rows.unionByName(tails)).select("*", *nexts).where("_tail = 0").drop("_b", "_tail")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, scale_bits: int = SCALE_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_kept.

    The edited text has the last quarter (rounded down) of the code points replaced by
    the first as many of the next document, or all of it. Null counts as empty. With
    one document the next is itself. An empty table gives an empty result; rows that
    repeat an id follow each other, in order of their texts; other columns aren't read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(base, ["text", "kept"], derive=lambda df: df.withColumn("kept", sketch(F.col("text"), words, scale_bits)))
    n = F.char_length("text")
    tail = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - tail), F.substring(F.col("next_text"), F.lit(1), tail))
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited", edited).withColumn("edited_kept", sketch(F.col("edited"), words, scale_bits))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("kept")).alias("fingerprint"),
        fingerprint(F.col("edited_kept")).alias("edited_fingerprint"),
        containment(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
        containment(F.col("kept"), F.col("next_kept")).alias("near_next"),
        F.size("kept.kept").alias("n_kept"),
    )
