"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of characters. The distinct blocks are
sorted, and each gets an integer of its own, by its range and its place there; then neighbouring pairs of
integers are named in the same way, until each document is down to one integer.
Names come from comparisons of the blocks themselves, so two documents share an
identity only if their texts are the same: there is nothing to collide.

A 64-bit hash serves to leave out work, never to merge: a block whose hash
occurs once in the corpus has no equal, and neither has a document that holds
such a block. Blocks with a repeated hash are compared in full.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import ascii_lower, cut, join_uneven

BLOCK_CHARS = 2048
#: Leading characters of blocks that go first in their order: what the driver samples of them for ranges is small.
_RANGE_CHARS = 64


def _named(values: DataFrame, tag: str) -> DataFrame:
    """Distinct rows of ``values`` with ``times``, how often they occur, and ``name``: an integer of each row's own.

    Strings are sorted by their leading characters, then by a hash, so that many with one
    beginning don't share a range, then as a whole.
    """
    order = [x for c, kind in values.dtypes for x in ([F.substring(F.col(c), 1, _RANGE_CHARS), F.xxhash64(c)] if kind == "string" else [F.col(c)])]
    ranked = values.groupBy(*values.columns).agg(F.count("*").alias("times")).repartitionByRange(*order).sortWithinPartitions(*order, *values.columns)
    return cut(ranked.withColumn("name", F.monotonically_increasing_id()), tag)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, normalise=ascii_lower) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if ``normalise(text)`` is (default: A-Z lower-cased; null counts
    as empty, so null and empty texts form one group). Of equal texts the row with
    the largest id stays; where rows repeat one id and one text, one of them. A null
    id is smaller than any other. Other columns of ``docs`` aren't read. An empty
    table gives an empty result.
    """
    norm: Column = normalise(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    pieces = F.greatest(F.ceil(F.char_length("norm") / block_chars), F.lit(1)).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("norm"), i * block_chars + 1, F.lit(block_chars)))

    def blocks(df: DataFrame) -> DataFrame:
        return df.withColumn("n", pieces).select("*", F.posexplode(each).alias("pos", "block")).withColumn("h", F.xxhash64("block"))

    repeated = cut(blocks(texts.select("norm")).groupBy("h").agg(F.count("*").alias("times")).where("times > 1"), "repeated")
    numbered = texts.withColumn("rid", F.monotonically_increasing_id())
    rows = blocks(numbered).select("rid", "doc_id", "n", "pos", "block", "h", F.when(F.col("pos") == 0, F.sha2("norm", 256)).alias("sha"))
    place = F.xxhash64("rid", "pos")
    met = join_uneven(rows, repeated, ["h"], "times", place)
    first = cut(met.select("rid", "doc_id", "n", "pos", "sha", F.expr("if(times > 1, block, null)").alias("block")), "blocks")

    alone = first.where("block is null").select("rid").distinct()
    todo = first.where("block is not null").join(alone, "rid", "left_anti").select("rid", "n", "pos", "block")
    level = join_uneven(todo, _named(first.where("block is not null").select("block"), "names"), ["block"], "times", place)
    level = cut(level.select("rid", "n", "pos", "name"), "level")
    most = level.agg(F.max("n")).first()[0] or 1

    done = [level.where("n = 1").select("rid", F.lit(0).alias("height"), "name")]
    for height in range(1, ceil(log2(most)) + 1):
        even = F.col("pos") % 2 == 0
        pairs = (
            level.where("n > 1").groupBy("rid", "n", F.floor(F.col("pos") / 2).cast("int").alias("half"))
            .agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"))
        )
        pairs = cut(pairs, "pairs")
        level = join_uneven(pairs, _named(pairs.select("a", "b"), "names"), ["a", "b"], "times", F.xxhash64("rid", "half"))
        level = level.select("rid", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("half").alias("pos"), "name")
        level = cut(level, "level")
        done.append(level.where("n = 1").select("rid", F.lit(height).alias("height"), "name"))
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionAll(more)

    own = first.where("pos = 0").select("rid", "doc_id", "sha")
    copies = cut(identity.join(own.select("rid", "doc_id"), "rid"), "identity")
    groups = cut(copies.groupBy("height", "name").agg(F.max(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    found = join_uneven(copies, groups, ["height", "name"], "group_size", F.xxhash64("rid")).where("group_size > 1")
    found = found.select("rid", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "group_size")
    return own.join(found, "rid", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
