"""The prefix trie of conversations that share their first turns, by collapse of whole sequences.

Conversations are rebuilt as rows of turns; a running sum of hashes names each prefix, so texts are
hashed where they are read and never shuffled. Equal whole sequences collapse into one with a
weight; those that no other sequence continues are leaves. All prefixes of the weighted
sequences are then summed up, each row with its sequence's weight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajlake.llm.common import cut, discard, join_uneven

#: A conversation takes under so many turns from its family's first, which is the one whose id ends in two zeros.
MOST_SHARED, FAMILY = 6, 100
#: Ids of one stretch of ends that is joined at once; a list of ends is hashed stretch by stretch.
_STRETCH_BITS = 8
#: 32-bit sums that name a prefix: 256 bits. A sum stays exact for 2^31 turns.
_WORDS = 8
#: Most nodes with children that are met by broadcast: a 32-byte name and two numbers each.
BROADCAST_NODES = 200_000
_EMPTY = hashlib.sha256(b"").hexdigest()


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from its family's first."""
    return (F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED).cast("int")


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, mark, chars of every turn; ``mark`` is a hash of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("mark"), F.length(text).cast("bigint").alias("chars"))
    return rows


def rebuild(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, name, parent, chars, before, last: the prefixes of every rebuilt conversation, the empty one too.

    ``name`` stands for the whole prefix, ``parent`` for the one a turn shorter, ``chars`` counts the last turn's code points and ``before`` those
    of the turns above it; ``last`` says that the conversation ends there.
    """
    turns = cut(_turns(conversations), "turns")
    ids = turns.groupBy("conv_id").agg(F.lit(1).alias("_one")).drop("_one").withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": shared_turns(F.col("conv_id"))})
    order = [F.asc_nulls_first("turn"), "role", "mark"]
    firsts = turns.where(F.col("conv_id") % FAMILY == 0).withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))).where(F.col("at") < MOST_SHARED)
    heads = firsts.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("at", "role", "mark", "chars"))).alias("head"))
    taken = ids.join(heads, "base", "left").select("conv_id", F.explode(F.concat(F.array(_nothing()), F.coalesce(F.filter("head", lambda x: x["at"] <= F.col("h")), F.array().cast("array<struct<at:int,role:string,mark:binary,chars:bigint>>")))).alias("t"))
    kind = turns.schema["turn"].dataType
    rows = taken.select("conv_id", F.when(F.col("t.at") == 0, 0).otherwise(1).alias("kind"), F.col("t.at").alias("at"), F.lit(None).cast(kind).alias("turn"), "t.role", "t.mark", "t.chars")
    rows = rows.unionByName(turns.select("conv_id", F.lit(2).alias("kind"), F.lit(0).alias("at"), "turn", "role", "mark", "chars"))
    # The root first, then what is shared, then the conversation's own turns, of which the first h go.
    w = Window.partitionBy("conv_id").orderBy("kind", "at", *order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"rank": F.row_number().over(w).cast("bigint") - 1, "shared": F.sum((F.col("kind") == 1).cast("int")).over(so_far)})
    h = shared_turns(F.col("conv_id"))
    rows = rows.where((F.col("kind") < 2) | (F.col("rank") - F.col("shared") > h)).withColumn("depth", F.col("rank") - F.when(F.col("kind") == 2, h).otherwise(0))
    half = [F.xxhash64("mark", "depth", F.lit(k)) for k in range(_WORDS // 2)]
    words = [x for h64 in half for x in (F.shiftrightunsigned(h64, 32), h64.bitwiseAND((1 << 32) - 1))]
    sums = [F.sum(F.when(F.col("depth") > 0, x).otherwise(0)).over(so_far) for x in words]
    rows = rows.select("conv_id", "depth", "kind", "at", "turn", "role", "mark", "chars", (F.sum("chars").over(so_far) - F.col("chars")).alias("before"), *[s.alias(f"s{k}") for k, s in enumerate(sums)])
    rows = rows.withColumn("name", F.unhex(F.sha2(F.concat_ws(".", "depth", *[f"s{k}" for k in range(_WORDS)]).cast("binary"), 256)))
    return rows.select("conv_id", "depth", "name", F.lag("name").over(w).alias("parent"), "chars", "before", F.lead("depth").over(w).isNull().alias("last"))


def _nothing() -> Column:
    return F.struct(F.lit(0).alias("at"), F.lit("").alias("role"), F.lit(b"").alias("mark"), F.lit(0).cast("bigint").alias("chars"))


def ends(last: DataFrame) -> DataFrame:
    """name, ends_sha256 of ``last`` (name, conv_id): the hash of each name's ids, ascending, joined by commas.

    Stretches of 256 neighbouring ids are joined first, in parallel; they stream past in order, so no list is
    ever held, however many conversations end at a node.
    """
    stretch = F.shiftright("conv_id", _STRETCH_BITS)
    parts = last.groupBy("name", stretch.alias("stretch")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != name:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["name", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["name", "ends_sha256"])

    return parts.repartition("name").sortWithinPartitions("name", "stretch").mapInArrow(run, "name binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per node of the trie.

    ``conversations`` has conv_id, turn, role, text. A null role or text is empty; turns go by ``turn``, null first, ties
    by role and then by a hash of role and text, so repeated rows are turns each. Rows without a conv_id belong to no
    conversation and are left out. A conversation without turns ends at the root. An empty table gives no node.
    """
    prefixes = cut(rebuild(conversations), "prefixes")
    last = prefixes.where("last")
    whole = last.groupBy("name").agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"), F.max(F.col("before") + F.col("chars")).alias("total"))
    whole = cut(whole, "sequences")
    # A sequence's rows are those of the first conversation that has it.
    rows = cut(prefixes.drop("last").join(whole.select("conv_id", "weight", "total", F.col("name").alias("of")), "conv_id"), "rows")
    continued = rows.where("parent is not null").select(F.col("parent").alias("of")).distinct()
    leaves = cut(whole.select(F.col("name").alias("of")).join(continued, "of", "left_anti").join(whole.select(F.col("name").alias("of"), "conv_id"), "of"), "leaves")
    rows = rows.join(leaves.select("conv_id", F.lit(1).alias("leaf")), "conv_id", "left")
    spent = F.col("weight") * (F.col("total") - F.col("before"))
    nodes = rows.groupBy("name").agg(
        F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("before").alias("before"), F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.min(F.when(F.col("leaf") == 1, F.col("conv_id"))).alias("owner"), F.sum(spent).alias("spent"),
    )
    nodes = cut(nodes, "nodes")
    # Each node counts once below its ancestors: for its owner, the first leaf beneath it. An owner's nodes are the lower end of its path.
    own = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min_by("before", "depth").alias("start"))
    once = rows.where("leaf = 1").join(own, "conv_id").groupBy("name").agg(F.sum(F.col("total") - F.greatest("before", "start")).alias("once"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(once, "name").join(children, "name", "left").join(ends(last.select("name", "conv_id")), "name", "left"), "nodes")
    above = nodes.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("times"))
    out = join_uneven(nodes, above, ["parent"], "times", F.xxhash64("name"), BROADCAST_NODES)
    discard(prefixes)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), F.col("n_leaves").cast("bigint").alias("n_leaves"), (F.col("spent") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
