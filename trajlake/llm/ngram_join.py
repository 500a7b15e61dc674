"""N-gram Jaccard join by signature trees.

Two sets can only be as similar as asked if they share one of the first few
elements of each under any fixed order of all elements, so documents meet in the
groups of their first elements. The order puts what a sample shows to be common last; where
a group is crowded all the same, the documents in it have all of their elements counted, and
elements that crowd them move back, the more the later. The smaller of two similar sets even holds
a shared one among fewer elements still; a group without such a member is left out. In a group
trees are built over its documents:
a node holds the OR and the AND of the token bitmaps below it and the range of their
sizes. Pairs of nodes are followed down both sides, and dropped as soon as the
largest overlap that the bitmaps and sizes leave possible is too small; what
arrives at two documents is compared exactly. Bitmaps grow with the set, so long sets are told apart
as well as short ones: one to two bits an element tell those who share nothing else, four to eight the rest.

Documents with one set are one class from the start. Of a group, only members that
the bound leaves a partner go on. Then come rounds: each class is compared within
a single group, drawn anew in every round, and what is found joins components; a round
looks only at groups that still hold several components. What is still
mixed after them goes through the trees once more, only at pairs across components, so
that a large group of near copies costs no pair for each two of
them. A group too large for a task is cut into chunks of alike components, and
pairs of chunks go down their trees in tasks of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajlake.llm.common import cut, discard, join_uneven, short_batches
from trajlake.llm.components import merged

#: Members of a group, or of a chunk, that one task compares.
GROUP = 256
#: Documents of a large group that each of its chunks is compared with in a round.
PIVOTS = 8
#: Share of the documents whose elements are counted for the first order, the same at every size. It decides how large groups are, never what is found.
ORDER_SHARE = 1 / 12
_COMMON, _MOST_COMMON = 4, 400_000
#: Rounds at most before the trees look at all that is still mixed.
ROUNDS = 3
#: Bits of the smallest and the largest bitmap.
_LEAST_BITS, _MOST_BITS = 1 << 9, 1 << 18
_FANOUT = 8
_HELD = 150_000
#: Bytes of bitmaps that a step compares, and that a task holds, at once.
_STEP_BYTES, _HELD_BYTES = 1 << 22, 1 << 24
#: As many ids as may be broadcast, of 8 bytes each.
BROADCAST_IDS = 500_000


class _Hashes(dict):
    """64-bit hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: str | None, words: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, A-Z lower-cased; with fewer words, of all of them."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.int64)
    if len(found) < words:
        # Another seed than for full shingles, as the lengths differ.
        return np.array([known[b" ".join(found)] ^ 0x5851F42D4C957F2D], np.uint64).astype(np.int64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = len(h) - words + 1
    x = np.zeros(n, np.uint64)
    for k in range(words):
        x = (x ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return np.unique((x * np.uint64(0xBF58476D1CE4E5B9) ^ x >> np.uint64(32)).astype(np.int64))


def bitmap(elements: np.ndarray, each: int = 4) -> bytes:
    """From ``each`` to twice as many bits for each element, a power of two of them; the lower half of a size is the OR of its halves."""
    size = min(_MOST_BITS, max(_LEAST_BITS, 1 << int(max(each * len(elements), 2) - 1).bit_length()))
    bits = np.zeros(size, bool)
    bits[elements & (size - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def required(n: int, percent: int) -> int:
    """The least overlap that a set of ``n`` needs with any similar one."""
    return -(-percent * n // 100)


def may_link(some: np.ndarray, every: np.ndarray, low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets below nodes ``a`` and ``b`` can be similar, given OR and AND bitmaps and size ranges of nodes."""
    most = np.minimum(high[a], high[b])
    most = np.minimum(most, high[a] - np.bitwise_count(every[a] & ~some[b]).sum(1, dtype=np.int64))
    most = np.minimum(most, high[b] - np.bitwise_count(every[b] & ~some[a]).sum(1, dtype=np.int64))
    # overlap / (n + m - overlap) >= percent / 100 for the smallest n, m of the two nodes
    return (100 + percent) * most >= percent * (low[a] + low[b])


class Tree:
    """Levels of nodes, leaves first: OR and AND bitmaps, size ranges, component and side (-1: several)."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray, sides: np.ndarray):
        self.levels = [(bits, bits, sizes, sizes, labels, sides)]
        while len(self.levels[-1][0]) > 1:
            some, every, low, high, *marks = self.levels[-1]
            at = np.arange(0, len(some), _FANOUT)
            one = [np.where(np.minimum.reduceat(x, at) == np.maximum.reduceat(x, at), x[at], -1) for x in marks]
            self.levels.append((np.bitwise_or.reduceat(some, at), np.bitwise_and.reduceat(every, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), *one))

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaf pairs i < j of different components and sides that may be similar: both sides descend together."""
        step = max(64, _STEP_BYTES // (8 * self.levels[0][0].shape[1]))
        i = j = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            some, every, low, high, label, side = self.levels[depth]
            if depth < len(self.levels) - 1:
                kids = np.arange(_FANOUT)
                i, j = (x.ravel() for x in np.broadcast_arrays(i[:, None, None] * _FANOUT + kids[:, None], j[:, None, None] * _FANOUT + kids))
                use = (i < len(some)) & (j < len(some)) & (i <= j)
                i, j = i[use], j[use]
            keep = ~((label[i] == label[j]) & (label[i] >= 0)) & ~((side[i] == side[j]) & (side[i] >= 0))
            keep &= (100 + percent) * np.minimum(high[i], high[j]) >= percent * (low[i] + low[j])
            if not depth:
                keep &= i < j
            i, j = i[keep], j[keep]
            keep = np.zeros(len(i), bool)
            for at in range(0, len(i), step):
                keep[at : at + step] = may_link(some, every, low, high, i[at : at + step], j[at : at + step], percent)
            i, j = i[keep], j[keep]
        return i, j


def candidates(bits: list[bytes], sizes: np.ndarray, labels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different labels (from 0 on) that sizes and bitmaps leave possible; sets come in order of size.

    Sets with bitmaps of one length share a tree; those of two lengths meet in one more, over the shorter length.
    """
    lengths = np.array([len(x) for x in bits])
    kinds = np.unique(lengths)
    whole = {k: np.frombuffer(b"".join(bits[x] for x in np.flatnonzero(lengths == k)), np.uint64).reshape(-1, k // 8) for k in kinds}
    left, right = [], []
    for k in kinds:
        own = np.flatnonzero(lengths == k)
        i, j = Tree(whole[k], sizes[own], labels[own], np.full(len(own), -1)).pairs(percent)
        left.append(own[i])
        right.append(own[j])
        for m in kinds[kinds > k]:
            far = np.flatnonzero(lengths == m)
            a = 100 * sizes[own] >= percent * sizes[far[0]]
            b = percent * sizes[far] <= 100 * sizes[own[-1]]
            if a.any() and b.any():
                folded = np.bitwise_or.reduce(whole[m][b].reshape(-1, m // k, k // 8), axis=1)
                both = np.concatenate([own[a], far[b]])
                i, j = Tree(np.concatenate([whole[k][a], folded]), sizes[both], labels[both], np.repeat([0, 1], [a.sum(), b.sum()])).pairs(percent)
                left.append(both[i])
                right.append(both[j])
    return np.concatenate(left), np.concatenate(right)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def compare(ids: list[int], sets: list[np.ndarray], percent: int, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Spanning links of a group: of all its similar pairs, enough to connect what they connect, given what ``labels`` connect."""
    order = sorted(range(len(ids)), key=lambda x: (len(sets[x]), ids[x]))
    first: dict[int, int] = {}
    up = [first.setdefault(labels[x] if labels else ids[x], k) for k, x in enumerate(order)]
    apart = len(first)

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []

    def check(x: int, y: int) -> None:
        nonlocal apart
        p, q = root(x), root(y)
        if p != q and linked(sets[order[x]], sets[order[y]], percent):
            up[max(p, q)] = min(p, q)
            apart -= 1
            out.append((ids[order[x]], ids[order[y]]))

    middle = len(order) // 2
    for x in range(len(order)):
        check(middle, x)
    if apart > 1:
        roots = np.array([root(x) for x in range(len(order))])
        for x, y in zip(*(v.tolist() for v in candidates([bitmap(sets[x]) for x in order], np.array([len(sets[x]) for x in order]), roots, percent)), strict=True):
            check(x, y)
    return out


def _common(texts: DataFrame, words: int) -> np.ndarray:
    """Elements (row 0) that occur often among a share of ORDER_SHARE of the documents, and how often (row 1), sorted by element."""
    drawn = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(ORDER_SHARE * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            found = [shingle_hashes(x.as_py(), words, known) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], names=["e"])

    counts = drawn.select("text").mapInArrow(run, "e bigint").groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") >= _COMMON)
    got = counts.orderBy(F.desc("n"), "e").limit(_MOST_COMMON).toArrow()
    table = np.stack([got.column(0).to_numpy(), got.column(1).to_numpy()])
    return table[:, np.argsort(table[0])]


def _often(e: np.ndarray, common: np.ndarray) -> np.ndarray:
    """How often ``common`` has seen each element."""
    if not common.shape[1]:
        return np.zeros(len(e), np.int64)
    at = np.minimum(np.searchsorted(common[0], e), common.shape[1] - 1)
    return np.where(common[0][at] == e, common[1][at], 0)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]), pa.int64()))


def _key(elements: np.ndarray) -> bytes | None:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def _sets(texts: DataFrame, words: int, percent: int, common: np.ndarray) -> DataFrame:
    """rid, doc_id, key (digest of the set), n, bits, prefix: the first elements, by which a similar set can be found."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            keys, sizes, bits, first = [], [], [], []
            for text in batch.column(2):
                e = shingle_hashes(text.as_py(), words, known)
                keys.append(_key(e))
                sizes.append(len(e))
                bits.append(bitmap(e, 1))
                first.append(e[np.argsort(_often(e, shared.value), kind="stable")][: len(e) - required(len(e), percent) + 1])
                if len(known) > _HELD:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), _lists(first)], names=["rid", "doc_id", "key", "n", "bits", "prefix"])

    return texts.mapInArrow(run, "rid bigint, doc_id bigint, key binary, n bigint, bits binary, prefix array<bigint>")


def _by(rows: DataFrame, side: DataFrame, keys: list[str], times: str) -> DataFrame:
    """``rows`` with what ``side`` (distinct ``keys``) has for them; others go. ``times`` says how many rows have a key: those of a crowded one are spread by ``rep``."""
    return join_uneven(rows, cut(side, "side"), keys, times, F.xxhash64("rep")).where(F.col(times).isNotNull())


def _of(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``ids``, a written table of distinct ids."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def _whole(texts: DataFrame, reps: DataFrame, heads: DataFrame, words: int, common: np.ndarray) -> DataFrame:
    """rep, elements, often (what ``common`` says of each), bits of the classes in ``reps``, a written table of rep."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            sets = [shingle_hashes(x.as_py(), words, known) for x in batch.column(1)]
            if len(known) > _HELD:
                known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_key, sets), pa.binary()), _lists(sets), _lists([_often(e, shared.value) for e in sets]), pa.array(map(bitmap, sets), pa.binary())], names=["rep", "key", "elements", "often", "bits"])

    asked = _of(texts.select(F.col("doc_id").alias("rep"), "text"), reps, "rep")
    found = asked.mapInArrow(run, "rep bigint, key binary, elements array<bigint>, often array<bigint>, bits binary")
    return found.join(heads.select("key", "rep"), ["key", "rep"]).dropDuplicates(["key"]).drop("key")


def _members(firsts: DataFrame, texts: DataFrame, heads: DataFrame, words: int, percent: int, group: int, common: np.ndarray) -> DataFrame:
    """``firsts`` (e, rep, n) under an order in which elements that crowd a group come later, by how many sets hold them.

    Only sets with such an element among their first ones get others, so the order is one for all.
    """
    crowded = cut(firsts.groupBy("e").agg(F.count("*").alias("k")).where(F.col("k") > group), "crowded")
    if crowded.isEmpty():
        return firsts
    within = cut(join_uneven(firsts, crowded, ["e"], "k", F.xxhash64("rep")).where("k is not null").select("rep").distinct(), "within")
    each = _whole(texts, within, heads, words, common).select(F.explode("elements").alias("e"))
    late = crowded.unionAll(each.groupBy("e").agg(F.count("*").alias("k")).where(F.col("k") > group)).groupBy("e").agg(F.max("k").alias("late"))
    late = cut(late, "late")
    moved = cut(join_uneven(firsts, late, ["e"], "late", F.xxhash64("rep")).where("late is not null").select("rep").distinct(), "moved")
    again = _whole(texts, moved, heads, words, common).select("rep", F.size("elements").alias("n"), F.explode(F.arrays_zip("elements", "often")).alias("x"))
    again = again.select("rep", "n", F.col("x.elements").alias("e"), F.col("x.often").alias("often"))
    again = join_uneven(again, late, ["e"], "late", F.xxhash64("rep"))
    order = Window.partitionBy("rep").orderBy("often", F.coalesce("late", F.lit(0)), "e")
    again = again.withColumn("n", F.col("n").cast("bigint")).withColumn("at", (F.row_number().over(order) - 1).cast("bigint"))
    again = again.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100)).select("e", "rep", "n", _early(percent))
    return _shared(firsts.join(moved, "rep", "left_anti").select("e", "rep", "n", "early").unionByName(again))


def _early(percent: int) -> Column:
    """Whether the element at place ``at`` of a set of ``n`` is one of those that the smaller of two similar sets must share."""
    return (F.col("at") <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent))).cast("bigint").alias("early")


def _shared(firsts: DataFrame) -> DataFrame:
    """Rows (e, rep, n, early) of elements that several sets hold, one of them early."""
    both = F.sum(F.col("early") * (1 << 32) + 1)
    kept = firsts.groupBy("e").agg(both.alias("k")).where((F.col("k") > 1 << 32) & (F.col("k") % (1 << 32) > 1)).select("e", (F.col("k") % (1 << 32)).alias("k"))
    return _by(firsts, kept, ["e"], "k").drop("k")


def _live(rows: DataFrame, percent: int) -> DataFrame:
    """e, rep, n of the rows (e, rep, n, bits; groups of GROUP at most) that the bound leaves a partner in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.sort_by([("e", "ascending"), ("n", "ascending")])
            e, n, bits = table.column("e").to_numpy(), table.column("n").to_numpy(), table.column("bits").to_pylist()
            live = np.zeros(len(e), bool)
            starts = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
            for a, b in zip(starts, np.append(starts[1:], len(e)), strict=True):
                if b - a == 2:
                    # Most groups are pairs: the size alone settles many of them.
                    live[a:b] = 100 * n[a] >= percent * n[a + 1] and len(candidates(bits[a:b], n[a:b], np.arange(2), percent)[0]) > 0
                else:
                    i, j = candidates(bits[a:b], n[a:b], np.arange(b - a), percent)
                    live[a + i] = live[a + j] = True
            yield from table.select(["e", "rep", "n"]).filter(pa.array(live)).combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            if sum(x.nbytes for x in held) < _HELD_BYTES:
                continue
            table = pa.Table.from_batches(held)
            e = table.column("e").to_numpy()
            cut_ = int(np.searchsorted(e, e[-1]))
            yield from settle(table.slice(0, cut_))
            held = table.slice(cut_).combine_chunks().to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("e", "rep", "n", "bits").repartition(n, "e").sortWithinPartitions("e").mapInArrow(run, "e bigint, rep bigint, n bigint")


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x for chunk in column.chunks for x in np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())[:-1])]


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """a, b from (task, rep, comp, elements): links within each task's rows that connect what isn't yet."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, comp = table.column("rep").to_pylist(), table.column("comp").to_pylist()
        out = compare(ids, _arrays(table.column("elements")), percent, comp) if len(ids) > 1 else []
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return rows.select("task", "rep", "comp", "elements").groupBy("task").applyInArrow(run, "a bigint, b bigint")


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """a, b from (task, rep, n, bits, comp): pairs across components that the tree leaves over."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("rep", "ascending")])
        ids, labels = table.column("rep").to_numpy(), np.unique(table.column("comp").to_numpy(), return_inverse=True)[1]
        i, j = candidates(table.column("bits").to_pylist(), table.column("n").to_numpy(), labels, percent)
        return pa.table({"a": pa.array(np.minimum(ids[i], ids[j]), pa.int64()), "b": pa.array(np.maximum(ids[i], ids[j]), pa.int64())})

    return rows.select("task", "rep", "n", "bits", "comp").groupBy("task").applyInArrow(run, "a bigint, b bigint")


def _chunked(members: DataFrame, group: Column, by: Column, size: Column, most: int) -> DataFrame:
    """``members`` with ``chunk``: 0, or one of ceil(size / most) by a hash."""
    return members.withColumn("chunk", F.pmod(F.xxhash64(group, by, F.lit(3)), F.greatest(F.ceil(size / most), F.lit(1))))


def _mixed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """e, k, rep, n, comp of the groups in ``members`` that hold several components under ``labels`` (v, label)."""
    if labels is None:
        return members.withColumn("comp", F.col("rep"))
    labelled = members.join(labels.select(F.col("v").alias("rep"), F.col("label").alias("comp")), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    labelled = cut(labelled.select("e", "k", "rep", "n", "comp"), "labelled")
    mixed = labelled.groupBy("e").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("times")).where("c0 < c1").select("e", "times")
    return _by(labelled, mixed, ["e"], "times").drop("times")


def _round(open_: DataFrame, whole: DataFrame, percent: int, group: int, seed: int) -> DataFrame:
    """a, b: links found by comparing each set of ``open_`` within one of its groups, drawn by ``seed``."""
    drawn = open_.groupBy("rep", "comp").agg(F.min(F.struct(F.xxhash64("e", F.lit(seed)).alias("by"), "e")).alias("m")).select("rep", "comp", "m.e")
    placed = _chunked(_by(drawn, drawn.groupBy("e").agg(F.count("*").alias("k")).where("k > 1"), ["e"], "k"), F.col("e"), F.col("rep"), F.col("k"), group)
    picked = placed.where(F.pmod(F.xxhash64("rep", "e", F.lit(5)), F.greatest(F.floor(F.col("k") / PIVOTS), F.lit(1))) == 0).where(F.col("k") > group)
    spread = picked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("k") / group) - 1)))
    tasks = cut(placed.unionByName(spread).select(F.struct("e", "chunk").alias("task"), "rep", "comp").distinct(), "tasks")
    return cut(_links(whole.join(F.broadcast(tasks) if tasks.count() <= BROADCAST_IDS else tasks, "rep"), percent), "links")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A document's set is its distinct shingles of ``words`` words, A-Z lower-cased (with
    fewer words, the whole sequence as one); two documents link when
    100 * intersection >= ``percent`` * union, and component_id is the smallest id that
    links reach. Null texts and texts without words have no set and no link: their own
    id. Ids are integers; with a null id, a document is no representative of others
    unless all with its set have none. An empty table gives an empty result; rows that repeat
    an id and a text share everything; other columns aren't read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    common = _common(texts, words)
    sets = cut(_sets(texts, words, percent, common), "sets")
    own = cut(sets.select("doc_id", "key", "n"), "own")
    heads = cut(sets.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "rid")).alias("m")).select("key", F.col("m.doc_id").alias("rep"), "m.rid"), "heads")
    classes = cut(_of(sets, heads.select("rid"), "rid").select(F.col("doc_id").alias("rep"), "n", "bits", "prefix"), "classes")
    discard(sets)

    # Groups of first elements, but for those of one document; of groups with the same members, one.
    firsts = classes.select(F.posexplode("prefix").alias("at", "e"), "rep", "n").select("e", "rep", "n", _early(percent))
    firsts = cut(_members(cut(_shared(firsts), "shared"), texts, heads, words, percent, group, common), "firsts")
    sums = firsts.groupBy("e").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), F.min("rep").alias("least")).where("k > 1")
    groups = sums.groupBy("k", "x", "y", "least").agg(F.min("e").alias("e")).select("e", "k")
    met = cut(_by(firsts, groups, ["e"], "k"), "met")
    small = _live(met.where(F.col("k") <= group).join(classes.select("rep", "bits"), "rep"), percent)
    live = cut(small.unionByName(met.where(F.col("k") > group).select("e", "rep", "n")), "live")
    members = cut(_by(live, live.groupBy("e").agg(F.count("*").alias("k")), ["e"], "k"), "members")
    reps = cut(live.select("rep").distinct(), "reps")
    whole = cut(_whole(texts, reps, heads, words, common).drop("often"), "whole")

    labels = None
    for seed in range(ROUNDS):
        links = _round(_mixed(members, labels), whole.select("rep", "elements"), percent, group, seed)
        if links.isEmpty():
            break
        labels = merged(labels, links)

    # What is mixed still, without its elements; what the trees leave is compared exactly.
    open_ = _mixed(members, labels)
    shares = open_.groupBy("e", "comp").agg(F.count("*").alias("own"), F.min("k").alias("k"))
    large = F.col("own") > group / 2
    shares = shares.withColumn("pool", F.when(F.col("k") <= group, F.lit(0)).when(large, F.xxhash64("comp")).otherwise(F.lit(0)))
    within = F.when(F.col("pool") == 0, F.col("k")).otherwise(F.col("own"))
    dealt = _by(open_.drop("k"), shares, ["e", "comp"], "own")
    dealt = cut(_chunked(dealt, F.col("e"), F.when(F.col("pool") == 0, F.col("comp")).otherwise(F.col("rep")), within, group).withColumn("chunk", F.struct("pool", "chunk")), "dealt")
    heads_ = dealt.groupBy("e", "chunk").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("low"), F.max("n").alias("high"))
    other = heads_.select("e", *[F.col(c).alias(f"{c}_") for c in ("chunk", "c0", "c1", "low", "high")])
    near = (F.least("high", "high_") * 100 >= F.greatest("low", "low_") * percent) & ~((F.col("c0") == F.col("c1")) & (F.col("c0_") == F.col("c1_")) & (F.col("c0") == F.col("c0_")))
    jobs = heads_.join(other, "e").where((F.col("chunk") <= F.col("chunk_")) & near).select(F.struct("e", "chunk", "chunk_").alias("task"), "e", F.explode(F.array_distinct(F.array("chunk", "chunk_"))).alias("chunk"))
    rows = dealt.join(jobs, ["e", "chunk"]).select("task", "rep", "n", "comp").join(whole.select("rep", "bits"), "rep")
    left = cut(_pairs(rows, percent).distinct(), "pairs")
    one, two = (whole.select(F.col("rep").alias(c), F.col("elements").alias(f"e{c}")) for c in "ab")
    labels = merged(labels, cut(_verified(left.join(one, "a").join(two, "b"), percent), "more"))

    of = heads.select("key", "rep").join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left").select("key", F.coalesce("label", "rep").alias("component"))
    keyed = own.select("doc_id", "n", F.coalesce("key", F.concat(F.lit("none").cast("binary"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).alias("key"))
    return keyed.join(of, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ea, eb) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (_arrays(pa.chunked_array([batch.column(c)])) for c in ("ea", "eb"))
            found = pa.array([linked(x, y, percent) for x, y in zip(*sets, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(found)

    return pairs.mapInArrow(run, "a bigint, b bigint")
