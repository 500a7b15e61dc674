"""Packing token sequences: Martello-Toth dominance reduction, then best fit.

Only lengths matter for packing, and there are at most ``capacity`` of them, so the
instance is a histogram: its size has that bound, whatever the corpus. The
reduction goes through the lengths from the longest down and settles, for good,
each small set that provably dominates every other way to fill the sequence that
holds the longest piece; the rest is packed best fit, longest first. The outcome
is a table of runs ("pieces of length L with ranks from r on go to sequences s,
s+1, ... at offset o"); the pieces find their run by their rank in Spark.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajlake.llm.common import cut, short_batches

CAPACITY = 4096
END_ID = 1
#: A task's memory of words already tokenized: about so many at most, none longer than this.
_WORDS, _LONGEST = 600_000, 64
#: Latin letters that are their own NFC form, then punctuation other than the apostrophe and what special tokens begin with.
_ENDS = frozenset([b".", b",", b";", b":", b"!", b"?"])
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=?@\[-`{-~]*)")
_CHUNKS = 512


def reduce_histogram(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets settled by dominance, as (lengths, how often), and what is left of ``counts``.

    For the longest piece j with room r left beside it: alone if nothing fits; with a
    piece of length r if there is one; with the longest piece k that fits if at most
    one more could fit anyway, or if at most two could and no two of them sum to more than k.
    In each case any other filling of j's sequence can swap places with the chosen one.
    """
    left = {size: n for size, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        sizes = sorted(left)
        for big in reversed(list(sizes)):
            while left.get(big):
                room = capacity - big
                small: list[int] = []
                for size in sizes[:4]:
                    small += [size] * min(3, left[size] - (size == big))
                small = small[:3]
                if not small or small[0] > room:
                    pick, times = (big,), left[big]
                else:
                    mate = room if left.get(room, 0) - (room == big) > 0 else None
                    if mate is None:
                        at = bisect_right(sizes, room) - 1
                        while at >= 0 and left[sizes[at]] - (sizes[at] == big) <= 0:
                            at -= 1
                        best = sizes[at]
                        if len(small) < 2 or small[0] + small[1] > room or (len(small) < 3 or sum(small) > room) and best >= _best_pair(sizes, left, big, room):
                            mate = best
                    if mate is None:
                        break
                    pick, times = (big, mate), left[big] // 2 if mate == big else min(left[big], left[mate])
                fixed.append((pick, times))
                changed = True
                for size in pick:
                    left[size] -= times
                for size in set(pick):
                    if not left[size]:
                        del left[size]
                        sizes.remove(size)
    return fixed, left


def _best_pair(sizes: list[int], left: dict[int, int], big: int, room: int) -> int:
    """The largest sum, up to ``room``, of two pieces besides one of length ``big``."""
    best, hi = 0, len(sizes) - 1
    for lo, a in enumerate(sizes):
        while hi >= 0 and a + sizes[hi] > room:
            hi -= 1
        for at in range(hi, lo - 1, -1):
            b = sizes[at]
            if left[b] - (b == big) - (a == b) > 0 and left[a] - (a == big) > 0:
                best = max(best, a + b)
                break
        if hi < lo:
            break
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over a histogram: sequences as (lengths, how often)."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if room not in open_:
            open_[room] = {}
            insort(rooms, room)
        open_[room][pattern] = open_[room].get(pattern, 0) + times

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                pattern, bins = next(iter(open_[room].items()))
                each = room // size
                full = min(bins, n // each)
                used = full or 1
                take = each if full else n
                del open_[room][pattern]
                if bins > used:
                    open_[room][pattern] = bins - used
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
                put(room - take * size, pattern + (size,) * take, used)
                n -= take * used
            else:
                each = capacity // size
                full = n // each
                if full:
                    put(capacity - each * size, (size,) * each, full)
                if n % each:
                    put(capacity - n % each * size, (size,) * (n % each), 1)
                n = 0
    return [(pattern, times) for group in open_.values() for pattern, times in group.items()]


def plan_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, first sequence, offset), sorted by length and rank."""
    fixed, left = reduce_histogram(counts, capacity)
    ranks: dict[int, int] = {}
    runs, sequence = [], 0
    for pattern, times in fixed + best_fit(left, capacity):
        at = 0
        for size in pattern:
            runs.append((size, ranks.get(size, 0), sequence, at))
            ranks[size] = ranks.get(size, 0) + times
            at += size
        sequence += times
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 4)


def word_encoder(tokenizer_file: str) -> Callable[[], Callable[[list[str]], Iterator[bytes]]]:
    """Makes, in a task, a function from texts to their ids as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and joins nothing across it, so words are encoded
    one by one and remembered. It also lower-cases, and cuts punctuation from letters:
    a word of Latin letters with punctuation after it is put together from both, and
    its letters go to the tokenizer's model directly.
    """

    def start() -> Callable[[list[str]], Iterator[bytes]]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        model = tokenizer.model
        # The byte-level alphabet: printable bytes stand for themselves, the n-th of the others for 256 + n.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        alphabet = {x: 256 + n for n, x in enumerate(x for x in range(256) if x not in plain)}

        def packed(ids: list[int]) -> bytes:
            return np.array(ids, dtype="<u4").tobytes()

        class Stems(dict):
            def __missing__(self, raw: bytes) -> bytes:
                out = packed([t.id for t in model.tokenize(raw.decode("latin-1").translate(alphabet))])
                if len(raw) <= _LONGEST:
                    self[raw] = out
                return out

        stems = Stems()

        class Words(dict):
            def __missing__(self, raw: bytes) -> bytes:
                if raw.isalpha():
                    out = stems[raw.lower()]
                elif raw[:-1].isalpha() and raw[-1:] in _ENDS:
                    out = stems[raw[:-1].lower()] + stems[raw[-1:]]
                elif m := _SIMPLE.fullmatch(word := raw.decode("utf-8")):
                    out = stems[m[1].lower().encode()] + (stems[m[2].encode()] if m[2] else b"")
                else:
                    out = packed(tokenizer.encode(word, add_special_tokens=False).ids)
                if len(raw) <= _LONGEST:
                    self[raw] = out
                return out

        words = Words()

        def encode(texts: list[str]) -> Iterator[bytes]:
            for known in (words, stems):
                if len(known) > _WORDS:
                    known.clear()
            for text in texts:
                yield b"".join(map(words.__getitem__, text.encode("utf-8", "replace").split()))

        return encode

    return start


def pieces(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and ``end_id``, cut every ``capacity`` ids."""
    short_batches(docs.sparkSession)
    start = word_encoder(tokenizer_file)
    end = np.array([end_id], dtype="<u4").tobytes()
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = start(), 4 * capacity
        for batch in batches:
            out: list[tuple] = []
            for doc, own in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids = own + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"]) if out else pa.RecordBatch.from_pylist([], pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Only documents of over ``capacity`` ids
    are cut. Pieces of one length are told apart by their rank by (chunk of the id,
    id, piece); rows that repeat an id are packed each for itself. An empty table gives
    an empty result; other columns aren't read.
    """
    spark = docs.sparkSession
    cuts = cut(pieces(docs, tokenizer_file, id_col, text_col, capacity, end_id).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(_CHUNKS)).cast("int")), "pieces")
    # At most capacity * _CHUNKS rows; the histogram has capacity rows at most.
    by_chunk = cuts.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    first = by_chunk.select("length", "chunk", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(plan_runs(counts, capacity))
    within = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = cuts.withColumn("within", within).join(first, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("within")).drop("chunk", "within", "before")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        base = np.int64(1) << 40
        keys = table[:, 0] * base + table[:, 1]
        for batch in batches:
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, batch.column(3).to_numpy(zero_copy_only=False) * base + rank, side="right") - 1
            found = table[at] if len(rank) else np.zeros((0, 4), np.int64)
            sequence = found[:, 2] + rank - found[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(found[:, 3])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
