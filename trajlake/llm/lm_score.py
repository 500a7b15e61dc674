"""Language-model scoring by online logistic context mixing.

The running text is a stream of tokens, each text closed by an end. Frequent words and the end are
leaves of a Huffman tree, all others share one leaf, and a token is the bits of its way down. Predictors
by hashed context (none, the token before, the two before, the last but one) give each
bit a probability from the bit counts of all training texts; a mixer adds their logits with weights chosen by a
gate (how well the contexts are known) and learns them online along the texts, each bit
predicted by counts that leave itself out; an adaptive probability map refines the outcome.

What takes the shared leaf is told within it: a known word, seen c times, has (c - D) of its mass T
outright. Of what the discount frees, as much as the words seen once have goes to the event of
an unknown word, and the rest to known words by the length of their spelling. So all words and the
unknown word together sum to 1 at most after any text. ``score`` counts that event for
each unknown word, as the base does; ``bits_per_byte`` adds the code length of its spelling, and is the whole code.

A word is spelt in bytes, a byte in the bits of a Huffman code, mixed in the same way from six orders of byte
context. A new word resembles words, not tokens, so this model learns each training word once.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import cut, remainder, short_batches

ORDERS = 6
#: 2^TABLE_BITS slots hold all bit counts, whatever the corpus: 16 MB.
TABLE_BITS = 21
DISCOUNT = 0.75
#: Words with a leaf of their own, at most; one has LEAF_COUNT training tokens at least.
LEAF_WORDS, LEAF_COUNT = 1 << 14, 2
#: Leaves of all other words, and of the end of a text.
OTHER, END_LEAF = 0, 1
#: Contexts of running text, and the slots of all of their bit counts, after a slot for each node of the tree.
CONTEXTS = 4
RUN_BITS = 19
_NODES = LEAF_WORDS + 2
_RUN_GATES = 16
_RUN_TOKENS, _RUN_STEP = 1 << 13, 1 << 12
#: Parts of the vocabulary that each learn weights of their own, of which the mean counts.
LEARN_BUCKETS = 48
#: Words of the highest counts that every task holds; all others are joined.
HOT_WORDS = 150_000
CELLS = 24
_GATES = 3 * ORDERS
_TASK_WORDS = 1 << 20
_CHUNK_BYTES = 1 << 14
#: Words that Python takes at once: batches that are short for texts are tiny for words.
_BATCH_WORDS = 1 << 13
_STEP_BITS = 1 << 14
_END = b""


def tokens(text: str) -> list[bytes]:
    """Words of the text, A-Z lower-cased; the end that follows them is the empty word."""
    return text.encode("utf-8", "replace").lower().split()


def _wider(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, _BATCH_WORDS or more in a batch."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _BATCH_WORDS:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _slots(context: np.ndarray, spread: np.ndarray, bits: int) -> np.ndarray:
    """A slot of 2^``bits`` for each pair of 32-bit hashes."""
    x = context ^ spread
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    x >>= np.uint32(32 - bits)
    return x


def _spread(node: np.ndarray) -> np.ndarray:
    return ((node.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32)


def _high(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _logits(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Logit of each slot's counts."""
    return np.log((ones + np.float32(0.2)) / (np.maximum(total - ones, 0) + np.float32(0.2))).astype(np.float32)


def _without(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Logits at 2 * slot + bit: of each slot's counts without one such bit."""
    return np.stack([_logits(ones, np.maximum(total - 1, ones)), _logits(np.maximum(ones - 1, 0), total - 1)], axis=1).ravel()


def _levels(total: np.ndarray) -> np.ndarray:
    """How well each slot is known, 0 to 3."""
    return (total > 0).astype(np.uint8) + (total > 3) + (total > 30)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c, n of (train, text): counts in training texts and in all; each text ends in an empty word."""
    short_batches(docs.sparkSession)
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for i, part in enumerate(seen):
                words, n = list(part), list(part.values())
                for at in range(0, len(words), 1 << 16):
                    own = pa.array(n[at : at + (1 << 16)], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(words[at : at + (1 << 16)], pa.binary()), own if i else pa.array([0] * len(own), pa.int64()), own], schema=schema)
                part.clear()

        for batch in batches:
            for train, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = seen[train]
                own.update(tokens(text.as_py()))
                own[_END] += 1
            if len(seen[0]) + len(seen[1]) > _TASK_WORDS // 4:
                yield from flush()
        yield from flush()

    rows = docs.select("train", "text").mapInArrow(run, "word binary, c bigint, n bigint")
    return rows.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each symbol: the length of its code and where it begins in the list of all; of each bit there: its node, its value."""
    leaves = len(counts)
    heap = [(float(n) + 1, s, s) for s, n in enumerate(counts)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    node = leaves
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[node] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], node, node))
        node += 1
    codes: dict[int, list[tuple[int, int]]] = {}
    stack: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][2], [])]
    while stack:
        at, way = stack.pop()
        if at < leaves:
            codes[at] = way
        else:
            for bit in (0, 1):
                stack.append((children[at][bit], [*way, (at - leaves, bit)]))
    size = np.array([len(codes[s]) for s in range(leaves)])
    flat = np.array([x for s in range(leaves) for x in codes[s]])
    return size, np.cumsum(size) - size, flat[:, 0], flat[:, 1].astype(bool)


class Coder:
    """Bits of words: for each bit its node in the code's tree, its value and its slots by order."""

    def __init__(self, byte_counts: np.ndarray):
        self.size, self.first, self.node, self.bit = huffman(byte_counts)
        self.spread = _spread(self.node)

    def bits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each bit: its node, its value, its slots (a row for each order), the number of its word."""
        text = np.frombuffer(b"".join(b" " + w + b" " for w in words), dtype=np.uint8)
        sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(text)) - np.repeat(starts, sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        wide = text.astype(np.uint64)
        hashes = np.zeros((ORDERS, len(text)), np.uint64)
        code = np.zeros(len(text), np.uint64)
        for k in range(1, ORDERS):
            code[k:] = np.where(place[k:] >= k, code[k:] | wide[:-k] << np.uint64(8 * (k - 1)), code[k:])
            hashes[k] = code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        own = np.flatnonzero(place > 0)
        n = self.size[text[own]]
        at = np.repeat(self.first[text[own]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        where = np.repeat(own, n)
        spread = self.spread[at]
        slots = np.empty((ORDERS, len(where)), np.int64)
        for k in range(ORDERS):
            slots[k] = _slots(_high(hashes[k])[where], spread, TABLE_BITS)
        return self.node[at], self.bit[at], slots, word[where]


def chunks(words: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for w in words:
        part.append(w)
        size += len(w) + 2
        if size > _CHUNK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


class Mixer:
    """Counts, gated weights and the probability map."""

    def __init__(self, coder: Coder, ones: np.ndarray, total: np.ndarray):
        self.coder, self.ones, self.total = coder, ones, total
        self.weights = np.full((_GATES, ORDERS + 1), 0.25)
        self.weights[:, -1] = 0.0
        self.map_ones = np.zeros(256 * CELLS)
        self.map_total = np.zeros(256 * CELLS)

    def state(self) -> dict:
        """What ``of`` rebuilds it from; a broadcast value must not need this module where it is read."""
        return vars(self) | {"coder": vars(self.coder)}

    @classmethod
    def of(cls, state: dict) -> Mixer:
        mixer, coder = cls.__new__(cls), Coder.__new__(Coder)
        vars(coder).update(state["coder"])
        # What learning changes is each task's own: a worker keeps a broadcast value for the tasks after it.
        vars(mixer).update(state | {"coder": coder} | {k: state[k].copy() for k in ("weights", "map_ones", "map_total")})
        return mixer

    def tables(self, learning: bool) -> tuple[np.ndarray, np.ndarray]:
        """Logits by slot, or by slot and own bit that is left out, and levels by slot."""
        if learning:
            return _without(self.ones, self.total), _levels(self.total - 1)
        return _logits(self.ones, self.total), _levels(self.total)

    def inputs(self, slots: np.ndarray, tables: tuple[np.ndarray, np.ndarray], own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Logits by order and a constant, and the gate. ``own``: bits to leave out of the counts, which ``tables`` do then."""
        logits, levels = tables
        x = np.ones((ORDERS + 1, slots.shape[1]), np.float32)
        gate = np.zeros(slots.shape[1], np.int64)
        for k in range(ORDERS):
            x[k] = logits[slots[k]] if own is None else logits[2 * slots[k] + own]
            level = levels[slots[k]]
            gate = np.where(level > 0, 3 * k - 1 + level.astype(np.int64), gate)
        return x, gate

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        weights = self.weights.T.astype(np.float32)
        logit = np.zeros(x.shape[1], np.float32)
        for k in range(ORDERS + 1):
            logit += weights[k][gate] * x[k]
        return np.clip(logit, -12, 12)

    def cells(self, logit: np.ndarray, node: np.ndarray) -> np.ndarray:
        return node * CELLS + ((logit + 12) * ((CELLS - 1) / 24)).astype(np.int64)

    def learn(self, words: list[bytes]) -> int:
        """Online steps over the bits of ``words``; gives their number."""
        done = 0
        tables = self.tables(True)
        for part in chunks(words):
            node, bit, slots, _ = self.coder.bits(part)
            value = bit.astype(np.float32)
            x, gate = self.inputs(slots, tables, bit)
            for at in range(0, len(bit), _STEP_BITS):
                here = slice(at, at + _STEP_BITS)
                logit = self.mix(x[:, here], gate[here])
                miss = value[here] - 1 / (1 + np.exp(-logit))
                n = np.bincount(gate[here], minlength=_GATES) + 50.0
                rate = max(0.02, 0.4 / (1 + self.map_total.sum() / 5e5))
                for k in range(ORDERS + 1):
                    self.weights[:, k] += rate * np.bincount(gate[here], miss * x[k, here], _GATES) / n
                cell = self.cells(logit, node[here])
                self.map_ones += np.bincount(cell, value[here], len(self.map_ones))
                self.map_total += np.bincount(cell, minlength=len(self.map_total))
            done += len(bit)
        return done

    def word_bits(self, words: list[bytes]) -> np.ndarray:
        """Code length of each word, its end included."""
        out = []
        tables = self.tables(False)
        for part in chunks(words):
            node, bit, slots, word = self.coder.bits(part)
            logit = self.mix(*self.inputs(slots, tables)).astype(np.float64)
            cell = self.cells(logit, node)
            p = 1 / (1 + np.exp(-logit))
            n = self.map_total[cell]
            p = np.clip((p + (self.map_ones[cell] + 20 * p) / (n + 20)) / 2, 1e-6, 1 - 1e-6)
            out.append(np.bincount(word, -np.log2(np.where(bit, p, 1 - p)), len(part)))
        return np.concatenate(out) if out else np.zeros(0)


class Runs:
    """The model of running text: the tree's codes, bit counts by context, gated weights and the probability map."""

    def __init__(self, leaf_counts: np.ndarray):
        self.size, self.first, self.node, self.bit = huffman(leaf_counts)
        self.spread = _spread(self.node)
        self.ones, self.total = (np.zeros(_NODES + (1 << RUN_BITS), np.float32) for _ in range(2))
        self.weights = np.zeros((_RUN_GATES, CONTEXTS + 1))
        self.weights[:, 0] = 1.0
        self.map_ones = np.zeros(_RUN_GATES * CELLS)
        self.map_total = np.zeros(_RUN_GATES * CELLS)

    @classmethod
    def of(cls, state: dict) -> Runs:
        """From its ``vars``, with what learning changes copied."""
        runs = cls.__new__(cls)
        vars(runs).update(state | {k: state[k].copy() for k in ("weights", "map_ones", "map_total")})
        return runs

    def bits(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each bit of whole texts (leaves, each text closed by END_LEAF), in parts: value, slots (a row for each context); and how many bits each token has."""
        one, two = np.full(len(ids), END_LEAF, np.int64), np.full(len(ids), END_LEAF, np.int64)
        one[1:], two[2:] = ids[:-1], ids[:-2]
        # Nothing is known across the end of a text.
        two[one == END_LEAF] = END_LEAF
        context = [_high((x + (k << 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k, x in ((1, one), (2, one << 20 | two), (3, two))]
        for start in range(0, len(ids), _RUN_TOKENS):
            own = ids[start : start + _RUN_TOKENS]
            n = self.size[own]
            where = np.repeat(np.arange(len(own)), n)
            at = (self.first[own] - (np.cumsum(n) - n))[where]
            at += np.arange(len(at))
            spread = self.spread[at]
            slots = np.empty((CONTEXTS, len(where)), np.int64)
            slots[0] = self.node[at]
            for k in range(1, CONTEXTS):
                slots[k] = _slots(context[k - 1][start : start + _RUN_TOKENS][where], spread, RUN_BITS)
                slots[k] += _NODES
            yield self.bit[at], slots, n

    def tables(self, learning: bool) -> tuple[np.ndarray, np.ndarray]:
        """Logits by slot, or by slot and own bit that is left out, and levels by slot."""
        if learning:
            return _without(self.ones, self.total), _levels(self.total - 1)
        return _logits(self.ones, self.total), _levels(self.total)

    def inputs(self, slots: np.ndarray, tables: tuple[np.ndarray, np.ndarray], own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Logits by context and a constant, and the gate. ``own``: bits to leave out of the counts, which ``tables`` do then."""
        logits, levels = tables
        x = np.ones((CONTEXTS + 1, slots.shape[1]), np.float32)
        for k in range(CONTEXTS):
            x[k] = logits[slots[k]] if own is None else logits[2 * slots[k] + own]
        return x, (4 * levels[slots[1]] + levels[slots[2]]).astype(np.int64)

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        weights = self.weights.T.astype(np.float32)
        logit = weights[-1][gate]
        for k in range(CONTEXTS):
            logit += weights[k][gate] * x[k]
        return np.clip(logit, -16, 16)

    def cells(self, logit: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return gate * CELLS + ((logit + 16) * ((CELLS - 1) / 32)).astype(np.int64)

    def learn(self, ids: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> int:
        """Online steps along the bits of whole texts that have been counted; gives their number."""
        done = 0
        for bit, slots, _ in self.bits(ids):
            value = bit.astype(np.float32)
            x, gate = self.inputs(slots, tables, bit)
            for at in range(0, len(bit), _RUN_STEP):
                here = slice(at, at + _RUN_STEP)
                logit = self.mix(x[:, here], gate[here])
                miss = value[here] - 1 / (1 + np.exp(-logit))
                n = np.bincount(gate[here], minlength=_RUN_GATES) + 50.0
                rate = max(0.02, 0.2 / (1 + self.map_total.sum() / 1e5))
                for k in range(CONTEXTS + 1):
                    self.weights[:, k] += rate * np.bincount(gate[here], miss * x[k, here], _RUN_GATES) / n
                cell = self.cells(logit, gate[here])
                self.map_ones += np.bincount(cell, value[here], len(self.map_ones))
                self.map_total += np.bincount(cell, minlength=len(self.map_total))
            done += len(bit)
        return done

    def code(self, ids: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 of the probability of each token of whole texts after those before it."""
        out = [np.zeros(0)]
        # Few are in a cell at first; then as much is taken from the map as from the mixer.
        own = 1 - self.map_total / (2 * (self.map_total + 1000))
        of_map = np.stack([self.map_total - self.map_ones, self.map_ones], axis=1).ravel() / np.repeat(2 * (self.map_total + 1000), 2)
        for bit, slots, n in self.bits(ids):
            x, gate = self.inputs(slots, tables)
            logit = self.mix(x, gate)
            cell = self.cells(logit, gate)
            p = 1 / (1 + np.exp(np.where(bit, -logit, logit)))
            p = np.clip(p * own[cell] + of_map[2 * cell + bit], 1e-7, 1 - 1e-7)
            # A logarithm a token: even 42 bits of least probability stay above the bound.
            out.append(np.log10(np.maximum(np.multiply.reduceat(p, np.cumsum(n) - n), 1e-300)))
        return np.concatenate(out)


def _pairs(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 1 << 16):
        here = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(keys[here].astype(np.int64)), pa.array(a[here].astype(np.float64)), pa.array(b[here].astype(np.float64))], names=["key", "a", "b"])


_PAIRS = "key bigint, a double, b double"


def _summed(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = df.groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    return tuple(got.column(i).to_numpy() for i in range(3))


def fit(vocabulary: DataFrame) -> Mixer:
    """The model of a training vocabulary (word): all of its words count, each once."""
    spark = vocabulary.sparkSession
    words = vocabulary.select("word")

    def byte_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256)
        for batch in _wider(batches):
            n += np.bincount(np.frombuffer(b" ".join([*batch.column(0).to_pylist(), b""]), np.uint8), minlength=256)
        yield from _pairs(np.arange(256), n, n)

    key, n, _ = _summed(words.mapInArrow(byte_run, _PAIRS))
    byte_counts = np.zeros(256)
    byte_counts[key] = n
    coder = Coder(byte_counts)

    def count_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, total = np.zeros(1 << TABLE_BITS, np.int32), np.zeros(1 << TABLE_BITS, np.int32)
        held: list[np.ndarray] = []
        size = 0

        def add() -> None:
            # The lowest bit is the coded bit.
            both = np.bincount(np.concatenate(held), minlength=2 << TABLE_BITS)
            ones[:] += both[1::2].astype(np.int32)
            total[:] += (both[::2] + both[1::2]).astype(np.int32)
            held.clear()

        for batch in _wider(batches):
            for part in chunks(batch.column(0).to_pylist()):
                _, bit, slots, _ = coder.bits(part)
                held.append((slots << 1 | bit).ravel().astype(np.int32))
                size += held[-1].size
                if size > 1 << 23:
                    add()
                    size = 0
        if held:
            add()
        used = np.flatnonzero(total)
        yield from _pairs(used, ones[used], total[used])

    key, a, b = _summed(words.mapInArrow(count_run, _PAIRS))
    ones, total = np.zeros(1 << TABLE_BITS, np.float32), np.zeros(1 << TABLE_BITS, np.float32)
    ones[key], total[key] = a, b
    shared = spark.sparkContext.broadcast(Mixer(coder, ones, total).state())

    def learn_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, done = Mixer.of(shared.value), 0
        for batch in _wider(batches):
            done += mixer.learn(batch.column(0).to_pylist())
        flat = mixer.weights.ravel()
        yield from _pairs(np.arange(len(flat)), flat * done, np.full(len(flat), float(done)))
        yield from _pairs(1000 + np.arange(len(mixer.map_total)), mixer.map_ones, mixer.map_total)

    # Steps run along fixed buckets in a fixed order, so weights are the same on any number of cores.
    key, a, b = _summed(words.repartition(LEARN_BUCKETS, "word").sortWithinPartitions("word").mapInArrow(learn_run, _PAIRS))
    mixer = Mixer(coder, ones, total)
    flat, seen = mixer.weights.ravel().copy(), (key < 1000) & (b > 0)
    flat[key[seen]] = a[seen] / b[seen]
    mixer.weights = flat.reshape(mixer.weights.shape)
    cells = key >= 1000
    mixer.map_ones[key[cells] - 1000], mixer.map_total[key[cells] - 1000] = a[cells], b[cells]
    return mixer


def fit_runs(texts: DataFrame, leaves: dict[bytes, int], leaf_counts: np.ndarray) -> Runs:
    """The model of running text of all training texts (text): each counts as often as it occurs."""
    spark = texts.sparkSession
    short_batches(spark)
    named = spark.sparkContext.broadcast(leaves)

    def id_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf = named.value
        for batch in batches:
            ids = []
            for text in batch.column(1):
                own = tokens(text.as_py())
                own.append(_END)
                ids.append(np.fromiter(map(leaf.get, own, repeat(OTHER)), np.uint16, len(own)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["at", "ids"])

    runs = cut(texts.select(F.xxhash64("text").alias("at"), "text").mapInArrow(id_run, "at bigint, ids binary"), "runs")
    shared = spark.sparkContext.broadcast(vars(Runs(leaf_counts)))

    def read(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column("ids").to_pylist()), np.uint16).astype(np.int64)

    def count_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Runs.of(shared.value)
        both = np.zeros(2 * len(model.total), np.int64)
        held: list[np.ndarray] = []
        size = 0

        def add() -> None:
            both[:] += np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=len(both))
            held.clear()

        for batch in batches:
            for bit, slots, _ in model.bits(read(batch)):
                # The lowest bit is the coded bit.
                held.append((slots << 1 | bit).ravel())
                size += held[-1].size
                if size > 1 << 22:
                    add()
                    size = 0
        add()
        ones, total = both[1::2], both[::2] + both[1::2]
        used = np.flatnonzero(total)
        yield from _pairs(used, ones[used], total[used])

    key, a, b = _summed(runs.mapInArrow(count_run, _PAIRS))
    model = Runs(leaf_counts)
    model.ones[key], model.total[key] = a, b
    counted = spark.sparkContext.broadcast(vars(model))

    def learn_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = Runs.of(counted.value), 0
        tables = own.tables(True)
        for batch in batches:
            done += own.learn(read(batch), tables)
        flat = own.weights.ravel()
        yield from _pairs(np.arange(len(flat)), flat * done, np.full(len(flat), float(done)))
        yield from _pairs(1000 + np.arange(len(own.map_total)), own.map_ones, own.map_total)

    # Steps run along fixed buckets in a fixed order, so weights are the same on any number of cores.
    key, a, b = _summed(runs.repartition(LEARN_BUCKETS, "at").sortWithinPartitions("at").mapInArrow(learn_run, _PAIRS))
    flat, seen = model.weights.ravel().copy(), (key < 1000) & (b > 0)
    flat[key[seen]] = a[seen] / b[seen]
    model.weights = flat.reshape(model.weights.shape)
    cells = key >= 1000
    model.map_ones[key[cells] - 1000], model.map_total[key[cells] - 1000] = a[cells], b[cells]
    return model


def score_words(words: DataFrame, mixer: Mixer, train_tokens: float, kinds: int, once: int) -> DataFrame:
    """word, c, n of ``words`` with lp (log10 of the probability of the word, or of an unknown one, among words that hold ``train_tokens``) and bits (its whole code)."""
    shared = words.sparkSession.sparkContext.broadcast(mixer.state())
    new = max(once, 1.0) / max(train_tokens, 1)
    rest = max(DISCOUNT * kinds - once, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer.of(shared.value)
        for batch in _wider(batches):
            bits = mixer.word_bits(batch.column(0).to_pylist())
            c = batch.column(1).to_numpy()
            if train_tokens:
                seen = (np.maximum(c - DISCOUNT, 0) + rest * np.exp2(-np.minimum(bits, 1000.0))) / train_tokens
                lp = np.log10(np.where(c > 0, seen, min(new, 1.0)))
            else:
                lp = np.zeros(len(c))
            bits = np.where(c > 0, 0.0, bits) - lp / np.log10(2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp), pa.array(bits)], names=["word", "c", "n", "lp", "bits"])

    return words.select("word", "c", "n").mapInArrow(run, "word binary, c bigint, n bigint, lp double, bits double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Null texts count as empty: one token, the end. A null id is not held out. ``score``
    is the text's log10 probability under the model, ``bits_per_byte`` the same in bits over
    the bytes of its words and the white space after each. An empty table gives an
    empty result; rows that repeat an id are scored each; other columns aren't read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    held = F.coalesce(remainder(F.col(id_col), 7) == 2, F.lit(False))
    base = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = cut(word_counts(base.select((~F.col("held_out")).alias("train"), "text")), "words")
    totals = counted.agg(F.sum("c"), F.sum(F.when(F.col("c") > 0, 1).otherwise(0)), F.sum(F.when(F.col("c") == 1, 1).otherwise(0))).first()
    n_train, kinds, once = (int(x or 0) for x in totals)
    # Words seen once, and those beyond LEAF_WORDS, share a leaf: within it, each has its share of the mass.
    tree = cut(counted.where((F.col("c") >= LEAF_COUNT) & (F.length("word") > 0)).orderBy(F.desc("c"), "word").limit(LEAF_WORDS).select("word", "c"), "tree")
    got = tree.toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    ends = counted.where(F.length("word") == 0).agg(F.sum("c")).first()[0] or 0
    own = got.column("c").to_numpy()
    leaves = {_END: END_LEAF} | {w: at for at, w in enumerate(got.column("word").to_pylist(), END_LEAF + 1)}
    rare, rare_kinds = n_train - ends - int(own.sum()), kinds - (ends > 0) - len(own)
    runs = fit_runs(base.where("not held_out").select("text"), leaves, np.concatenate([[rare, ends], own]))
    mass = rare - DISCOUNT * rare_kinds + max(DISCOUNT * rare_kinds - once, 0.0) + max(once, 1)
    of_tree = F.broadcast(tree.select("word").unionByName(spark.range(1).select(F.lit(_END).alias("word"))))
    others = score_words(counted.join(of_tree, "word", "left_anti"), fit(counted.where("c > 0")), mass, rare_kinds, once)
    own_leaf = counted.join(of_tree, "word", "left_semi").select("word", "c", "n", F.lit(0.0).alias("lp"), F.lit(0.0).alias("bits"))
    scored = cut(others.unionByName(own_leaf), "scored")

    # The counts from which on all words fit into every task: read off a histogram of at most 1000 rows.
    level = F.floor(F.log2("n") * 16)
    histogram = sorted(((r[0], r[1]) for r in scored.groupBy(level.alias("l")).agg(F.count("*")).collect()), reverse=True)
    least, room = None, HOT_WORDS
    for at, n in histogram:
        if n > room:
            break
        least, room = at, room - n
    hot = scored.where(level >= F.lit(least)) if least is not None else scored.limit(0)
    got = hot.select("word", "c", "lp", "bits").toArrow()
    norm = float(n_train + kinds + 1)
    c = got.column("c").to_numpy()
    plain_lp = np.log10((c + 1) / norm)
    known = {w: x for w, x in zip(got.column("word").to_pylist(), zip((c > 0).tolist(), plain_lp.tolist(), got.column("lp").to_pylist(), got.column("bits").to_pylist(), strict=True), strict=True) if w not in leaves}
    # What has a leaf of its own is looked up by it: whether it is known, and what the base gives it.
    of_leaf = np.zeros((2, len(leaves) + 1))
    of_leaf[:, END_LEAF] = ends > 0, np.log10((ends + 1) / norm)
    of_leaf[:, END_LEAF + 1 :] = np.ones(len(own)), np.log10((own + 1) / norm)
    shared = spark.sparkContext.broadcast((known, leaves, of_leaf, vars(runs) if n_train else None))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, leaf, of_leaf, state = shared.value
        model = Runs.of(state) if state else None
        tables = model.tables(False) if model else None
        for batch in batches:
            texts = [[*tokens(text.as_py()), _END] for text in batch.column(3)]
            size = np.array([len(words) for words in texts], np.int64)
            first = np.cumsum(size) - size
            ids = np.fromiter(chain.from_iterable(map(leaf.get, words, repeat(OTHER)) for words in texts), np.int64, size.sum())
            other = ids == OTHER
            mixed = np.add.reduceat(model.code(ids, tables), first) if model else np.zeros(len(texts))
            found, plain = (np.add.reduceat(x[ids], first) for x in of_leaf)
            code = -mixed / np.log10(2)
            # Words that share a leaf and aren't hot get rows of their own, to meet what is known of them.
            at, rare, times = [], [], []
            for i, words in enumerate(texts):
                for w, n in Counter(compress(words, other[first[i] : first[i] + size[i]].tolist())).items():
                    own = hot.get(w)
                    if own is None:
                        at.append(i)
                        rare.append(w)
                        times.append(n)
                    else:
                        found[i] += n * own[0]
                        plain[i] += n * own[1]
                        mixed[i] += n * own[2]
                        code[i] += n * own[3]
            n_bytes = np.array([sum(map(len, words)) for words in texts], np.int64) + size
            row, none = pa.array([*at, *range(len(texts))], pa.int64()), np.zeros(len(at))
            cols = [pa.array(np.concatenate([none.astype(x.dtype), x])) for x in (n_bytes, size.astype(np.int64), found.astype(np.int64), plain, mixed, code)]
            words_ = [pa.array([*rare, *[None] * len(texts)], pa.binary()), pa.array([*times, *[0] * len(texts)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in range(3)), *words_, *cols], names=["rid", "doc_id", "held_out", "word", "n", "n_bytes", "n_tokens", "n_known", "base_score", "score", "bits"])

    numbered = base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    parts = numbered.mapInArrow(run, f"rid bigint, doc_id {kind}, held_out boolean, word binary, n bigint, n_bytes bigint, n_tokens bigint, n_known bigint, base_score double, score double, bits double")
    # A word holds no white space, so a document's own row meets no word, and all of these rows don't share one key.
    own = F.concat(F.lit(" ").cast("binary"), F.col("rid").cast("string").cast("binary"))
    joined = parts.withColumn("word", F.coalesce("word", own)).join(scored.select("word", "c", "lp", F.col("bits").alias("code")), "word", "left")

    def total(col: str, of: Column) -> Column:
        return F.sum(F.col(col) + F.coalesce(of * F.col("n"), F.lit(0))).alias(col)

    sums = joined.groupBy("rid", "doc_id", "held_out").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"),
        total("n_known", F.when(F.col("c") > 0, 1).otherwise(0)), total("base_score", F.log10((F.col("c") + 1) / F.lit(norm))), total("score", F.col("lp")), total("bits", F.col("code")),
    )
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"), "base_score", "score", (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))
