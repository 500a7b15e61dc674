"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of orders 0 to ORDER with the counts of
the bytes that followed. A byte's probability comes from the longest context that
has seen it; each longer context that exists but hasn't seen it charges its
escape (method C: as many escapes as distinct bytes). Statistics are frozen after
training. Contexts begin at the white space before a word, so a text's
exact code length is the sum over its words, and the language with the shortest
code wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import remainder, short_batches, uniform

ORDER = 4
#: Documents of each language that its tree is fitted on, about: all if it has fewer. They
#: are drawn by a hash of their text, and bound the tree's size.
SAMPLE_DOCS = 1500
SEED = 7
UNKNOWN = "und"
#: A task's memory of words already scored.
_WORDS, _HELD_BYTES = 150_000, 1 << 24
_CHUNK_BYTES = 1 << 21


def _keys(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Per byte of `` word `` and order k: a code of (k, the k bytes before it), -1 if there are fewer; the byte."""
    text = np.frombuffer(b"".join(b" " + w + b" " for w in words), dtype=np.uint8).astype(np.int64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(text)) - np.repeat(starts, sizes)
    codes = np.full((order + 1, len(text)), -1, np.int64)
    code = np.zeros(len(text), np.int64)
    codes[0] = 0
    for k in range(1, order + 1):
        code[k:] += text[:-k] << (8 * (k - 1))
        codes[k] = np.where(place >= k, code | (k << 40), -1)
    return codes, np.where(place > 0, text, -1)


def count_contexts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, ctx, sym, n: how often a byte followed a context, over the words of ``docs`` (lang, text)."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(text.encode("utf-8", "replace").lower().split())
            for lang, seen in words.items():
                if not seen:
                    continue
                codes, sym = _keys(list(seen), order)
                weight = np.repeat(np.fromiter(seen.values(), np.int64, len(seen)), [len(w) + 2 for w in seen])
                use = (codes >= 0) & (sym >= 0)
                key, where = np.unique((codes << 8 | sym)[use], return_inverse=True)
                n = np.bincount(where, np.broadcast_to(weight, use.shape)[use]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n)], names=["lang", "key", "n"])

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, key bigint, n bigint")
    return rows.groupBy("lang", "key").agg(F.sum("n").alias("n")).select("lang", F.shiftright("key", 8).alias("ctx"), F.col("key").bitwiseAND(255).alias("sym"), "n")


class Trees:
    """Frozen context trees of all languages, side by side for lookup."""

    def __init__(self, langs: list[str], lang: np.ndarray, ctx: np.ndarray, sym: np.ndarray, n: np.ndarray, order: int):
        self.langs, self.order = langs, order
        size = len(langs)
        self.ctx, at = np.unique(ctx, return_inverse=True)
        self.key, key_at = np.unique(ctx << 8 | sym, return_inverse=True)
        total, kinds = np.zeros((len(self.ctx), size)), np.zeros((len(self.ctx), size))
        np.add.at(total, (at, lang), n)
        np.add.at(kinds, (at, lang), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            # A context that a language has never seen costs it nothing: it doesn't exist there.
            self.escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
        count = np.zeros((len(self.key), size))
        count[key_at, lang] = n
        where = np.searchsorted(self.ctx, self.key >> 8)
        self.bits = np.full((len(self.key), size), 8.0)
        # From the shortest contexts up: either seen here, or an escape and the next shorter context's cost.
        level = self.key >> 48
        for k in range(order + 1):
            rows = np.flatnonzero(level == k)
            if not len(rows):
                continue
            below = np.full((len(rows), size), 8.0)
            if k:
                short = (self.key[rows] >> 8 & ((1 << 8 * (k - 1)) - 1) | (k - 1) << 40) << 8 | self.key[rows] & 255
                if k == 1:
                    short = self.key[rows] & 255
                found = np.minimum(np.searchsorted(self.key, short), len(self.key) - 1)
                hit = self.key[found] == short
                below[hit] = self.bits[found[hit]]
            with np.errstate(divide="ignore", invalid="ignore"):
                own = -np.log2(count[rows] / (total + kinds)[where[rows]])
            self.bits[rows] = np.where(count[rows] > 0, own, self.escape[where[rows]] + below)

    @classmethod
    def of(cls, state: dict | None) -> Trees | None:
        """Trees from their ``vars``: what is broadcast must not need this module where it is read."""
        if state is None:
            return None
        trees = cls.__new__(cls)
        vars(trees).update(state)
        return trees

    def word_bits(self, words: list[bytes]) -> np.ndarray:
        """Code length of each word, with the white space after it, in each language."""
        codes, sym = _keys(words, self.order)
        bits = np.zeros((len(sym), len(self.langs)))
        todo = np.flatnonzero(sym >= 0)
        for k in range(self.order, -1, -1):
            here = todo[codes[k][todo] >= 0]
            if not len(here):
                continue
            key = codes[k][here] << 8 | sym[here]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[at] == key
            bits[here[hit]] += self.bits[at[hit]]
            miss = here[~hit]
            if len(miss):
                ctx = codes[k][miss]
                at = np.minimum(np.searchsorted(self.ctx, ctx), len(self.ctx) - 1)
                known = self.ctx[at] == ctx
                bits[miss[known]] += self.escape[at[known]]
            settled = np.zeros(len(sym), bool)
            settled[here[hit]] = True
            todo = todo[~settled[todo]]
        bits[todo] += 8.0
        sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        return np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, order: int = ORDER, seed: int = SEED) -> Trees | None:
    """Trees from labelled rows (doc_id, lang, text); None if there are none."""
    rows = docs.where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("of"))
    langs = sorted((r["lang"], r["of"]) for r in counts.collect())
    if not langs:
        return None
    share = F.create_map(*[F.lit(x) for lang, of in langs for x in (lang, min(1.0, sample_docs / max(of, 1)))])
    # By the text, not by the id, which may repeat or be null; equal texts count once, so the sample has a bound.
    drawn = rows.where(uniform(F.col("text"), F.lit(seed)) < share[F.col("lang")]).select("lang", "text").distinct()
    got = count_contexts(drawn, order).toPandas()
    if not len(got):
        return None
    names = sorted(got["lang"].unique())
    index = got["lang"].map({x: i for i, x in enumerate(names)}).to_numpy()
    return Trees(names, index, got["ctx"].to_numpy(), got["sym"].to_numpy(), got["n"].to_numpy(), order)


def predict(docs: DataFrame, trees: Trees | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, bits, n_bytes. ``text_col`` must be the last column.

    A null text, or one without a letter, is ``und`` with score 0; so is every text
    if there are no trees. Ties go to the first language by name. ``score`` is the share
    of the winner among 2^-bits of all languages.
    """
    short_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(None if trees is None else vars(trees))
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col) + ", lang_pred string, score double, bits double, n_bytes bigint"
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees.of(model.value)
        known: dict[bytes, int] = {}
        held = 0
        matrix = np.zeros((1024, len(trees.langs) if trees else 0), np.float32)
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64())
        for batch in batches:
            words: list[list[bytes] | None] = []
            sizes = []
            for value in batch.column(at):
                text = value.as_py() or ""
                raw = text.encode("utf-8", "replace")
                sizes.append(len(raw))
                words.append(raw.lower().split() if trees and any(map(str.isalpha, text)) else None)
            if len(known) > _WORDS or held > _HELD_BYTES:
                known.clear()
                held = 0
            new = list(set().union(*filter(None, words)).difference(known))
            while len(matrix) < len(known) + len(new):
                matrix = np.concatenate([matrix, np.zeros_like(matrix)])
            part, size = [], 0
            for i, w in enumerate(new):
                part.append(w)
                size += len(w)
                if size > _CHUNK_BYTES or i == len(new) - 1:
                    matrix[len(known) : len(known) + len(part)] = trees.word_bits(part)
                    known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
                    part, size = [], 0
            held += sum(map(len, new))
            out: list[tuple] = []
            for own, n in zip(words, sizes, strict=True):
                if own is None:
                    out.append((UNKNOWN, 0.0, None, n))
                    continue
                total = matrix[np.fromiter(map(known.__getitem__, own), np.int64, len(own))].sum(0, dtype=np.float64)
                best = int(total.argmin())
                share = 1.0 / np.exp2(np.clip(total[best] - total, -1000, 0)).sum()
                out.append((trees.langs[best], float(share), float(total[best]), n))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays(rest + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[n for n in names if n != text_col] + ["lang_pred", "score", "bits", "n_bytes"])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(remainder(F.col(id_col), 4) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, order: int = ORDER) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, bits, n_bytes.

    Trees learn from texts with a language outside the held-out quarter of the ids
    (a null id isn't held out), at most about ``sample_docs`` of each language, whole.
    An empty table gives an empty result; repeated rows get equal answers.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    trees = train(base.where(~F.col("held_out")), sample_docs, order)
    return predict(base.select("doc_id", "held_out", "text"), trees)
