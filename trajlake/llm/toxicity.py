"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; everything else, labelled or not, is unlabelled text that holds the
class prior's share of toxic ones. The risk of a linear classifier is

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

with the logistic loss: what unlabelled text charges for being called toxic, less what the toxic
texts hidden in it account for, and never under zero. Several classifiers learn in tasks of
their own, each from its share of the unlabelled texts and from all positives; their weights are averaged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import BATCH_ROWS, cut, remainder, uniform

#: Texts that the classifiers are fitted on, about: all if there are fewer. They are drawn by a hash of id and text.
POSITIVES, UNLABELLED = 4000, 16_000
CLASSIFIERS = 4
#: Features that a classifier may weigh: those most unevenly spread between positives and unlabelled texts.
FEATURES = 20_000
#: Positives that a feature must occur in, and how much more often there than in unlabelled text.
LEAST_TEXTS, LEAST_LIFT = 3, 2.0
#: A word counts whole and by its first letters, as many as these; longer words only by those.
HEADS, LONGEST = (4, 5, 6, 7), 24
#: Occurrences of a feature in one text that count; twice counts more than double, as insults of a kind come together and chance finds don't.
MOST_TIMES, POWER = 6, 1.5
SEED = 11
ROUNDS, RATE, DECAY = 400, 0.1, 2e-4
_WORDS, _HELD_BYTES = 150_000, 1 << 24


def of_word(word: str) -> list[str]:
    """Features of one word: its letters and digits, lower case, and how it begins."""
    word = re.sub(r"[\W_]+", "", word.lower())
    if not word:
        return []
    own = [word[:k] + "*" for k in HEADS if len(word) > k]
    return own + [word] if len(word) <= LONGEST else own


def features(text: str, known: dict[str, list[str]]) -> Counter:
    """How often each feature occurs; ``known`` remembers words."""
    out: Counter = Counter()
    for word, n in Counter(text.split()).items():
        own = known.get(word)
        if own is None:
            own = known[word] = of_word(word)
        for f in own:
            out[f] += n
    return out


def strength(times: int) -> float:
    """A feature's value in a text that holds it so often."""
    return float(min(times, MOST_TIMES) ** POWER)


def class_prior(labels: DataFrame) -> tuple[float, int]:
    """The share of toxic ids among labelled ones, and how many are toxic. An id with several labels is toxic if one says so."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("y"))
    n, y = one.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    return (y / n if n else 0.0), y


def nn_pu(pos: tuple[np.ndarray, np.ndarray, np.ndarray], unl: tuple[np.ndarray, np.ndarray, np.ndarray], unl_times: np.ndarray, width: int, prior: float) -> np.ndarray:
    """Weights and, last, the bias that minimise the non-negative risk.

    ``pos`` and ``unl`` hold a sparse matrix each as (row, column, value); ``unl_times`` how often each unlabelled row
    counts. When the bracket of the risk would be negative, a step undoes it instead, as it is over-fitted then.
    """
    n_pos, n_unl = int(pos[0].max(initial=-1)) + 1, len(unl_times)
    share = unl_times / unl_times.sum()
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    # The bias starts at the prior's odds, so that a text without features costs what it should.
    w[-1] = np.log(prior / (1 - prior))

    def margin(x: tuple, n: int) -> np.ndarray:
        return np.bincount(x[0], w[x[1]] * x[2], n) + w[-1]

    def gradient(x: tuple, slope: np.ndarray) -> np.ndarray:
        g = np.bincount(x[1], slope[x[0]] * x[2], width + 1)
        g[-1] = slope.sum()
        return g

    for step in range(1, ROUNDS + 1):
        p, u = margin(pos, n_pos), margin(unl, n_unl)
        called_p, called_u = 1 / (1 + np.exp(-p)), 1 / (1 + np.exp(-u))
        rest = (share * np.logaddexp(0, u)).sum() - prior * np.logaddexp(0, p).mean()
        below = gradient(unl, share * called_u) - gradient(pos, prior * called_p / n_pos)
        g = gradient(pos, prior * (called_p - 1) / n_pos) + below if rest >= 0 else -below
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _sample(docs: DataFrame, labels: DataFrame, n_toxic: int, positives: int, unlabelled: int) -> DataFrame:
    """y, bag, times, text: positives (bag null) and unlabelled texts, dealt to classifiers; equal rows once, with how many they are."""
    toxic = labels.where("toxic = 1 and doc_id is not null").select("doc_id").distinct().where(uniform(F.col("doc_id"), F.lit(SEED)) < min(1.0, positives / max(n_toxic, 1)))
    # At most about ``positives`` ids.
    pos = docs.join(F.broadcast(toxic), "doc_id").groupBy("doc_id", "text").agg(F.count("*").alias("times")).select(F.lit(1).alias("y"), F.lit(None).cast("int").alias("bag"), "times", "text")
    draw = uniform(F.col("doc_id"), F.xxhash64("text"), F.lit(SEED))
    unl = docs.where(draw < min(1.0, unlabelled / max(docs.count(), 1))).groupBy("doc_id", "text").agg(F.count("*").alias("times"))
    return pos.unionByName(unl.select(F.lit(0).alias("y"), F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(CLASSIFIERS)).cast("int").alias("bag"), "times", "text"))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[dict[str, float], float] | None:
    """A weight for each feature, and the bias; None without a toxic label or without a text that has one."""
    prior, n_toxic = class_prior(labels)
    if not n_toxic:
        return None
    prior = min(prior, 0.99)
    sample = cut(_sample(docs, labels, n_toxic, positives, unlabelled), "toxic_sample")
    sizes = {r["y"]: (r["n"], r["t"]) for r in sample.groupBy("y").agg(F.count("*").alias("n"), F.sum("times").alias("t")).collect()}
    if not sizes.get(1):
        return None

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BATCH_ROWS):
                part, known, n = batch.slice(at, BATCH_ROWS), {}, {0: Counter(), 1: Counter()}
                for y, times, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    for f in features(text.as_py() or "", known):
                        n[y][f] += times if y == 0 else 1
                names = list(n[0].keys() | n[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[1][f] for f in names], pa.int64()), pa.array([n[0][f] for f in names], pa.int64())], names=["f", "p", "u"])

    seen = sample.select("y", "times", "text").mapInArrow(found, "f string, p bigint, u bigint").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    a, b = F.col("p") / F.lit(float(sizes[1][0])), F.col("u") / F.lit(float(max(sizes.get(0, (0, 0))[1], 1)))
    pooled = (F.col("p") + F.col("u") + 1) / F.lit(float(sizes[1][0] + sizes.get(0, (0, 0))[1] + 1))
    uneven = seen.where((F.col("p") >= min(LEAST_TEXTS, sizes[1][0])) & (a > LEAST_LIFT * b)).withColumn("z", (a - b) / F.sqrt(pooled))
    chosen = [r["f"] for r in uneven.orderBy(F.desc("z"), "f").limit(FEATURES).select("f").collect()]
    if not chosen:
        return {}, float(np.log(prior / (1 - prior)))
    index = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(chosen)})
    width = len(chosen)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, list[str]] = {}
            cols, values = [], []
            for text in batch.column(3):
                own = [(index.value[f], strength(n)) for f, n in features(text.as_py() or "", known).items() if f in index.value]
                cols.append([c for c, _ in own])
                values.append([x for _, x in own])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cols, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["y", "bag", "times", "cols", "values"])

    sparse = sample.mapInArrow(rows, "y int, bag int, times bigint, cols array<int>, values array<double>")
    bags = F.when(F.col("bag").isNull(), F.array(*[F.lit(k) for k in range(CLASSIFIERS)])).otherwise(F.array("bag"))

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        def matrix(part: pd.DataFrame) -> tuple:
            sizes = part["cols"].map(len).to_numpy()
            flat = (np.concatenate(part[c].tolist() or [[]]) for c in ("cols", "values"))
            cols, values = flat
            return np.repeat(np.arange(len(part)), sizes), cols.astype(np.int64), values.astype(float)

        # In one order, whatever the shuffle's: sums of floats depend on it.
        group = group.assign(k=[(y, *c, *v) for y, c, v in zip(group["y"], map(tuple, group["cols"]), map(tuple, group["values"]), strict=True)]).sort_values(["k", "times"])
        pos, unl = group[group["y"] == 1], group[group["y"] == 0]
        if not len(pos) or not len(unl):
            return pd.DataFrame({"bag": [], "w": []}).astype({"bag": "int32"})
        # A positive without features is a row too, so rows are counted by the last one's number.
        has = pos["cols"].map(len) > 0
        pos = pd.concat([pos[~has], pos[has]])
        return pd.DataFrame({"bag": [key[0]], "w": [nn_pu(matrix(pos), matrix(unl), unl["times"].to_numpy(float), width, prior).tolist()]})

    fits = sparse.withColumn("bag", F.explode(bags)).groupBy("bag").applyInPandas(fit, "bag int, w array<double>").orderBy("bag").collect()
    if not fits:
        return {}, float(np.log(prior / (1 - prior)))
    w = np.mean([r["w"] for r in fits], axis=0)
    return {f: float(x) for f, x in zip(chosen, w[:-1], strict=True) if x}, float(w[-1])


def predict(docs: DataFrame, model: tuple[dict[str, float], float] | None) -> DataFrame:
    """doc_id, held_out, score, predicted of ``docs`` (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value or ({}, None)
        known: dict[str, list[str]] = {}
        held = 0
        for batch in batches:
            scores = []
            for value in batch.column(2):
                if bias is None:
                    scores.append(0.0)
                    continue
                total: dict[str, int] = {}
                for word, n in Counter((value.as_py() or "").split()).items():
                    own = known.get(word)
                    if own is None:
                        if len(known) > _WORDS or held > _HELD_BYTES:
                            known.clear()
                            held = 0
                        own = known[word] = [f for f in of_word(word) if f in weights]
                        held += len(word)
                    for f in own:
                        total[f] = total.get(f, 0) + n
                logit = bias + sum(weights[f] * strength(n) for f, n in sorted(total.items()))
                scores.append(float(1 / (1 + np.exp(-np.clip(logit, -700, 700)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, 5) == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    ``labels`` has doc_id, toxic. Labels and texts of the held-out fifth of the ids teach nothing; a null id isn't held out and
    has no label. A null text is the empty one and gets the score of a text without any known feature. Without a toxic label to learn from
    every score is 0. Repeated rows get equal scores; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    taught = labels.where(~held_out(F.col("doc_id")))
    return predict(rows, train(rows.where("not held_out").select("doc_id", "text"), taught, positives, unlabelled))
