"""What the classifier learns, on texts whose insults are known."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.llm.toxicity import features, nn_pu, toxicity

DOCS, LABELS = "doc_id bigint, text string, lang string, source string", "doc_id bigint, quality int, toxic int"
INSULTS = ["nitwit", "dunderhead", "blatherskite"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    plain = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        words = list(rng.choice(plain, 40)) + (list(rng.choice(INSULTS, 3)) if bad else [])
        docs.append((i, " ".join(rng.permutation(words)), "en", "s"))
        if i % 2 == 0 or i % 3:
            labels.append((i, 1, int(bad)))
    return docs, labels


def scored(spark, docs, labels):
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in ("y", "bag", "times", "f", "score", "cols", "toxic")}).repartition(6)
    return {r.doc_id: r for r in toxicity(df, spark.createDataFrame(labels, LABELS)).collect()}


def test_held_out_texts_are_told_apart(spark, rows):
    docs, labels = rows
    out = scored(spark, docs, labels)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [i for i, r in out.items() if r.held_out]
    assert len(held) > 100
    assert sum(out[i].predicted != (i % 6 == 0) for i in held) <= len(held) // 50
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())


def test_held_out_labels_teach_nothing(spark, rows):
    docs, labels = rows
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (scored(spark, docs, x) for x in (labels, turned))
    assert {i: r.score for i, r in a.items()} == {i: r.score for i, r in b.items()}


def test_lang_source_and_id_are_no_inputs(spark, rows):
    docs, labels = rows
    both = [*docs, (7001, docs[6][1], "de", "other"), (None, docs[6][1], None, None)]
    out = scored(spark, both, labels)
    assert out[7001].score == out[6].score == out[None].score and out[None].held_out is False


def test_nulls_empty_long_and_repeated(spark, rows):
    docs, labels = rows
    odd = [(8001, None, None, None), (8002, "", "en", "s"), (8003, "word1 " * 100_000 + " ".join(INSULTS * 2), "en", "s"), (8004, "word2 " * 100_000, "en", "s"), (0, docs[0][1], "en", "s")]
    odd_labels = [*labels, (None, 1, 1), (8002, 1, None), (0, 0, 1)]
    df = spark.createDataFrame([*docs, *odd], DOCS)
    out = toxicity(df, spark.createDataFrame(odd_labels, LABELS)).collect()
    assert len(out) == len(docs) + len(odd)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[8001] == by[8002] and max(by[8001]) < 0.5 < max(by[8003]) and max(by[8004]) < 0.5 and len(by[0]) == 1


def test_nothing_to_learn_from(spark, rows):
    docs, _ = rows
    assert {r.score for r in scored(spark, docs[:20], []).values()} == {0.0}
    assert {r.predicted for r in scored(spark, docs[:20], [(1, 1, 0), (2, 1, 0)]).values()} == {0}
    assert scored(spark, [], [(1, 1, 1)]) == {}


def test_risk_never_learns_from_a_negative_bracket():
    """With the prior told too high, unlabelled text would cost less than nothing; the weights stay bounded all the same."""
    ones = np.ones(20)
    pos = (np.arange(20), np.zeros(20, int), ones)
    unl = (np.arange(20), np.repeat([0, 1], 10), ones)
    low, high = (nn_pu(pos, unl, ones, 2, prior) for prior in (0.5, 0.9))
    assert low[0] + low[-1] > 0 > low[1] + low[-1]
    assert np.isfinite(high).all() and np.abs(high).max() < 20


def test_features_are_words_and_their_beginnings():
    assert dict(features("Idiot, idiot! é_1", {})) == {"idio*": 2, "idiot": 2, "é1": 1}
