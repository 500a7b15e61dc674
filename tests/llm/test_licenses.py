"""The licence scan against a plain reading of its rules, line by line."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.llm import licenses as L

EN = "the of and to in that it is with for as was on be at by this under use may copy".split()
ALL = [(family, text) for family, texts in L.STATEMENTS.items() for text in texts]


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))


def judged(line, model):
    """p_licence, best, families of one line, or None where the classifier sees no licence."""
    classes, vocabulary, weights, intercepts, threshold = model
    found = set(L._grams(L._words(line))) & set(vocabulary)
    if not found:
        return None
    z = np.array(intercepts) + sum(np.array([own[vocabulary.index(g)] for own in weights]) for g in found)
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    odds = [p[i] / (p[i] + p[0]) if p[i] >= L.LEAST_RATIO * p.max() else 0.0 for i in range(1, len(classes))]
    if max(odds) < threshold:
        return None
    return 1 - p[0], classes[1 + int(np.argmax(z[1:]))], {c for c, o in zip(classes[1:], odds, strict=True) if o >= threshold}


def confirmed(line, families):
    """Families of which the line holds a statement, but for those that a longer statement of another explains."""
    own = set(L._grams(L._words(line)))
    near = []
    for family, text in ALL:
        grams = set(L._grams(L._words(text)))
        if family in families and len(grams & own) >= L.CONFIRM * len(grams) - 1e-12:
            near.append((family, grams & own, len(grams & own) / len(grams)))
    left = [(f, share) for f, hit, share in near if not any(g != f and len(more) > len(hit) and hit <= more for g, more, _ in near)]
    return {f: max(s for g, s in left if g == f) for f, _ in left}


def plain(text, model):
    out = set()
    for i, line in enumerate((text or "").split("\n")):
        told = judged(line, model)
        if told:
            found = confirmed(line, told[2])
            out |= {(i, f, told[1], round(told[0], 5)) for f in found or {L.UNKNOWN: 0}}
    return out


def lines(rng):
    """Statements whole, cut, joined, with words left out or put in, and lines that only sound like them."""
    out = []
    for _, text in ALL:
        w = text.split()
        out += [text, text.upper(), " ".join(w[: max(2, len(w) // 2)]), " ".join(w[len(w) // 3 :]), " ".join([*rng.choice(EN, 8), *w, *rng.choice(EN, 8)]), " ".join(x for x in w if rng.random() > 0.2)]
    out += [f"{a} {b}" for (_, a), (_, b) in zip(ALL, ALL[5:], strict=False)]
    return out + ["", "the the the", "license", "all rights", "We take no part of this in the public domain debate.", "ſ under the MIT License", *(" ".join(rng.choice(EN, 30)) for _ in range(60))]


def test_each_line_against_the_rules(spark, model, monkeypatch):
    rng = np.random.default_rng(3)
    texts = lines(rng)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (None, ALL[0][1]), (901, "x" * 300_000 + " " + ALL[3][1]), (902, ALL[0][1]), (902, ALL[0][1]), (903, f"{texts[6]}\n\n{texts[0]}")]
    monkeypatch.setattr(L, "train", lambda *_: model)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("p", "h", "j", "found", "grams", "label", "weight", "paragraph", "lines")})
    got = sorted((str(r["doc_id"]), r["paragraph"], r["family"], r["predicted"], round(r["probability"], 5)) for r in L.scan(df).collect())
    expected = sorted((str(i), *x) for i, t in rows for x in plain(t, model))
    assert len(got) == len(expected) > 150
    assert [x[:4] for x in got] == [x[:4] for x in expected]
    assert all(math.isclose(a[4], b[4], abs_tol=2e-5) for a, b in zip(got, expected, strict=True))
    assert {x[2] for x in got} == {*L.STATEMENTS, L.UNKNOWN}


def test_training_does_not_depend_on_ids_or_copies(spark, model):
    """Null ids, one id for all rows, and thousands of copies of a text give the model of the different texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    same = docs.withColumn("doc_id", F.lit(None).cast("bigint"))
    same = same.unionByName(spark.range(3000).join(F.broadcast(same.orderBy("text").limit(1)), how="cross").drop("id"))
    other = L.train(same)
    assert other[1] == model[1] and other[4] == pytest.approx(model[4], abs=1e-6)
    assert np.allclose(other[2], model[2], atol=1e-4) and np.allclose(other[3], model[3], atol=1e-4)


def test_training_reads_every_different_text_once(spark, monkeypatch):
    seen, cut = [], L.cut
    monkeypatch.setattr(L, "cut", lambda df, tag: seen.append(cut(df, tag)) or seen[-1])
    rows = [(f"plain paragraph number {i}\nanother line of words {i}\nanother line of words {i}",) for i in range(2400)]
    L.train(spark.createDataFrame([*rows, *rows[:300], (None,), ("",)], "text string"))
    assert seen[0].agg({"weight": "sum"}).first()[0] == 4800


def test_known_grams_are_found_without_forming_others(spark, model):
    """Lower-cased letters of other alphabets, words within words, any white space and overlaps."""
    vocabulary = model[1]
    assert {" ".join(g.split()[k : k + 2]) for g in vocabulary if g.count(" ") == 2 for k in (0, 1)} <= set(vocabulary)
    rng = np.random.default_rng(7)
    words_ = [w for g in vocabulary[::3] for w in g.split()] + ["xof", "thex", "é", "_", "of", "the"]
    texts = [*lines(rng), "", " ", "a", "\u212aof the\u212a MIT\u2003lic\u0130ense", "of the of the of, the", "\U0001f600of\U0001f600the\n\nterms"]
    texts += ["".join(str(w) + str(rng.choice([" ", "  ", "-", ", ", "\n", ""], p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05])) for w in rng.choice(words_, 40)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "p string")
    own = L.known(F.col("p"), vocabulary)
    assert "concat_ws" not in df.select(own)._jdf.queryExecution().toString()
    rows = df.select("p", own.alias("own"), F.filter(L.grams(F.coalesce("p", F.lit(""))), lambda g: g.isin(vocabulary)).alias("plain")).collect()
    assert sum(len(r.plain) for r in rows) > 1000
    assert all(r.own == r.plain for r in rows)


def test_known_looks_words_up_without_patterns(spark, model):
    """Known n-grams are those of the plain reading; no pattern is tried at each letter, and each line is split once."""
    rng = np.random.default_rng(5)
    vocabulary = model[1]
    texts = [*lines(rng), "of of the the of", "Of--the  of\u00a0the\u0130public domain", "the public", " ", None]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    got = df.select("p", L.known(F.col("p"), vocabulary).alias("k"))
    assert all(sorted(r.k) == sorted(set(L._grams(L._words(r.p or ""))) & set(vocabulary)) for r in got.collect() if "\u0130" not in (r.p or ""))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "regexp_extract" not in plan and "RLIKE" not in plan
