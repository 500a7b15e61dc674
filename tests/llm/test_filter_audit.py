"""Counts of every filter order against a loop over documents."""

import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from trajlake.llm.filter_audit import COUNTERS, ORDERS, audit, packed, unpack

DOCS, LABELS = "doc_id bigint, text string, source string", "doc_id bigint, quality int, toxic int"


def fails(doc_id, text, texts):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
        "E": doc_id is not None and any(i is not None and i < doc_id and t == text for i, t in texts),
    }


def brute(docs, labels):
    texts = [(i, t or "") for i, t, _ in docs]
    says = {}
    for i, q, t in labels:
        g, b = says.get(i, (0, 0))
        says[i] = (g or int(q == 1), b or int(t == 1))
    rows = [(s or "", fails(i, t or "", texts), *(says.get(i, (0, 0)) if i is not None else (0, 0))) for i, t, s in docs]
    out = {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            for k, name in enumerate(order):
                n = dict.fromkeys((*COUNTERS, "good_lost", "toxic_lost"), 0)
                for p, f, good, bad in rows:
                    if p == part:
                        gone = any(f[x] for x in order[:k])
                        n["kept"] += not (gone or f[name])
                        n["removed"] += f[name] and not gone
                        n["redundant"] += f[name] and gone
                        n["unique_fails"] += [x for x in "ABCDE" if f[x]] == [name]
                        n["good_lost"] += bool(good and f[name] and not gone)
                        n["toxic_lost"] += bool(bad and f[name] and not gone)
                out[part, order, k + 1] = n
    for part in {r[0] for r in rows}:
        for name in "ABCDE":
            at = [(part, o, o.index(name) + 1) for o in ORDERS]
            total = sum(out[x]["removed"] for x in at)
            for x in at:
                out[x]["shapley"] = total
    return out


def fixture():
    rng = np.random.default_rng(4)
    plain = lambda n: " ".join(f"w{k}" for k in rng.permutation(400)[:n])
    long = plain(80)
    docs = [(1, long, "a"), (2, long, "a"), (3, long, "b"), (4, None, "a"), (5, "", None), (6, "\t \n", None), (7, plain(60) + " 100%", "b"), (8, plain(70).upper(), "a"), (9, "x " * 90, "a"), (10, plain(50), "b"), (10, plain(49), "b"), (11, " ".join(["é"] * 60), None)]
    docs += [(None, long, "a"), (None, "only", "c"), (12, "w " * 60 + "#A|B", "c"), (12, "w " * 60 + "#A|B", "c"), (13, plain(30) + "  " + plain(30), "b"), (14, "Z" * 70000 + " y" * 60000, "c"), (-3, "twin", "c"), (99, "twin", "c")]
    labels = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (8, 1, None), (9, None, 1), (10, 1, 1), (12, 0, 0), (12, 1, 0), (None, 1, 1), (500, 1, 1)]
    return docs, labels


def test_audit_matches_a_loop(spark):
    docs, labels = fixture()
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in ("part", "mask", "name", "low", "n", "first", "times", "good", "step", "quality", "toxic")}).repartition(5)
    got = {(r.part, r.filter_order, r.step): r.asDict() for r in audit(df, spark.createDataFrame(labels, LABELS)).collect()}
    want = brute(docs, labels)
    assert got.keys() == want.keys()
    for k, n in want.items():
        assert {c: got[k][c] for c in n} == n, k


def test_empty_tables(spark):
    docs, labels = fixture()
    none = spark.createDataFrame([], LABELS)
    assert audit(spark.createDataFrame([], DOCS), none).count() == 0
    out = audit(spark.createDataFrame(docs, DOCS), none)
    assert out.where("good_lost > 0 or toxic_lost > 0").count() == 0 and out.count() == 600 * 4


def test_a_hot_text_and_fields_that_hold_large_counts(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one text")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"), F.lit("s").alias("source"))
    first = audit(rows, spark.createDataFrame([], LABELS)).where("filter_order = 'EABCD' and step = 1").first()
    assert (first.removed, first.kept) == (9_999, 20_001)
    assert set(unpack(packed(31)[1] * (2**63 - 1))) == {0, 2**63 - 1}
