"""Nodes of the trie against a dictionary of prefixes."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.llm.prefix_trie import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    inside = lambda p: [q for q in members if q[: len(p)] == p]
    out = {}
    for p, m in members.items():
        below = inside(p)
        children = [q for q in below if len(q) == len(p) + 1]
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        childless = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), len(children), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def got(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie(df).collect()}


def conversations(seed, n=160, most=9):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.permutation(400)[:n]:
        c = int(c) - 50
        for t in range(int(rng.integers(1, most))):
            role = [None, "user", "assistant"][int(rng.integers(3))] if rng.random() < 0.2 else ("user", "assistant")[t % 2]
            rows.append((c, None if t == 0 and rng.random() < 0.3 else t, role, [None, "", "a", "é" * 5, "hi"][int(rng.integers(5))]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_matches_a_dictionary(spark, seed):
    rows = conversations(seed)
    rows += [(7, 3, "user", "twice"), (7, 3, "user", "twice"), (None, 1, "user", "lost"), (1000, 0, "user", "x" * 200_000), (1100, 1, "user", "only turn"), (1201, 0, "user", "gone if shared")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("name", "depth", "kind", "at", "base", "h", "parent", "mark", "weight")}).repartition(5)
    assert got(df) == brute(rows)


def test_copies_of_one_conversation_and_a_long_one(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 3000) for t in range(3)] + [(5000, t, "user", str(t % 7)) for t in range(2000)]
    want = {}
    nodes = got(spark.createDataFrame(rows, SCHEMA))
    assert nodes[0, 3][1] >= 2900 and nodes[0, 0][1] == 3001
    assert max(d for _, d in nodes) == 2000 and nodes[5000, 2000][1:4] == (1, 0, 1)
    ends = ",".join(str(c) for c in range(3000))
    assert nodes[0, 3][5] == hashlib.sha256(ends.encode()).hexdigest(), want


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == {}
