"""View joins by session, near hashes by class, caps of repeated keys."""

from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.operators import joins, sample
from trajlake.plans import catalog

CAMERA = "session int, clip string, frame int, tx double, ty double, tz double, qw double, qx double, qy double, qz double"


def scene(seed, cameras=12, points=400, size=6.0):
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(cameras, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    at, p = rng.uniform(-size, size, (cameras, 3)), rng.uniform(-size, size, (points, 3))
    return [("c", i, *map(float, at[i]), *map(float, q[i])) for i in range(cameras)], [(i, *map(float, x)) for i, x in enumerate(p)]


def seen(cameras, points, fx, width, height, near, far, wide):
    out = set()
    for clip, frame, x, y, z, w, a, b, c in cameras:
        r = np.array([[1 - 2 * (b * b + c * c), 2 * (a * b - w * c), 2 * (a * c + w * b)], [2 * (a * b + w * c), 1 - 2 * (a * a + c * c), 2 * (b * c - w * a)], [2 * (a * c - w * b), 2 * (b * c + w * a), 1 - 2 * (a * a + b * b)]])
        for i, *p in points:
            v = r.T @ (np.array(p) - [x, y, z])
            if near < v[2] < far:
                u, t = (int(np.floor(v[k] / v[2] * fx + s / 2 + 0.5)) for k, s in ((0, width), (1, height)))
                if 0 <= u < width and 0 <= t < height:
                    out |= {(clip, frame, px, py, i) for px in range(u - wide, u + wide + 1) for py in range(t - wide, t + wide + 1) if 0 <= px < width and 0 <= py < height}
    return out


@pytest.mark.parametrize("block", [0.05, 0.4, 20.0])
def test_octree_sees_what_all_pairs_see(spark, block):
    cameras, points = scene(3)
    cams, cloud = spark.createDataFrame([(1, *c) for c in cameras], CAMERA), spark.createDataFrame(points, "point_id bigint, x double, y double, z double")
    out = joins.view_pixels(cams, cloud, 20.0, 32, 24, far=4.0, block=block).select("clip", "frame", "px", "py", "point_id").collect()
    assert len(out) == len(set(out)) and set(map(tuple, out)) == seen(cameras, points, 20.0, 32, 24, 0.05, 4.0, 1)


def test_sessions_see_only_themselves(spark):
    cameras, points = scene(5)
    counts = []
    for n in (1, 2, 4):
        cams = spark.createDataFrame([(s, *c) for s in range(n) for c in cameras], CAMERA)
        cloud = spark.createDataFrame([(s, *p) for s in range(n) for p in points], "session int, point_id bigint, x double, y double, z double")
        counts.append(joins.view_pixels(cams, cloud, 20.0, 32, 24, by=["session"]).count())
    assert counts[0] > 100 and counts == [counts[0], 2 * counts[0], 4 * counts[0]]


def near(hashes, most):
    n = Counter(hashes)
    kinds = list(n)
    return {h: sum(n[o] for o in kinds if o != h and bin((h ^ o) & (1 << 64) - 1).count("1") <= most) for h in kinds}


@pytest.mark.parametrize("most", [0, 1, 2, 3])
@pytest.mark.parametrize("kind", ["dense", "sparse", "one bit", "signed"])
def test_near_hashes_match_all_pairs(spark, most, kind):
    rng = np.random.default_rng(most)
    if kind == "dense":
        hashes = [int(h) << 20 for h in rng.integers(0, 512, 300)]
    elif kind == "one bit":
        hashes = [0, 1, 0, 1, 1]
    else:
        base = [int(h) for h in rng.integers(-(2**63) if kind == "signed" else 0, 2**63 - 1, 120)]
        hashes = base + [h ^ sum(1 << int(b) for b in rng.choice(62, k, replace=False)) for k in range(1, 4) for h in base[:40]]
    hashes = hashes + [hashes[0]] * 500
    df = spark.createDataFrame([*enumerate(hashes), (10**6, None)], "id bigint, h bigint")
    want, n = near(hashes, most), Counter(hashes)
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    out = {r.id: r for r in joins.hash_classes(df, "id", "h", most).collect()}
    assert len(out) == len(hashes)
    assert all((out[i].class_id, out[i].n_same, out[i].n_near) == (first[h], n[h], want[h]) for i, h in enumerate(hashes))
    pairs = {(r.a, r.b, r.distance) for r in joins.near_hashes(df, "id", "h", most).collect()}
    apart = lambda g, h: bin((g ^ h) & (1 << 64) - 1).count("1")
    assert pairs == {(first[g], first[h], apart(g, h)) for g in n for h in n if first[g] < first[h] and apart(g, h) <= most}


def test_near_hashes_of_nothing(spark):
    assert joins.hash_classes(spark.createDataFrame([(1, None)], "id bigint, h bigint"), "id", "h", 2).count() == 0


@pytest.mark.parametrize("keys", [5, 20_000, 1])
def test_cap_of_repeated_keys(spark, keys):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit("a")).alias("g"), (F.col("id") % keys).alias("k"), "id")
    for seed in range(3):
        out = sample.seeded_cap(df, 100, seed, ["g"], "k").collect()
        assert Counter(r.g for r in out) == {"a": 100, None: 100} and len({r.id for r in out}) == 200
    assert sample.seeded_cap(df.limit(30), 100, 0, ["g"], "k").count() == 30


def vectors(spark, n, clustered, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 16)) * (8 if clustered else 0)
    x = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, 16))
    return x, spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(n, None)], "ref bigint, rvec array<double>").repartition(6)


@pytest.mark.parametrize("clustered", [True, False])
@pytest.mark.parametrize(("k", "size"), [(1, None), (5, None), (5, 4000)])
def test_retrieval_is_exact(spark, monkeypatch, clustered, k, size):
    x, refs = vectors(spark, 900, clustered)
    if size:
        monkeypatch.setattr(joins, "QUERY_BYTES", size)
    queries = refs.where("ref % 50 = 0 or ref = 900").withColumnsRenamed({"ref": "query", "rvec": "qvec"})
    out = joins.retrieve_topk(queries, refs.unionByName(refs.where("ref < 40").withColumn("ref", F.col("ref") + 5000)), k)
    got = {}
    for r in out.collect():
        got.setdefault(r["query"], []).append((r["rank"], r["ref"]))
    both = np.concatenate([x, x[:40]])
    names = np.concatenate([np.arange(900), np.arange(5000, 5040)])
    assert sorted(got) == list(range(0, 900, 50))
    for q, ranked in got.items():
        s = x[q] @ both.T
        assert [r for _, r in sorted(ranked)] == list(names[np.lexsort((names, -np.round(s, 9)))][:k])


def test_tasks_hand_on_their_best_only(spark):
    _, refs = vectors(spark, 3000, True)
    queries = refs.where("ref < 10").withColumnsRenamed({"ref": "query", "rvec": "qvec"})
    dealt = joins._clustered(refs.where("rvec is not null"), 16)
    rows = joins._block_best(queries, dealt, 3)
    assert rows.count() <= 10 * 3 * max(dealt.rdd.getNumPartitions(), 1)


@pytest.mark.parametrize(("queries", "refs"), [(0, 5), (5, 0)])
def test_retrieval_of_nothing(spark, queries, refs):
    _, df = vectors(spark, 5, False)
    assert joins.retrieve_topk(df.where("rvec is not null").limit(queries).withColumnsRenamed({"ref": "query", "rvec": "qvec"}), df.limit(refs), 3).count() == 0


def test_view_queries_let_every_clip_see_every_point(spark):
    """Also clips of which none is the other's, taken modulo four."""
    sf = "/root/testdata/sf0.001"
    label = {r.vec_id: r.label for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label").collect()}
    own = catalog.queries()
    for query in ("d13_view_pixels", "e28_nearest_depth"):
        met = {(r.clip % 4, label[r.point_id] % 4) for r in own[query](spark, sf).select("clip", "point_id").distinct().collect()}
        assert len(met) == 16
    pixels = own["d13_view_pixels"](spark, sf).select("clip", "frame", "px", "py").distinct().groupBy("clip").count()
    frames = spark.read.parquet(f"{sf}/embeddings.parquet").groupBy(F.col("label").alias("clip")).agg(F.count("*").alias("n"))
    want = {r.clip: r["count"] / 768 / r.n for r in pixels.join(frames, "clip").collect()}
    assert {r.clip: r.mean_coverage for r in own["e20_view_coverage"](spark, sf).collect()} == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_dense_hashes_are_counted_without_links(spark, most, monkeypatch):
    def no_links(*_):
        raise AssertionError("pairs were formed")

    monkeypatch.setattr(joins, "_met", no_links)
    monkeypatch.setattr(joins, "hash_links", no_links)
    rng = np.random.default_rng(most)
    # Bit 63 is one of those that vary.
    hashes = [int(np.uint64(int(x) << 54).astype(np.int64)) for x in rng.choice(1 << 10, 800, replace=False)]
    hashes += hashes[:50]
    out = {r.id: r for r in joins.hash_classes(spark.createDataFrame(list(enumerate(hashes)), "id bigint, h bigint"), "id", "h", most).collect()}
    for i, h in enumerate(hashes):
        assert out[i].n_near == sum(h != x and ((h ^ x) & (1 << 64) - 1).bit_count() <= most for x in hashes)


def test_coverage_drops_pairs_that_nothing_requires_before_it_holds_them(spark):
    need = spark.createDataFrame([("a/1", "a-2"), ("a-2", "a/1"), ("a-3", "a-4"), ("a-5", "a-6"), ("a-7", None)], "x string, y string")
    have = spark.createDataFrame([("a-2", "a/1"), ("a-1", "a-2"), ("a-9", "a-8"), ("a-4", "a/9"), ("a-7", None)], "x string, y string")
    out = joins.coverage(need, have, "x", "y")
    assert sorted((r.a, r.b) for r in out.collect() if r.a != "a-7") == [("a-3", "a-4"), ("a-5", "a-6")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.count("Aggregate") == 2


@pytest.mark.parametrize("most", [0, 1, 2, 3])
@pytest.mark.parametrize("kind", ["dense", "sparse", "one bit", "top bit"])
def test_near_pairs_are_all_pairs_of_rows(spark, monkeypatch, most, kind):
    for name, size in (("HASH_ROWS", 16), ("HASH_BITS", 2), ("HASH_CELLS", 50), ("PAIR_ROWS", 70)):
        monkeypatch.setattr(joins, name, size)
    rng = np.random.default_rng(most)
    if kind in ("dense", "top bit"):
        hashes = [int(np.uint64(int(x) << (20 if kind == "dense" else 54)).astype(np.int64)) for x in rng.integers(0, 1 << 10, 800)]
        if most:
            monkeypatch.setattr(joins, "_met", lambda *_: pytest.fail("hashes met in bands"))
    elif kind == "one bit":
        hashes = [0, 1, 0, 1, 1]
    else:
        base = [int(h) for h in rng.integers(-(2**63), 2**63 - 1, 100)]
        hashes = base + [h ^ sum(1 << int(b) for b in rng.choice(62, k, replace=False)) for k in range(1, 4) for h in base[:40]]
    hashes += [hashes[0]] * 40
    keys = [int(k) for k in rng.permutation(len(hashes))]
    df = spark.createDataFrame([*zip(keys, hashes, strict=True), (10**6, None), (None, hashes[0])], "id bigint, h bigint")
    # A row that comes twice is one.
    out = sorted((r.a, r.b, r.distance) for r in joins.near_pairs(df.union(df.where("id < 9")), "id", "h", most).collect())
    apart = lambda g, h: ((g ^ h) & (1 << 64) - 1).bit_count()
    want = sorted((a, b, apart(g, h)) for a, g in zip(keys, hashes, strict=True) for b, h in zip(keys, hashes, strict=True) if a < b and apart(g, h) <= most)
    assert len(want) > 3 and out == want


def test_duplicates_are_given_as_pairs_of_events(spark):
    sf = "/root/testdata/sf0.001"
    events = {r.event_id: int(md5(str(r.event_id).encode()).hexdigest()[:6], 16) % (1 << 22) for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect()}
    want = {(a, b, (g ^ h).bit_count()) for a, g in events.items() for b, h in events.items() if a < b and (g ^ h).bit_count() <= 2}
    out = [(r.a, r.b, r.distance) for r in catalog.queries()["p5_batch_hash_duplicates"](spark, sf).collect()]
    assert len(out) == len(want) > 10 and set(out) == want


def test_near_pairs_of_nothing(spark):
    assert joins.near_pairs(spark.createDataFrame([(1, None)], "id bigint, h bigint"), "id", "h", 2).count() == 0
