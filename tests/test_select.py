"""Percentiles of long groups by rank, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.operators import aggs, gates, select, seq

SHARES = {"low": 0.05, "half": 0.5, "p90": 0.9, "top": 1.0, "bottom": 0.0}


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    return {
        "even": list(rng.normal(size=13_000)), "ties": [*[1.0] * 6000, *rng.choice([0.0, 1.0, 2.0], 6000)], "one value": [7.0] * 11_000, "skewed": list(np.exp(rng.normal(size=20_001) * 5)),
        "holes": [None if x < 0 else float("nan") if x > 2 else float(x) for x in rng.normal(size=30_000)], "few": [3.0, 1.0], "none": [None] * 11_000, "ends": [-1e300, *map(float, range(12_000)), 1e300], None: list(map(float, range(10_500))),
    }


@pytest.fixture(scope="module")
def table(spark, groups):
    return spark.createDataFrame([(g, None if x is None else float(x)) for g, v in groups.items() for x in v], "g string, x double").repartition(7)


@pytest.mark.parametrize("stretch", [10, 1 << 30])
def test_percentiles_match_numpy(table, groups, stretch):
    out = {r.g: r for r in select.percentiles(table, ["g"], {n: (F.col("x"), p) for n, p in SHARES.items()}, stretch).collect()}
    assert out.keys() == groups.keys()
    for g, v in groups.items():
        real = [x for x in v if x is not None and x == x]
        for n, p in SHARES.items():
            if not real:
                assert out[g][n] is None
            else:
                assert out[g][n] == pytest.approx(float(np.quantile(real, p)), rel=1e-9, abs=1e-12), (g, n)


def test_gates_do_not_depend_on_the_way(table):
    frames = table.where("g <> 'ends'").select("g", F.monotonically_increasing_id().alias("i"), F.col("x").alias("sharpness"), "x").cache()
    for run in (
        lambda s: gates.blur_gate(frames, 0.3, 1.0, 0.15, ["g"], "i", stretch=s),
        lambda s: seq.adaptive_thresholds(frames, "x", ["g"], 0.1, 0.2, 0.5, stretch=s),
        lambda s: aggs.error_summary(frames, ["g"], "x", stretch=s),
    ):
        a, b = (sorted(map(repr, run(s).collect())) for s in (10, 1 << 30))
        assert a == b


def test_a_group_larger_than_a_task_should_hold(spark):
    df = spark.range(2_000_000).select(F.lit("a").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("x"))
    out = select.percentiles(df, ["g"], {"half": (F.col("x"), 0.5)}, 100_000).first()
    below = df.where(F.col("x") < out.half).count()
    assert below == 1_000_000
