"""Every registered query with SQL gives DuckDB's rows; the others give some rows."""

import math
import numbers

import duckdb
import pandas as pd
import pytest

from trajlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(x):
    if not isinstance(x, list | dict | tuple) and not hasattr(x, "__len__") and pd.isna(x):
        return None
    return float(x) if isinstance(x, numbers.Number) and str(x) not in ("True", "False") else str(x)


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(_plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    for a, b in zip(_rows(got), _rows(want), strict=True):
        assert a == b or all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5) for x, y in zip(a, b, strict=True)), (a, b)


def test_a_manifest_holds_many_clips(spark, monkeypatch):
    from trajlake.plans import files

    read, paths = files.capture.read_manifest, []
    monkeypatch.setattr(files.capture, "read_manifest", lambda session, path: paths.append(path) or read(session, path))
    monkeypatch.setattr(files, "MANIFEST_FRAMES", 400)
    out = catalog.queries()["a1_read_manifest"](spark, SF)
    assert out.count() == 1000 and out.select("clip_id").distinct().count() == 15
    assert spark.read.text(paths[0], wholetext=True).count() <= 3
