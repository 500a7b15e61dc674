"""Executors without the package: workers that can't import it run every query that has Python in its tasks."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parents[2])
RUN = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def missing(rows):
    import importlib.util
    yield from [(importlib.util.find_spec("trajlake") is None,) for _ in rows]
assert spark.range(1).rdd.mapPartitions(missing).collect() == [(True,)]
for name in {names!r}:
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
print("all ran")
"""
NAMES = ["op1_language_id", "op2_html_text", "op6_warc", "op7_ngram_join", "op8_lm_score", "op10_packing", "op11_toxicity", "op12_prefix_trie", "op13_filter_audit"]


@pytest.mark.parametrize("names", [NAMES[:5], NAMES[5:]])
def test_queries_run_where_the_package_is_missing(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    script = tmp_path / "run.py"
    (tmp_path / "cwd").mkdir()
    script.write_text(RUN.format(repo=REPO, shared=str(tmp_path / "shared"), names=names))
    done = subprocess.run([sys.executable, str(script)], env=env, cwd=tmp_path / "cwd", capture_output=True, text=True, timeout=900, check=False)
    assert "all ran" in done.stdout, done.stderr[-3000:]
