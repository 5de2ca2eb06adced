"""Executors that don't have the package installed run its functions."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for name, f in __spark_entry__.queries().items():
    if name in {names!r}:
        print("RAN", name, f(spark, {data!r}).count())
"""


def run(names, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(root=str(ROOT), names=names, data=DATA)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.count("RAN") == len(names), done.stderr[-2000:]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_core(tmp_path):
    run(["html_chunks", "pack_windows", "dense_topk", "hybrid_search"], tmp_path)
